"""Chat formatting as prefix trees.

Conversations are ordered by the hashes of their turns, so that those with equal first turns are neighbours. Walking them in
that order visits the tree depth first: a conversation adds only the turns beyond what it shares with the one before. A
sequence is a run of neighbours up to a number of tokens; within it every shared turn is emitted once. Each node carries the
position of its first token on its path and the token intervals of its ancestors, the only ones it may attend to besides
itself. A tree with very many conversations fills several sequences, each of which starts from the root again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pieces
from .packing import tokenizer

#: Template of a turn: OPEN role MID text CLOSE. Within role and text each of ``<``, ``[`` and ``\`` is followed by a
#: backslash, so no control string can occur there and removing it restores the text.
OPEN, MID, CLOSE = "<s>[INST:", "]", "</s>"
_ESCAPE, _UNESCAPE = re.compile(r"[<\[\\\]]"), re.compile(r"([<\[\\\]])\\")
_TURN = re.compile(r"<s>\[INST:([^\]]*(?:\]\\[^\]]*)*)\](?!\\)([^<]*(?:<\\[^<]*)*)</s>")
_COLUMNS = [("sequence_id", "long"), ("ids", "array<int>"), ("start", "array<int>"), ("length", "array<int>"), ("parent", "array<int>"), ("position", "array<int>"),
            ("loss_start", "array<int>"), ("loss_length", "array<int>"), ("attends", "array<array<int>>"), ("conv_id", "array<long>"), ("leaf", "array<int>")]
_KINDS = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<array<int>>": pa.list_(pa.list_(pa.int32()))}
SEQUENCES = ", ".join(f"{n} {t}" for n, t in _COLUMNS)
_SCHEMA = pa.schema([(n, _KINDS[t]) for n, t in _COLUMNS])


def escape(s: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", s)


def unescape(s: str) -> str:
    return _UNESCAPE.sub(r"\1", s)


class Sequence:
    """Nodes of one sequence in depth-first order."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.tokens = 0
        self.columns: dict[str, list] = {n: [] for n, _ in _COLUMNS[2:]}
        self.turns: list[tuple[str, str]] = []
        self.path: list[int] = []

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        while n < min(len(turns), len(self.turns)) and turns[n] == self.turns[n]:
            n += 1
        return n

    def add(self, conv_id: int | None, turns: list[tuple[str, str]], shared: int, encoded: list[tuple[np.ndarray, np.ndarray, np.ndarray]], loss_role: str) -> None:
        c, path = self.columns, self.path[:shared]
        for (role, _), parts in zip(turns[shared:], encoded):
            parent = path[-1] if path else -1
            length = sum(map(len, parts))
            c["attends"].append(self.ancestors(parent))
            c["start"].append(self.tokens), c["length"].append(length), c["parent"].append(parent)
            c["position"].append(c["position"][parent] + c["length"][parent] if path else 0)
            c["loss_start"].append(self.tokens + len(parts[0])), c["loss_length"].append(len(parts[1]) if role == loss_role else 0)
            self.ids.extend(parts)
            self.tokens += length
            path.append(len(c["start"]) - 1)
        self.turns, self.path = turns, path
        c["conv_id"].append(conv_id), c["leaf"].append(path[-1])

    def ancestors(self, node: int) -> list[int]:
        """[from, to, from, to, …] of a node and its ancestors in order; neighbours are one interval."""
        if node < 0:
            return []
        above, start = list(self.columns["attends"][node]), self.columns["start"][node]
        end = start + self.columns["length"][node]
        if above and above[-1] == start:
            above[-1] = end
            return above
        return [*above, start, end]

    def row(self, number: int) -> pa.RecordBatch:
        values = {"sequence_id": number, "ids": np.concatenate(self.ids).astype(np.int32), **self.columns}
        return pa.RecordBatch.from_arrays([pa.array([values[f.name]], f.type) for f in _SCHEMA], schema=_SCHEMA)


def format_trees(conversations: DataFrame, ranks: str, pattern: str, max_tokens: int = 32_768, max_conversations: int = 4_096, loss_role: str = "assistant",
                 conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per sequence: token ids and, for each node, start, length, parent, position, loss span and ancestor intervals;
    for each conversation its last node.

    Rows of a conversation go by turn, then role and text; null turns come first, null roles and texts are empty, null ids
    form one conversation. A task holds one conversation and one sequence. A conversation longer than ``max_tokens`` has a
    sequence to itself.
    """
    turns = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                                                 F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))))
    convs = conversations.groupBy(F.col(conv_id).cast("long").alias("conv_id")).agg(turns.alias("turns"))
    convs = convs.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    n = pieces(conversations.count(), 20_000, conversations.sparkSession.sparkContext.defaultParallelism)
    walk = convs.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "turns.role", "turns.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, seq, number, heads = tokenizer(ranks, pattern), Sequence(), 0, {}
        close = np.frombuffer(tok.encode(CLOSE), "<u4")
        for b in batches:
            for part, who, roles, texts in zip(*(b.column(k).to_pylist() for k in range(4))):
                if not number:
                    number = part << 32
                now = list(zip(roles, texts))

                def encode(k: int) -> list:
                    out = []
                    for r, t in now[k:]:
                        if r not in heads:
                            if len(heads) > 10_000:
                                heads.clear()
                            heads[r] = np.frombuffer(tok.encode(OPEN + escape(r) + MID), "<u4")
                        out.append((heads[r], np.frombuffer(tok.encode(escape(t)), "<u4"), close))
                    return out

                shared = seq.shared(now)
                new = encode(shared)
                size = sum(len(x) for p in new for x in p)
                if seq.ids and (seq.tokens + size > max_tokens or len(seq.columns["leaf"]) >= max_conversations):
                    yield seq.row(number)
                    seq, number = Sequence(), number + 1
                    new, shared = encode(0), 0
                seq.add(who, now, shared, new, loss_role)
        if seq.ids:
            yield seq.row(number)

    return walk.mapInArrow(run, SEQUENCES)


def read_back(sequences: DataFrame, ranks: str, pattern: str, loss_role: str = "assistant") -> DataFrame:
    """Per conversation what its tokens say: turns, loss text and formatted length. The path's tokens are those that its last
    node attends to; parents, positions and intervals must agree, else this raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks, pattern).bpe
        for b in batches:
            for s in b.to_pylist():
                ids, out = s["ids"], []
                for who, leaf in zip(s["conv_id"], s["leaf"]):
                    path = [leaf]
                    while s["parent"][path[-1]] >= 0:
                        path.append(s["parent"][path[-1]])
                    path.reverse()
                    a = [*s["attends"][leaf], s["start"][leaf], s["start"][leaf] + s["length"][leaf]]
                    seen = [i for k in range(0, len(a), 2) for i in ids[a[k]:a[k + 1]]]
                    if len(seen) != s["position"][leaf] + s["length"][leaf] or seen != [i for p in path for i in ids[s["start"][p]:s["start"][p] + s["length"][p]]]:
                        raise ValueError(f"intervals of conversation {who} do not give its path")
                    shown = bpe.decode_bytes(seen).decode()
                    turns = [(unescape(r), unescape(t)) for r, t in _TURN.findall(shown)]
                    loss = "".join(unescape(bpe.decode_bytes(ids[s["loss_start"][p]:s["loss_start"][p] + s["loss_length"][p]]).decode()) for p in path)
                    if len(turns) != len(path):
                        raise ValueError(f"conversation {who} does not parse")
                    out.append((who, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(shown)))
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=names)

    return sequences.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
