"""Prefix trie of conversations from vertical bitmaps.

Conversations are cut into shards of neighbouring ids, positions into blocks. A shard's block is indexed vertically: for each (position,
turn) the set of its conversations, one bit each in order of id. Depth-first, a node's set met with the postings of the next position gives
its children; the bits set are its conversations, the lowest is the smallest id, and those that are as long as the node is deep end there.
Shards' nodes are summed by fingerprint: the sums of two 64-bit hashes over (position, turn), which a block's first nodes
have from a running sum over the blocks before. Sums over subtrees double their reach each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..core.stage import stage
from .common import pieces

#: Conversations of a shard and positions of a block: what a task's index holds at most.
PER_SHARD, PER_BLOCK = 2_048, 256
#: Stands for a null id inside; an id of this value is taken for null.
NO_ID = -(1 << 63)
_WRAP = 1 << 64
TURN = ("x1", "x2", "chars")


def _signed(x: int) -> int:
    x %= _WRAP
    return x - _WRAP if x >= _WRAP >> 1 else x


def _wrapped(total: Column) -> Column:
    """A decimal sum of longs modulo 2**64, as long, as tasks add them."""
    whole, half = (F.lit(str(x)).cast("decimal(38,0)") for x in (_WRAP, _WRAP >> 1))
    low = F.pmod(total, whole)
    return F.when(low >= half, low - whole).otherwise(low).cast("long")


def ranked(rows: DataFrame) -> DataFrame:
    """``conv, pos, x1, x2, chars`` (a turn's 128-bit name and length): turns numbered within their conversation by (turn, role, text), null turns first.

    Rows are range-partitioned by conversation and turn, numbered inside a part, and moved on by the rows of their conversation in earlier parts,
    so one conversation may span any number of parts.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    cut = rows.repartitionByRange(parts, F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 40))
    cut = stage(cut.withColumn("_part", F.spark_partition_id()))
    counts = cut.groupBy("conv", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("conv").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    moved = counts.select("conv", "_part", F.sum("_n").over(before).alias("_before")).where("_before > 0")
    here = cut.withColumn("_k", F.row_number().over(W.partitionBy("conv", "_part").orderBy(*order)) - 1)
    return here.join(moved, ["conv", "_part"], "left").select("conv", (F.col("_k") + F.coalesce("_before", F.lit(0))).cast("long").alias("pos"),
                                                              F.xxhash64(F.lit(1), "role", "text").alias("x1"), F.xxhash64(F.lit(2), "text", "role").alias("x2"), F.length("text").cast("long").alias("chars"))


def rebuilt(turns: DataFrame, borrowed: Column, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(conversations with their number of turns, turns): each begins with the first ``borrowed`` (at most ``most``) turns of the
    conversation whose id is its own rounded to ``every``, and goes on with its own turns after as many."""
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("_own"))
    convs = convs.withColumn("_h", F.when(F.col("conv") == NO_ID, 0).otherwise(borrowed).cast("long")).withColumn("_base", F.when(F.col("conv") == NO_ID, F.col("conv")).otherwise(F.col("conv") - F.col("conv") % every))
    bases = convs.select(F.col("conv").alias("_base"), F.least(F.col("_own"), F.lit(most)).alias("_has"))
    convs = convs.join(bases, "_base", "left").withColumn("_taken", F.least("_h", F.coalesce("_has", F.lit(0))))
    convs = convs.withColumn("n", F.col("_taken") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0)))
    shards = pieces(convs.count(), PER_SHARD)
    convs = stage(convs.repartitionByRange(shards, "conv").select("conv", "_h", "_base", "_taken", "n", F.spark_partition_id().alias("shard")))
    first = turns.where(F.col("pos") < most).select(F.col("conv").alias("_base"), "pos", *TURN)
    head = convs.where("_taken > 0").join(first, "_base").where("pos < _taken").select("conv", "shard", "n", "pos", *TURN)
    rest = turns.join(convs, "conv").where("pos >= _h").select("conv", "shard", "n", (F.col("pos") - F.col("_h") + F.col("_taken")).alias("pos"), *TURN)
    return convs, head.unionAll(rest)


NODE = "f1 long, f2 long, p1 long, p2 long, depth long, first long, n_convs long, chars long, shard int, ends array<long>"


def _block(t: pa.Table) -> pa.Table:
    """The nodes that one shard's block of positions adds."""
    conv, pos, h1, h2, e1, e2, n, chars = (t[c].to_pylist() for c in ("conv", "pos", "h1", "h2", "e1", "e2", "n", "chars"))
    shard = t["shard"][0].as_py()
    ids = sorted(set(conv))
    bit = {c: k for k, c in enumerate(ids)}
    postings: dict[tuple, int] = {}
    turn_at: dict[tuple, tuple] = {}
    size: dict[tuple, int] = {}
    ends: dict[int, int] = {}
    begin: dict[tuple, int] = {}
    low = min((p for p in pos if p >= 0), default=0)
    low -= low % PER_BLOCK
    for c, p, a, b, x, y, k, s in zip(conv, pos, h1, h2, e1, e2, n, chars):
        j = bit[c]
        if p >= 0:
            postings[p, a, b] = postings.get((p, a, b), 0) | 1 << j
            turn_at[p, j] = (a, b)
            size[p, a, b] = s
        if p == k - 1:
            ends[k] = ends.get(k, 0) | 1 << j
        if p in (-1, low) and (low or p < 0):
            begin[x, y] = begin.get((x, y), 0) | 1 << j
    has: dict[int, int] = {}
    for (p, _, _), members in postings.items():
        has[p] = has.get(p, 0) | members

    def listed(members: int) -> list[int]:
        raw = np.frombuffer(members.to_bytes((len(ids) + 7) // 8, "little"), np.uint8)
        return [ids[k] for k in np.flatnonzero(np.unpackbits(raw, bitorder="little"))]

    out: list[tuple] = []

    def node(key: tuple, parent: tuple, depth: int, members: int, length: int) -> None:
        ended = members & ends.get(depth, 0)
        out.append((*key, *parent, depth, ids[(members & -members).bit_length() - 1], members.bit_count(), length, shard, listed(ended) if ended else None))

    if not low:
        node((0, 0), (None, None), 0, begin[0, 0], 0)
    open_ = [(key, low, members) for key, members in begin.items()]
    while open_:
        key, p, members = open_.pop()
        left = members & has.get(p, 0) if p < low + PER_BLOCK else 0
        while left:
            turn = turn_at[p, (left & -left).bit_length() - 1]
            child = members & postings[p, *turn]
            left &= ~child
            below = _signed(key[0] + turn[0]), _signed(key[1] + turn[1])
            node(below, key, p + 1, child, size[p, *turn])
            open_.append((below, p + 1, child))
    return pa.table(dict(zip((f.split()[0] for f in NODE.split(", ")), zip(*out))), schema=pa.schema(
        [(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}[f.split()[1]]) for f in NODE.split(", ")]))


def _ended(nodes: DataFrame) -> DataFrame:
    """``f1, f2, ends_sha256``: shards' lists, which follow each other in order of id, are digested one after the other; no node's list is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        done: list[tuple] = []
        for b in batches:
            for a, c, _, ids in zip(*(x.to_pylist() for x in b.columns)):
                if (a, c) != key:
                    if key is not None:
                        done.append((*key, h.hexdigest()))
                    key, h = (a, c), hashlib.sha256()
                elif ids:
                    h.update(b",")
                h.update(",".join("null" if i == NO_ID else str(i) for i in ids).encode())
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["f1", "f2", "ends_sha256"])
                done = []
        if key is not None:
            done.append((*key, h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["f1", "f2", "ends_sha256"])

    lists = nodes.where("ends IS NOT NULL").select("f1", "f2", "shard", "ends")
    return lists.repartition("f1", "f2").sortWithinPartitions("f1", "f2", "shard").mapInArrow(run, "f1 long, f2 long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, deepest: int, sums: list[str]) -> DataFrame:
    """Adds up ``sums`` over each node's subtree. After round k a sum reaches 2**k levels down and ``p1, p2`` point as far up."""
    reach = 1
    while reach <= deepest:
        below = nodes.where("p1 IS NOT NULL").groupBy("p1", "p2").agg(*[F.sum(c).alias(f"_{c}") for c in sums]).withColumnsRenamed({"p1": "f1", "p2": "f2"})
        above = nodes.select(F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("p1").alias("_u1"), F.col("p2").alias("_u2"))
        wide = nodes.join(below, ["f1", "f2"], "left").join(above, ["p1", "p2"], "left")
        rest = [c for c in nodes.columns if c not in (*sums, "p1", "p2")]
        nodes = stage(wide.select(*rest, F.col("_u1").alias("p1"), F.col("_u2").alias("p2"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums]))
        reach *= 2
    return nodes


def prefix_trie(conversations: DataFrame, borrowed: Column | None = None, every: int = 100, most: int = 5, conv_id: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``borrowed`` is how many turns the conversation ``conv`` begins with that are another's (see ``rebuilt``); none by default. Null
    roles and texts are empty. Rows without an id are one conversation, which comes before all others, is named null and takes none of
    another's turns; it is written ``null`` in a node's list. Rows of one turn are ordered by role and text, so repeated rows count as turns. A
    conversation left without turns belongs to the root. An empty table has no node. Other columns are not read.
    """
    rows = conversations.select(F.coalesce(F.col(conv_id).cast("long"), F.lit(NO_ID)).alias("conv"), F.col(turn).cast("long").alias("turn"),
                                F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    convs, turns = rebuilt(stage(ranked(rows)), F.lit(0) if borrowed is None else borrowed, every, most)
    turns = stage(turns.select("conv", "shard", "n", "pos", "chars", F.xxhash64(F.lit(1), "pos", "x1", "x2").alias("h1"),
                               F.xxhash64(F.lit(2), "x2", "pos", "x1").alias("h2")))
    turns = turns.withColumn("block", F.floor(F.col("pos") / PER_BLOCK))
    per = turns.where("n > %d" % PER_BLOCK).groupBy("conv", "block").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(f"_{c}") for c in ("h1", "h2")])
    before = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    entry = per.select("conv", "block", *[_wrapped(F.sum(f"_h{k}").over(before)).alias(f"e{k}") for k in (1, 2)]).where("block > 0")
    zero = F.lit(0).cast("long")
    placed = (turns.where("block = 0").select("*", zero.alias("e1"), zero.alias("e2"))
              .unionByName(turns.where("block > 0").join(entry, ["conv", "block"]))
              .unionByName(convs.select("conv", "shard", "n", F.lit(-1).cast("long").alias("pos"), zero.alias("chars"), zero.alias("h1"), zero.alias("h2"),
                                        zero.alias("block"), zero.alias("e1"), zero.alias("e2"))))
    local = stage(placed.groupBy("shard", "block").applyInArrow(_block, NODE))
    nodes = local.groupBy("f1", "f2").agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("depth").alias("depth"), F.min("first").alias("first"), F.sum("n_convs").alias("n_convs"), F.min("chars").alias("chars"))
    own = stage(nodes)
    children = own.where("p1 IS NOT NULL").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed({"p1": "f1", "p2": "f2"})
    parents = own.select(F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("first").alias("_parent"))
    leaf = F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long")
    narrow = own.join(children, ["f1", "f2"], "left").select("f1", "f2", "p1", "p2", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"), leaf.alias("n_leaves"))
    sums = subtree_sums(narrow, own.agg(F.max("depth")).first()[0] or 0, ["saved_tokens", "n_leaves"]).drop("p1", "p2")
    summed = (own.join(children, ["f1", "f2"], "left").join(parents, ["p1", "p2"], "left").join(sums, ["f1", "f2"]).join(_ended(local), ["f1", "f2"], "left")
              .withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))}))
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return summed.select(named("first").alias("conv_id"), "depth", named("_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
