"""The pipeline, stage by stage on its own inputs, and the quality score, against plain Python."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from driftline.llm import quality, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus():
    r = random.Random(12)
    prose = [f"word{i}" for i in range(300)]
    junk = [f"x{i}#" for i in range(40)]
    out = []
    for i in range(260):
        bad = i % 5 == 4
        text = " ".join(r.choice(junk if bad else prose) for _ in range(r.randrange(20, 220)))
        out.append((i, text, "en", None if i % 13 == 0 else f"s{i % 3}", len(text)))
    for k in range(30):  # copies with a few words changed, some beyond the threshold
        w = out[k * 5][1].split()
        for j in range(1 + k % 6):
            w[(7 * j + k) % len(w)] = f"new{k}{j}"
        out.append((300 + k, " ".join(w), "en", "s1", 1))
    out += [(400, out[0][1], "en", "s2", 1), (401, None, "en", "s1", None), (402, "", None, "s0", 0), (403, " \n ", "en", "s0", 3), (404, "word1 word2", "en", "s0", 11), (405, "<|endoftext|> word3", "en", "s0", 5),
            (406, " ".join(r.choice(prose) for _ in range(6_000)), "en", "s2", 9)]
    return out


def labels():
    rows = [(i, 0 if i % 5 == 4 else 1, 0) for i in range(0, 260, 2)] + [(i, 0 if i % 5 == 4 else 1, 0) for i in range(1, 260, 6)]
    return rows + [(0, 0, 0), (3, None, 0), (8, 7, 0), (9_999, 1, 0)]  # 0 is labelled twice, the last has no document


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels(), "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The rows of documents and of each stage's result."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
    return out


def sizes(data, dictionary):
    c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
    return sum(len(c.compress(data[i:i + 2_048])) for i in range(0, len(data), 2_048))


def features(text, good, bad):
    data = (text or "").encode()
    if not data:
        return [0.0, 0.0, 0.0]
    g, b = sizes(data, good), sizes(data, bad)
    return [(b - g) / (b + g), (b + g) / 2 / len(data), math.log1p(len(data))]


def learned():
    """Texts of the dictionaries and of the calibration by class, from the labelled rows alone."""
    texts = {r[0]: r[1] for r in corpus()}
    best = {}
    for i, q, _ in labels():
        if q in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1:
            best[i] = max(best.get(i, 0), q)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    of = {}
    for y in (0, 1):
        ids = sorted((i for i, q in best.items() if q == y), key=lambda i: (signed(xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)), i))
        ids = [i for i in ids if texts.get(i)]
        of[y] = [texts[i] for i in ids[1::2]], [texts[i] for i in ids[::2]]
    return of, sum(best.values()) / len(best)


def test_quality_model_and_scores(spark, folder, stages):
    of, prior = learned()
    blocks = lambda ts: [t.encode()[i:i + 2_048] for t in ts for i in range(0, len(t.encode()), 2_048)]

    def dictionary(ts):
        try:
            return zstandard.train_dictionary(256 * 1024, blocks(ts), k=64, d=8, level=3).as_bytes()
        except zstandard.ZstdError:
            return b"".join(blocks(ts))[:256 * 1024]

    good, bad = dictionary(of[1][0]), dictionary(of[0][0])
    model = queries.quality_model(spark, folder)
    assert (model.good, model.bad) == (good, bad)
    # the weights are where the penalised likelihood of the calibration rows has no slope
    x = np.array([features(t, good, bad) for y in (0, 1) for t in of[y][1]])
    y = np.repeat([0.0, 1.0], [len(of[0][1]), len(of[1][1])])
    w = np.array(model.weights)
    w[0] -= math.log(prior / (1 - prior)) - math.log(y.mean() / (1 - y.mean()))
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    std = np.maximum(x.std(0), 1e-6)
    assert abs((y - p).sum()) < 1e-5 and np.allclose(((x - x.mean(0)) / std).T @ (y - p), 1e-3 * len(x) * w[1:] * std, atol=1e-5)
    w[0] = model.weights[0]
    want = {}
    for i, t, *_ in corpus():
        z = w[0] + float(np.dot(w[1:], features(t, good, bad)))
        want[i] = 1 / (1 + math.exp(-z))
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.read.parquet(f"{folder}/documents.parquet"), model).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
    assert sorted(r["doc_id"] for r in stages[1]) == sorted(i for i in want if want[i] >= 0.5)
    assert 30 < len(stages[0]) - len(stages[1]) < 90


def shingles(text):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k:k + 5]) for k in range(len(w) - 4)))


def test_one_of_each_group_of_near_copies_stays(stages):
    docs = {r["doc_id"]: shingles(r["text"]) for r in stages[1]}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and docs[a] and docs[b] and 100 * len(docs[a] & docs[b]) >= 80 * len(docs[a] | docs[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert len(set(map(find, docs))) < len(docs)
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(set(map(find, docs)))


def targets(size):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, free, out = float(sum(size.values())), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * size[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 3.0 * size[s]
            free.remove(s)
            left -= out[s]
    return out


def test_mix_takes_each_row_as_often_as_its_stream_says(stages):
    words = lambda r: len(WORD.findall((r["text"] or "").encode()))
    of = defaultdict(list)
    for r in stages[2]:
        of[r["source"]].append(r)
    size = {s: sum(map(words, rows)) for s, rows in of.items()}
    goal, want = targets(size), Counter()
    for s, rows in of.items():
        at, quota = 0, round(goal[s])
        for r in sorted(rows, key=lambda r: (hashlib.md5(f"mix{r['doc_id']}".encode()).hexdigest(), words(r))):
            n = words(r)
            taken = sum(max(0, min(n, quota - at - e * size[s])) for e in range(4))
            want[r["doc_id"]] = math.floor(taken / n + 0.5) if n else 1
            at += n
    got = Counter(r["doc_id"] for r in stages[3])
    assert got == +want
    by = {r["doc_id"]: r for r in stages[2]}
    assert all(r.asDict() == by[r["doc_id"]].asDict() for r in stages[3])


def test_all_rows_are_packed(stages):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in stages[3]:
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want.update((r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in stages[4]) == want
    used = defaultdict(list)
    for r in stages[4]:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in stages[4])
    assert len(used) <= 1.1 * -(-total // 1024) + 1


def test_run_chains_the_stages(spark, folder, stages):
    got = Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in stages[4])
