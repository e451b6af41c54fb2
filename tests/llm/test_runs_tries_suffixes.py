"""Periodic runs, the conversation trie and suffix dedup against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from corpus import documents, empty, rows
from pyspark.sql import functions as F

from driftline.llm import periodic, suffixes, trie

sha = lambda b: hashlib.sha256(b).hexdigest()


def all_runs(w):
    """Every lag's stretches of equal words, kept where no smaller period holds."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - a + q
            if i > a and n >= max(6, 4 * q) and not any(all(w[a + j] == w[a + j + p] for j in range(n - p)) for p in range(1, q)):
                out.append((a, n, q))
            i = max(i, a + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_all_lags():
    r = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(r.randrange(1, 4)):
            w = [r.randrange(r.choice([1, 2, 3, 6])) for _ in range(r.randrange(110))]
            if r.random() < 0.6 and len(w) > 3:
                p, a = r.randrange(1, len(w) // 3 + 2), r.randrange(len(w))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            docs.append(w)
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in docs])]).astype(np.int64)
        code = np.unique([10 * d + x for d, w in enumerate(docs) for x in w], return_inverse=True)[1].astype(np.int64)
        want = [(int(bounds[d]) + a, n, q) for d, w in enumerate(docs) for a, n, q in all_runs(w)]
        assert periodic.runs(code, bounds) == sorted(want, key=lambda x: (x[0], x[2]))


def test_periodic_rows(spark):
    got = defaultdict(list)
    for r in periodic.find_runs(documents(spark)).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    want, planted = defaultdict(list), 0
    for i, text, *_ in rows():
        w = (text or "").encode().split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
            planted += 1
        found = all_runs(w) if len(w) < 1_000 else []
        gone = {k for a, n, q in found for k in range(a + q, a + n)}
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        want[i].append((len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()),
                        sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert planted > 5 and got == want
    assert periodic.find_runs(empty(spark)).collect() == []


def one_trie(convs, borrow):
    own = {c: sorted(t, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, t in convs.items()}
    paths = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if borrow and c is not None else 0
        base = own.get(c - int(math.fmod(c, 100)), []) if c is not None else []
        paths[c] = tuple(x[1:] for x in base[:h] + t[h:])
    key = lambda c: (c is not None, c or 0)
    members = defaultdict(list)
    for c in sorted(paths, key=key):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    out = []
    for p, m in members.items():
        sub = [q for q in members if q[:len(p)] == p]
        ends = [c for c in m if len(paths[c]) == len(p)]
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), sum(not kids[q] for q in sub), sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in sub),
                    sha(",".join("null" if c is None else str(c) for c in ends).encode())))
    return sorted(out, key=repr)


CHAT = "conv_id long, turn long, role string, text string, f1 string, pos string, n string"


@pytest.mark.parametrize("borrow", [True, False])
def test_trie_equals_one_tree(spark, borrow):
    r = random.Random(2)
    convs = defaultdict(list)
    for c in [*range(0, 40), *range(100, 130), None, -7, 205, 5_000]:
        for k in range(r.randrange(1, 9)):
            convs[c].append((k if r.random() < 0.9 else None, r.choice(["user", "assistant"]), r.choice(["hi", "", "yes é", "tell me"])))
    for c in range(40, 60):  # one very common conversation
        convs[c] = [(0, "user", "hi"), (1, "assistant", "yes é")]
    convs[61] = [(k, "user", "on") for k in range(700)]  # over several blocks, twice with another end
    convs[62] = [(k, "user", "on") for k in range(699)] + [(699, "user", "off")]
    rows_ = [(c, t, role or None, text or None, "x", "y", "z") for c, ts in convs.items() for t, role, text in ts]
    r.shuffle(rows_)
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 6 if borrow else None
    got = sorted((tuple(x) for x in trie.prefix_trie(spark.createDataFrame(rows_, CHAT), h).collect()), key=repr)
    assert got == one_trie(convs, borrow)


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CHAT)).collect() == []


def plain_dedup(docs):
    seen, out = set(), []
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 99):
            gone[p:p + 100] |= t[p:p + 100] in seen
            seen.add(t[p:p + 100])
        out.append((i, len(t), int(gone.sum()), int((gone & ~np.concatenate([[False], gone])[:len(t)]).sum()), sha(bytes(np.frombuffer(t, np.uint8)[~gone]))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [4_096, 3])
def test_suffix_dedup_equals_a_set_of_strings(spark, monkeypatch, ranges):
    monkeypatch.setattr(suffixes, "SUFFIXES", 150)
    monkeypatch.setattr(suffixes, "HASHES", 700)
    monkeypatch.setattr(suffixes, "RANGES", ranges)
    r = random.Random(ranges)
    letters = "abcdefgh é\0"
    pool = ["".join(r.choice(letters) for _ in range(r.randrange(60, 400))) for _ in range(12)]
    texts = []
    for _ in range(150):
        parts = [r.choice(pool)[(a := r.randrange(60)):a + r.randrange(50, 400)] if r.random() < 0.5 else "".join(r.choice(letters) for _ in range(r.randrange(150))) for _ in range(r.randrange(7))]
        texts.append("".join(parts))
    texts += ["", None, "a" * 99, "a" * 100, "a" * 5_000, "ab" * 2_000, texts[5], texts[5], pool[0] * 3]
    rows_ = [(i, t, "x", "y") for i, t in enumerate(texts)]
    shuffled = random.Random(1).sample(rows_, len(rows_))
    got = suffixes.remove_repeats(spark.createDataFrame(shuffled, "doc_id long, text string, block string, spans string").repartition(4)).collect()
    assert sorted((tuple(x) for x in got), key=repr) == plain_dedup([(i, (t or "").encode()) for i, t, *_ in rows_])


def test_suffix_dedup_of_repeated_and_missing_ids(spark):
    r = random.Random(3)
    long = "".join(r.choice("abcdefghij ") for _ in range(2_500_000))  # over several slices
    rows_ = [(None, long), (1, long[1_000_000:1_000_300]), (1, long[1_048_500:1_048_700]), (2, "new " + "z" * 20), (2, "new " + "z" * 20)]
    got = sorted((tuple(x)[:4] for x in suffixes.remove_repeats(spark.createDataFrame(rows_, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 2_500_000, 0, 0), (1, 300, 300, 1), (1, 200, 200, 1), (2, 24, 0, 0), (2, 24, 0, 0)], key=repr)
    assert suffixes.remove_repeats(empty(spark)).collect() == []


def test_multikey_sort():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 300):
        x = rng.integers(0, 3, (n, 29)).astype(np.uint8)
        x[: n // 2, 5:] = 1
        order, shared = suffixes.multikey_sort(x)
        want = sorted(range(n), key=lambda i: x[i].tobytes())
        assert [x[i].tobytes() for i in order] == [x[i].tobytes() for i in want]
        for a, b, s in zip(order, order[1:], shared[1:]):
            differ = np.flatnonzero(x[a] != x[b])
            assert s == (differ[0] if len(differ) else 29)
