"""WARC, vectors, chat, language model and the pipeline."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from corpus import documents, empty, rows, words
from pyspark.sql import functions as F

import corpus_pipeline
from driftline.core.stage import ensure_checkpoint_dir
from driftline.llm import ann, chat, dedup, lm, topk, warc

FILES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pages(spark):
    same, short = "<p>" + "x" * 200, "<p>hi"
    out = [(i, f"http://www.Host{i % 3}.example.org:80/a/{i % 7}?q={i}#f", f"<html>{i}\r\n\r\nWARC/1.1\r\n" + "y" * (i * 37 % 500)) for i in range(80)]
    out += [(100 + i, "https://hot.example.net/", same) for i in range(30)] + [(200 + i, None, short) for i in range(4)]
    out += [(300, "http://x/\r\nEvil: 1", None), (301, "", ""), (None, "http://n/", same), (302, "http://[bad", "é" * 90_000), (302, "http://[bad", "é" * 90_000)]
    return spark.createDataFrame(out, "page_id long, url string, html string").withColumn("value", F.lit("clash"))


def merged(spark, name, frame, **kw):
    folder = f"{ensure_checkpoint_dir(spark)}/{name}"
    warc.write_archives(frame, folder, 1_000_000)
    return warc.merge_runs(warc.local_runs(spark.read.format("binaryFile").load(folder)), **kw).toPandas()


def test_warc_round_trip(spark):
    got = merged(spark, "warc-a", pages(spark), rows_per_range=11)
    want = pages(spark).toPandas()
    assert len(got) == len(want)
    data = [(h or "").encode() for h in want["html"]]
    assert sorted(got["payload_digest"]) == sorted(hashlib.sha256(d).hexdigest() for d in data)
    revisits = got[got["record_type"] == "revisit"]
    assert len(revisits) == 30 and set(revisits["refers_to"]) == {"<urn:page:100>"} and "<urn:page:100>" not in set(revisits["record_id"])
    assert got["archive"].nunique() > 1
    order = got.sort_values(["range", "place"])
    keys = list(zip(order["url_key"], order["captured"], order["record_id"]))
    assert keys == sorted(keys)
    assert got[got["url_key"] == "net,example,hot)/"]["range"].nunique() > 1


def test_url_keys():
    assert warc.url_key("HTTP://www.Example.com:8080/B?x=1#y") == "com,example)/b?x=1" and warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


@pytest.mark.parametrize("k", [1, 2, 3, 7, 16])
def test_loser_tree_merges(k):
    rng = np.random.default_rng(k)
    runs = [sorted(rng.integers(0, 20, rng.integers(0, 30)).tolist()) for _ in range(k)]
    got = [runs[r][i] for r, i in warc.LoserTree(runs)]
    assert got == sorted(x for r in runs for x in r)


def test_warc_of_nothing(spark):
    assert merged(spark, "warc-b", pages(spark).limit(0)).empty


def vectors(spark, n=700, copies=200):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 8))
    out = [(i, v.tolist()) for i, v in enumerate(x)]
    out += [(10_000 + i, x[50].tolist()) for i in range(copies)]
    out += [(20_000, None), (20_001, [0.0] * 8), (20_002, [1.0, None] + [0.0] * 6), (20_003, [float("nan")] * 8), (20_004, [float("inf")] + [0.0] * 7), (None, x[3].tolist()), (7, x[7].tolist())]
    return spark.createDataFrame(out, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")), out


def test_topk_is_exact(spark):
    frame, raw = vectors(spark)
    v, ok = topk.scaled("embedding")
    r = frame.where(ok).select("vec_id", v.alias("v"))
    got = topk.search(r, r.where("vec_id % 50 = 0"), per_block=60, per_query_block=7).toPandas()
    live = {i: np.floor(256 * np.array(x)).astype(int) for i, x in raw if i is not None and x and None not in x and np.isfinite(x).all()}
    assert 20_001 in live
    for q in [i for i in live if i % 50 == 0]:
        want = sorted(((-int(live[q] @ live[c]), c) for c in live if c != q))[:5]
        g = got[got["query_id"] == q].sort_values("rank")
        assert list(zip(-g["score"], g["vec_id"])) == want and g["rank"].tolist() == [1, 2, 3, 4, 5]


def test_topk_few_and_none(spark):
    r = spark.createDataFrame([(50, [1, -2]), (3, [4, 4]), (4, [-1, -1])], "vec_id long, v array<long>")
    got = topk.search(r, r.where("vec_id = 50")).orderBy("rank").collect()
    assert [(x["vec_id"], x["score"]) for x in got] == [(4, 1), (3, -4)]
    assert topk.search(r.limit(0), r.limit(0)).count() == 0


def test_topk_keeps_large_finite_vectors(spark):
    raw = [(50, [3e6, 1.0]), (1, [2e6, -1.0]), (2, [-2e6, 0.5]), (3, [0.25, 1e200]), (4, [0.0, 2.0]), (5, [float("inf"), 0.0])]
    frame = spark.createDataFrame(raw, "vec_id long, embedding array<double>")
    v, ok = topk.scaled("embedding")
    r = frame.where(ok).select("vec_id", v.alias("v"))
    few = r.where("vec_id <> 3")
    got = topk.search(few, few.where("vec_id = 50")).orderBy("rank").collect()
    assert [(x["vec_id"], x["score"]) for x in got] == [(1, 65536 * 6 * 10 ** 12 - 65536), (4, 131072), (2, -65536 * 6 * 10 ** 12 + 32768)]
    assert r.count() == 5
    with pytest.raises(Exception, match="does not fit a long"):
        topk.search(r, r.where("vec_id = 50")).collect()


def test_large_scores_are_exact():
    rng = np.random.default_rng(2)
    q, c = np.floor(rng.normal(size=(9, 128)) * 2.0 ** 29), np.floor(rng.normal(size=(11, 128)) * 2.0 ** 29)
    c[0] = q[0] * 16  # beyond a long
    c[1], c[2, :2], q[1, :2] = -c[0], [2.0 ** 70, -2.0 ** 70], 2.0 ** 20  # terms beyond a long that cancel
    want = [[min(max(sum(int(a) * int(b) for a, b in zip(x, y)), -topk.LARGEST), topk.LARGEST) for y in c] for x in q]
    assert topk._large(q, c).tolist() == want and want[0][0] == topk.LARGEST == -want[0][1] and abs(want[1][2]) < topk.LARGEST
    assert topk._large(q.astype(np.int64), c[3:].astype(np.int64)).tolist() == [w[3:] for w in want]
    assert sum(topk._partials(q, c, 2)).tolist() == want


def test_ann_recall_and_scores(spark):
    frame, raw = vectors(spark)
    r = frame.where(ann.usable("embedding")).select("vec_id", F.col("embedding").alias("v"))
    got = ann.search(r, r.where("vec_id % 50 = 0"), parts_per_root=0.6, per_block=40, most_queries=3).toPandas()
    live = {i: np.array(x) for i, x in raw if i is not None and x and None not in x and np.isfinite(x).all() and np.any(x)}
    hit = total = 0
    for q in [i for i in live if i % 50 == 0]:
        score = {c: live[q] @ live[c] / np.sqrt((live[q] @ live[q]) * (live[c] @ live[c])) for c in live if c != q}
        want = sorted(score, key=lambda c: (-round(score[c], 12), c))[:5]
        g = got[got["query_id"] == q].sort_values("rank")
        assert len(g) == 5 and all(abs(score[c] - s) < 1e-12 for c, s in zip(g["vec_id"], g["score"]))
        hit += len(set(want) & set(g["vec_id"]))
        total += 5
    assert hit / total >= 0.9
    assert ann.search(r.limit(0), r.limit(0)).count() == 0


def test_cosine_of_huge_and_tiny_vectors():
    a, b = np.array([3.0, -4.0, 1.5]), np.array([[1.0, 2.0, -2.5], [3.0, -4.0, 1.5]])
    plain = (a * b).sum(1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(1)))
    assert ann.cosine(a, b).tolist() == plain.tolist()
    for u, v in ((1e160, 1.0), (1e-170, 1e200), (1e308 / 4, 1e-300)):
        assert np.allclose(ann.cosine(a * u, b * v), plain, rtol=1e-13)


def test_small_tables_are_partitioned_too(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(25, 32))
    x = centres[np.arange(500) % 25] + 0.4 * rng.normal(size=(500, 32))
    router = ann.fit(x, int(0.36 * 500 ** 0.5), 5)
    assert router.b2.shape == (8,) and router.probes < 8
    r = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, v array<double>")
    got = ann.search(r, r.where("vec_id % 50 = 0")).toPandas().groupby("query_id")["vec_id"].apply(set)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = sum(len(set(np.argsort(-np.where(np.arange(500) == q, -9, unit @ unit[q]))[:5]) & got[q]) for q in range(0, 500, 50))
    assert hit >= 45


def test_parts_are_balanced():
    x = ann.unit(np.random.default_rng(0).normal(size=(640, 8)))
    part = ann.balanced_parts(x, ann.neighbour_graph(x, 8), 8)
    size = np.bincount(part, minlength=8)
    near = ann.neighbour_graph(x, 8)
    assert size.min() >= 70 and size.max() <= 90 and (part[near] == part[:, None]).mean() > 1.5 / 8


def conversations(spark):
    out = []
    for c in range(60):
        out += [(c, 0, "system" if c % 3 else "user", "hot first turn" if c < 40 else f"own {c}"), (c, 1, "user", f"[INST] \\ </s> <s>[INST:x] é {c % 4}"), (c, 2, "assistant", words(c % 5, 30))]
        out += [(c, 3 + k, "user" if k % 2 else "assistant", words(c * 10 + k, 5)) for k in range(c % 4)]
    out += [(100, None, None, None), (100, 5, "assistant", None), (101, 1, "assistant", "tie"), (101, 1, "assistant", "tie"), (101, 1, "a]\\role<", "x"), (None, 1, "user", "no id"), (102, 0, "user", words(1, 9_000))]
    return spark.createDataFrame(out, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("clash")), out


def test_chat_reads_back(spark):
    frame, raw = conversations(spark)
    trees = chat.format_trees(frame, *FILES, max_tokens=2_000, max_conversations=9)
    got = {r["conv_id"]: r for r in chat.read_back(trees, *FILES).collect()}
    by = {}
    for c, t, r, x in raw:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["formatted_chars"] == sum(len(chat.OPEN + chat.escape(r) + chat.MID + chat.escape(x) + chat.CLOSE) for r, x in turns)
    assert chat.format_trees(frame.limit(0), *FILES).count() == 0


def test_shared_turns_are_emitted_once(spark):
    frame, raw = conversations(spark)
    rows_ = chat.format_trees(frame.where("conv_id < 40").coalesce(1), *FILES, max_tokens=1 << 20).collect()
    tok = chat.tokenizer(*FILES)
    text = "".join(tok.bpe.decode_bytes(r["ids"]).decode() for r in rows_)
    assert text.count("hot first turn") <= 2 * len(rows_)
    for r in rows_:
        for k, parent in enumerate(r["parent"]):
            assert r["position"][k] == (0 if parent < 0 else r["position"][parent] + r["length"][parent])
            spans = list(zip(r["attends"][k][::2], r["attends"][k][1::2]))
            assert sum(b - a for a, b in spans) == r["position"][k] and all(b <= r["start"][k] for _, b in spans)


def test_escape_is_reversible():
    for s in ["", "\\", "<\\", "[[\\\\", "</s>[INST] ok [/INST]", "]\\<s>[INST:", "a\\nb"]:
        e = chat.escape(s)
        assert chat.unescape(e) == s and "</s>" not in e and "<s>" not in e and "[INST" not in e


def test_lm_counts_and_probabilities(spark):
    docs = documents(spark)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    got = lm.score(docs, train, sample=40, frequent=100).toPandas()
    seen, n_docs = Counter(), 0
    for r in rows():
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10:
            seen.update((r[1] or "").encode().lower().split())
            n_docs += 1
    N, V = sum(seen.values()) + n_docs, len(seen) + 1
    texts = {r[0]: (r[1] or "").encode().lower().split() for r in rows()}
    for r in got.itertuples():
        w = texts[None if pd.isna(r.doc_id) else int(r.doc_id)]
        base = sum(np.log10((c + 0.1) / (N + 0.1 * (V + 1))) for c in [seen[x] for x in w] + [n_docs])
        assert r.n_tokens == len(w) + 1 and r.n_known == sum(x in seen for x in w) + 1 and r.train_tokens == N and r.base_score == pytest.approx(base)
        assert r.score < 0 and r.bits_per_byte > 0
    assert len(got) == len(rows())
    none = lm.score(docs.limit(3), F.lit(False)).toPandas()
    assert (none["n_known"] == 0).all() and (none["train_tokens"] == 0).all()
    assert lm.score(empty(spark), train).count() == 0


def test_lm_beats_word_frequencies_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    got = lm.score(docs, rest != 0).join(docs.select("doc_id", rest.alias("rest")), "doc_id").where("rest = 0").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.95 * got[1]


def test_lm_learns_from_every_training_text(spark):
    """Nothing comes of a sample: its size does not matter, and bytes of all words count once each."""
    docs = spark.createDataFrame([(i, "zq" * (i % 5) + f" w{i % 7} the end" + " kx" * (i == 59)) for i in range(60)], "doc_id long, text string")
    a, b = (lm.score(docs, F.col("doc_id") % 10 != 0, sample=k, frequent=4).orderBy("doc_id").toPandas() for k in (1, 50))
    assert (a["score"] == b["score"]).all() and len(a) == 60
    seen = Counter(b"".join(r.text.lower().encode() for r in docs.collect()).replace(b" ", b""))
    counted = lm.count_words(docs.select(F.col("text").cast("binary").alias("b")).repartition(3)).where("byte IS NOT NULL").collect()
    assert {r.byte: r.n for r in counted} == dict(seen)


def test_lm_weights_follow_every_bit_of_a_text(monkeypatch):
    """Scores equal a reading bit by bit whose weights are corrected after each, to the end of a long text, whatever texts are beside it."""
    rng = np.random.default_rng(3)
    known = np.sort(lm.hashes([b"w%d" % i for i in range(40)]))
    code = (*lm.huffman(rng.integers(1, 500, lm.WORDS + 40)), np.arange(40) < 8)
    model = lm.MixingModel([rng.normal(size=1 << b).astype(np.float16) for b in lm.BITS], code, known, np.full((lm.GATES, lm.K), lm.WEIGHT, np.float32))
    texts = [lm._read(b" ".join(b"w%d" % i if i < 40 else b"r%d" % i for i in rng.integers(0, 48, n)), known, lm.Places(known)) for n in (700, 0, 1, 350, *range(2, 60))]

    def plainly(text):
        s, hashed, _ = lm.contexts([text], code[3])
        w, total = [lm.WEIGHT] * lm.K, 0.0
        for i, x in enumerate(s):
            for e in code[2][code[1][x]:code[1][x] + code[0][x]]:
                at = int(lm.spread(np.array([e], np.uint32))[0])
                st = [float(model.tables[k][(int(hashed[k][i]) ^ at) & ((1 << lm.BITS[k]) - 1)]) for k in range(lm.K)]
                z = min(max((1 if e & 1 else -1) * sum(a * b for a, b in zip(w, st)), -14), 14)
                total -= np.log1p(np.exp(-z))
                miss = (1 if e & 1 else -1) / (1 + np.exp(z))
                w = [a + lm.RATE * miss * b for a, b in zip(w, st)]
        return total

    want = [plainly(t) for t in texts]
    assert model.log_p(texts) == pytest.approx(want, rel=1e-5)
    for few, window, step in ((0, 1 << 10, 16), (1000, 1 << 20, 64)):  # all side by side in small windows, and each by itself
        monkeypatch.setattr(lm, "FEW", few), monkeypatch.setattr(lm, "WINDOW", window), monkeypatch.setattr(lm, "STEP", step)
        assert model.log_p(texts) == pytest.approx(want, rel=1e-5)
    assert model.log_p(texts[:1]) == pytest.approx(want[:1], rel=1e-5)


def test_huffman_and_probabilities_sum_to_one():
    """The code is prefix-free and complete, and the model's probabilities of all next symbols sum to 1."""
    known = np.sort(lm.hashes([b"aa", b"bb", b"cc"]))
    code = (*lm.huffman(np.arange(lm.WORDS + 3) % 7), np.zeros(3, bool))
    assert sum(2.0 ** -n for n in code[0].tolist()) == pytest.approx(1)
    rng = np.random.default_rng(0)
    model = lm.MixingModel([rng.normal(size=1 << b).astype(np.float16) for b in lm.BITS], code, known, np.full((lm.GATES, lm.K), 0.3, np.float32))
    read = lambda t: lm._read(t, known, lm.Places(known))
    text = read(b"aa zz bb")
    p = model.log_p([text])
    both = model.log_p([text, read(b"cc")])
    assert p[0] == pytest.approx(both[0]) and np.isfinite(both).all()
    first = 0.0  # all symbols in the place of the first one
    place = np.arange(-lm.WORDS, 3)
    for s in range(lm.WORDS + 3):
        n, o = int(code[0][s]), int(code[1][s])
        _, hashed, _ = lm.contexts([read(b"")], code[3])
        z = 1.0
        for e in code[2][o:o + n]:
            x = int(lm.spread(np.array([e], np.uint32))[0])
            st = [float(model.tables[k][(int(hashed[k][0]) ^ x) & ((1 << lm.BITS[k]) - 1)]) for k in range(lm.K)]
            q = 1 / (1 + np.exp(-0.3 * sum(st)))
            z *= q if e & 1 else 1 - q
        first += z
    assert first == pytest.approx(1) and len(place) == lm.WORDS + 3


def test_pipeline_stages(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "source mix", "best-fit packing"]
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(got) and not got.duplicated(["sequence_id", "offset"]).any()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), str(tmp_path)).count() == 0, name


def test_pipeline_links_from_a_similarity_of_080(spark):
    """A text, a copy with a similarity of 0.82, and another text."""
    docs = []
    for g in range(25):
        w = [f"g{g}.{k}" for k in range(186)]
        docs.append((10 * g, " ".join(w), 1))
        docs.append((10 * g + 1, " ".join(w[:168] + [f"x{g}.{k}" for k in range(18)]), 1))
        docs.append((10 * g + 2, " ".join(w[:40] + [f"y{g}.{k}" for k in range(146)]), 1))
    frame = spark.createDataFrame(docs, "doc_id long, text string, n int")
    near = dedup.shingles(docs[0][1].encode()), dedup.shingles(docs[1][1].encode())
    both = len(np.intersect1d(*near))
    assert 0.8 <= both / (len(near[0]) + len(near[1]) - both) < 0.85
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()} == {10 * g + k for g in range(25) for k in (0, 2)}
    assert dedup.keep_first(frame).count() == 75
    assert (dedup.law(85), dedup.law(80)) == (dedup.Law(85, 5, 104), dedup.Law(80, 4, 93))
