"""Quality, dedup, packing, sharding and mixing against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from corpus import documents, empty, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftline.llm import dedup, mixing, packing, quality, sharding

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def text_of(r):
    return (r[1] or "").encode()


def shingle_sets():
    out = defaultdict(list)
    for r in rows():
        w = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text_of(r))
        w = WORD.findall(w)
        out[r[0]].append(frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k:k + 5]) for k in range(len(w) - 4))))
    return out


def test_dedup_equals_all_pairs(spark):
    sets = shingle_sets()
    sets.pop(None)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                s, t = sets[a][0], sets[b][0]
                if s and t and 100 * len(s & t) >= 85 * len(s | t):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in dedup.near_duplicates(documents(spark)).collect()}
    assert len(got) == len(sets) + 1
    for i in ids:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i][0]), find(i), find(i) == i)
    assert find(211) == find(308) == 200 and got[400]["n_shingles"] == 0 and got[400]["kept"]
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60, 5_000):
        assert len(dedup.sketch(rng.integers(0, 1 << 62, n).astype(np.uint64))) == dedup.SIZE
    a = rng.integers(0, 1 << 62, 1_000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    assert abs((dedup.sketch(np.sort(a)) == dedup.sketch(np.sort(b))).mean() - 900 / 1100) < 0.12


def test_long_chain_and_split_groups_keep_every_link(spark, monkeypatch):
    """Neighbours in a chain are linked, ends are not; a band's smallest member meets only some of them."""
    monkeypatch.setattr(dedup, "PER_GROUP", 3)
    base = [f"c{k}" for k in range(300)]
    docs, w = [], list(base)
    for i in range(40):
        docs.append((i, " ".join(w)))
        w[(i * 7) % 300] = f"x{i}"
    got = dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 60)] + [(500, 501)]
    got = {r["node"]: r["root"] for r in dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[k] == 1 for k in range(1, 60)) and got[501] == 500


def test_keep_first_leaves_one_of_each(spark):
    kept = dedup.keep_first(documents(spark))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == documents(spark).columns
    assert len(ids) == len(set(ids)) and 200 in ids and not {201, 300, 308, 404} & set(ids) and {400, 401, 402, 403, None} <= set(ids)


def test_dedup_of_nothing(spark):
    assert dedup.near_duplicates(empty(spark)).count() == 0 == dedup.keep_first(empty(spark)).count()


FILES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SPECIAL = packing.special_ids(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_round_trip(spark):
    marked = "a <|endoftext|> mark<|endoftext|>\n\n in a text"
    docs = documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text")
    docs = docs.unionAll(spark.createDataFrame([(600, marked)], "doc_id long, text string"))
    got = packing.pack(packing.tokenize(docs, *FILES, special=SPECIAL)).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r[0]: r[1] or "" for r in rows()} | {600: marked}
    for i, g in got.sort_values("piece").groupby("doc_id"):
        ids = np.array(tok.encode(texts[i], add_special_tokens=False).ids + [2], "<u4")
        assert g["length"].sum() == len(ids) and (g["length"].iloc[1:] == 1024).all() and (len(g) == 1) == (len(ids) <= 1024)
        for r in g.itertuples():
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert set(got["doc_id"]) == set(texts) - {None}
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id")["length"].cumsum() - g["length"] == g["offset"]).all()
    assert g.groupby("sequence_id")["length"].sum().max() <= 1024
    assert g["sequence_id"].nunique() <= 1.05 * -(-g["length"].sum() // 1024) + 1


def test_repeated_rows_are_packed_each(spark):
    docs = documents(spark).where("doc_id = 5 OR doc_id IS NULL")
    got = packing.pack(packing.tokenize(docs, *FILES)).toPandas()
    assert len(got) == 4 and not got.duplicated(["sequence_id", "offset"]).any()
    assert packing.pack(packing.tokenize(empty(spark), *FILES)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice([rng.integers(1, 1025), *rng.integers(1, 1025, 60), 1024, 1, 512, 341, 342], 5_000)
    plan = packing.plan(Counter(lengths.tolist()), 1024)
    used = defaultdict(list)
    for n, c in Counter(lengths.tolist()).items():
        p = plan[plan["length"] == n].sort_values("rank")
        ends = [*p["rank"].iloc[1:], c]
        assert p["rank"].iloc[0] == 0
        for r, e in zip(p.itertuples(), ends):
            for k in range(r.rank, e):
                used[r.bin + k - r.rank].append((r.offset, n))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024 and sum(3 * n > 1024 for _, n in parts) <= 2
    assert sum(map(len, used.values())) == len(lengths)


def test_words_apart_give_the_tokenizers_ids():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.tokenizer(*FILES, SPECIAL)
    for t in ["<|endoftext|>", "a<|endoftext|> b", " <|endoftext|><|endoftext|>  ", "<|endoftext", "", "a", " a", "a ", "a  b", "It's  a\n\nb\n c\t d", "x y", "\x1c z", "<|endoftext|>", "don't DON'T\nwe'll", "é ñ 中文 12a_b--c", "a\0b", "\n", "q\r\nr", "end.\nStart, now"]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_sharding_law(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 10)
    got = sharding.shard(documents(spark), 6).toPandas()  # one text is as large as all others together
    want = sorted((len(text_of(r)) + 8, zlib.crc32(text_of(r))) for r in rows())
    assert sorted(zip(got["size"], got["text_crc32"])) == want
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 6 and by.max() == got["size"].max() and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    rest = by.drop(by.idxmax())
    assert rest.max() - rest.min() <= got["size"].nlargest(2).iloc[-1]


def test_sharding_ends_with_one_text_among_many_short_ones(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = docs.unionAll(spark.createDataFrame([(-1, "x" * 1_000_000)], "doc_id long, text string"))
    got = sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("s"), F.count("slot").alias("n"), F.max("slot").alias("m")).toPandas()
    assert len(got) == 24 and got["n"].sum() == 30_001 and (got["m"] == got["n"] - 1).all()
    rest = got[got["s"] < 900_000]["s"]
    assert len(rest) == 23 and rest.max() - rest.min() <= 40


def test_equal_texts_share_a_shard_unless_one_ends_among_them(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 10)
    docs = spark.createDataFrame([(i, "t" * (i // 2 % 7) + f" {i // 2}") for i in range(800)], "doc_id long, text string")
    got = sharding.shard(docs, 6).toPandas()
    by = got.groupby("shard")["size"].sum()
    assert len(got) == 800 and len(by) == 6 and by.max() - by.min() <= got["size"].max()
    assert (got.groupby(got["doc_id"] // 2)["shard"].nunique() > 1).sum() <= 5


def test_overfull_ranges_are_cut_again(spark, monkeypatch):
    """Equal texts with equal ids: only the staged number tells them apart."""
    monkeypatch.setattr(sharding, "LEAST_RANGES", 30)
    docs = spark.range(3_000).select(F.lit(1).alias("doc_id"), F.lit("same text in each row").alias("text"))
    got = sharding.shard(docs, 24).toPandas()
    by = got.groupby("shard")["slot"].count()
    assert len(got) == 3_000 and len(by) == 24 and by.max() - by.min() <= 2
    assert sharding.shard(empty(spark)).count() == 0
    assert sharding.shard(documents(spark).where("doc_id IN (400, 401)")).count() == 2


def test_locate_is_a_composite_search():
    rng = np.random.default_rng(0)
    cuts = sorted(set(map(tuple, rng.integers(0, 5, (40, 3)).tolist())))
    keys = rng.integers(0, 5, (300, 3))
    got = sharding.locate([keys[:, k] for k in range(3)], [np.array([c[k] for c in cuts]) for k in range(3)])
    assert got.tolist() == [sum(c <= tuple(k) for c in cuts) for k in keys.tolist()]


def water_fill(size):
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, free, out = float(sum(size.values())), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * size[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 3 * size[s]
            left -= out[s]
            free.remove(s)
    return out


def test_mix_meets_its_targets(spark):
    got = mixing.mix(documents(spark)).toPandas()
    key = {i: r[3] for r in rows() for i in [r[0]]}
    size = Counter()
    for r in rows():
        size[r[3]] += len(WORD.findall(text_of(r)))
    want = water_fill(size)
    got["source"] = [key[None if np.isnan(i) else int(i)] for i in got["doc_id"].astype(float)]
    assert len(got) == len(rows()) and (got["taken"] <= 3 * got["size"]).all()
    for s in size:
        g = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert g["target"].iloc[0] == pytest.approx(want[s]) and g["source_size"].iloc[0] == size[s]
        assert abs(g["taken"].sum() - want[s]) <= 1
    again = mixing.mix(documents(spark).repartition(7)).toPandas()
    assert sorted(zip(got["size"], got["taken"])) == sorted(zip(again["size"], again["taken"]))


def test_mix_caps_and_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, " ".join("c" * 1) * 1 + " d" * 5_000, "y"), (3, None, "z")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert got[1]["taken"] == 6 and got[2]["taken"] == 4_997 and got[3]["taken"] == 0 and got[3]["target"] == 0
    assert mixing.mix(empty(spark)).count() == 0 == mixing.repeat(empty(spark)).count()
    assert Counter(r["doc_id"] for r in mixing.repeat(docs).collect()) == {1: 3, 2: 1, 3: 1}


def test_schedule_is_spread_and_ranked(spark):
    plan = mixing.targets(spark.createDataFrame([("a", 40_000), ("b", 40_000), (None, 40_000)], "source string, source_size long")).withColumn(
        "need", mixing._blocks(F.col("quota"), F.col("source_size"), 32))
    s = mixing.schedule(plan, 120_000, 32, span=100).where("slot IS NOT NULL").toPandas()
    for source, g in s.groupby("source", dropna=False):
        g = g.sort_values("slot")
        assert g["rank"].tolist() == list(range(len(g)))
        assert g["slot"].diff().max() <= 8 * 3_750 / len(g)


def test_quality_learns_and_scores_everything(spark):
    good = [(i, " ".join(np.random.default_rng(i).choice(["the", "of", "river", "stone", "light", "walks", "under"], 60)), i) for i in range(300)]
    bad = [(1_000 + i, " ".join(np.random.default_rng(i).choice(["buy", "now", "|", "click", "win", "$$$", "free"], 60)), i) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(9_000, None), (9_001, ""), (None, "river stone")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1_000), 0) for i, _, _ in good + bad] + [(1, None, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, F.col("doc_id") % 3 != 1)
    got = quality.score(docs, model).toPandas()
    held = got[got["doc_id"] % 3 == 1]
    assert len(got) == 603 and got["score"].between(0, 1).all()
    assert ((held["score"] >= 0.5) == (held["doc_id"] < 1_000)).mean() > 0.97
    kept = quality.keep_good(docs.withColumn("score", F.lit("clash")), model)
    assert kept.columns == ["doc_id", "text", "score"] and kept.where("doc_id >= 1000 AND doc_id < 9000").count() < 20


def test_quality_sample_outlasts_a_long_text(spark):
    """The first text by hash of either class is longer than the class's bytes; the others still make both parts."""
    first = {y: spark.range(40 * y, 40 * y + 40).orderBy(F.xxhash64("id"), "id").first()["id"] for y in (0, 1)}
    kinds = ["buy now | click win $$$ free".split(), "the of river stone light walks under".split()]
    draw = lambda y, i: " ".join(np.random.default_rng(i).choice(kinds[y], 60_000 if i in first.values() else 60))
    docs = spark.createDataFrame([(40 * y + i, draw(y, 40 * y + i)) for y in (0, 1) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i // 40) for i in range(80)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True), bytes_per_class=256 << 10)
    got = quality.score(docs, model).toPandas()
    assert model.good and model.bad and ((got["score"] >= 0.5) == (got["doc_id"] >= 40)).mean() > 0.95
    text = spark.createDataFrame([(1, bytes(range(256)) * 64)], "_id long, _b binary")
    part = text.select(quality._sampled(3 * quality.BLOCK).alias("b"), quality._sampled(1 << 14).alias("whole")).first()
    assert [len(b) for b in part["b"]] == [quality.BLOCK] * 3 and b"".join(part["whole"]) == bytes(range(256)) * 64


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(documents(spark), quality.fit(documents(spark), labels, F.lit(True))).toPandas()
    assert len(got) == len(rows()) and (got["score"] == 0.5).all()
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(documents(spark), quality.fit(documents(spark), one, F.lit(True))).where("score < 0.9").count() == 0
    assert quality.score(empty(spark), quality.CompressionModel()).count() == 0


def test_intersections_of_all_pairs():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9_000, n).astype(np.uint64)) for n in (0, 1, 50, 800, 6_000, 8_000)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = dedup.shared_counts(sets)
    for i, s in enumerate(sets):
        got[i, i] = len(s)
    assert (got == want).all()


def test_copies_of_one_text_that_only_it_links(spark):
    """Copies are linked with their text and not with each other; the text's id is the largest, so stars miss most links."""
    base = [f"c{k}" for k in range(300)]
    docs = []
    for i in range(60):
        w = list(base)
        for k in range(4):
            w[(i * 5 + 71 * k) % 300] = f"x{i}.{k}"
        docs.append((i, " ".join(w)))
    docs.append((1_000, " ".join(base)))
    got = dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}
