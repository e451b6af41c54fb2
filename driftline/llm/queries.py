"""Registered queries of the subpackage, each over its whole tables, with SQL where SQL can express the result."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core.stage import ensure_checkpoint_dir, stage
from . import ann, chat, dedup, lm, mixing, packing, periodic, quality, sharding, suffixes, topk, trie, warc
from .common import crc_mod, table, utf8

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def quality_model(spark: SparkSession, sf_dir: str) -> quality.CompressionModel:
    return quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)


@query("op2_compression_quality")
def compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def packed(docs: DataFrame) -> DataFrame:
    """Byte-level BPE ids, packed; the ranks file holds the vocabulary of ``byte_bpe_50k.json``, which also names the special strings."""
    special = packing.special_ids(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(packing.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special))


@query("op3_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


MIX_SQL = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3.0 * source_size AS cap, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS w FROM s),
u AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
             sum(source_size) OVER () AS everything FROM w),
v AS (SELECT *, max(CASE WHEN cap / w >= (everything - below) / rest THEN (everything - below) / rest END) OVER () AS lev FROM u),
t AS (SELECT source, source_size, CAST(CASE WHEN everything = 0 THEN 0 ELSE least(cap, lev * w) END AS DOUBLE) AS target,
             CAST(round(CASE WHEN everything = 0 THEN 0 ELSE least(cap, lev * w) END) AS BIGINT) AS quota FROM v),
p AS (SELECT d.*, source_size, target, quota, sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((SELECT sum(greatest(0, least(size, quota - start - e * source_size))) FROM range(4) r(e)) AS BIGINT) AS taken FROM p
"""


@query("op5_source_mix", MIX_SQL)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


NEAR_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
k AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN k ON k.id = d.doc_id
"""


@query("op7_near_duplicates", NEAR_SQL)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), link=85).select("doc_id", "n_shingles", "component_id", "kept")


WARC_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM f
"""


@query("op1_warc_index", WARC_SQL)
def warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives are written, read back into runs, and the runs merged; the rows are those of the merged index."""
    pages = table(spark, sf_dir, "pages")
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    mean = pages.select(F.avg(F.length(utf8("html")))).first()[0]
    warc.write_archives(pages, folder, int(mean or 0) + 512)
    runs = stage(warc.local_runs(spark.read.format("binaryFile").load(folder)))
    merged = warc.merge_runs(runs)
    ident = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    return merged.select(ident("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", ident("refers_to").alias("refers_to"))


@query("op4_sampled_splitters")
def sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op6_learned_partitions")
def learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (table(spark, sf_dir, "embeddings").where(ann.usable("embedding"))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")))
    return ann.search(rows, rows.where("vec_id % 50 = 0"))


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(role, '[^<\[\\\]]', '', 'g')) + length(regexp_replace(text, '[^<\[\\\]]', '', 'g')) + length(role) + length(text)
             + length('<s>[INST:') + 1 + length('</s>') AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op8_prefix_tree_chat", CHAT_SQL)
def prefix_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.createDataFrame([(-1, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    files = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return chat.read_back(stage(chat.format_trees(rows.unionByName(own), *files)), *files)


@query("op9_context_mixing_lm")
def context_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = crc_mod("doc_id", 10)
    scored = lm.score(table(spark, sf_dir, "documents"), rest != 0)
    return scored.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


TOPK_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score,
         CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS INTEGER) AS rank
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
WHERE rank <= 5
"""


@query("op10_uniform_threshold_topk", TOPK_SQL)
def uniform_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, ok = topk.scaled("embedding")
    rows = table(spark, sf_dir, "embeddings").where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return topk.search(rows, rows.where("vec_id % 50 = 0"))


#: crc32 of an id's digits, bit by bit: every digit's byte comes in with the first of its eight steps.
CRC_SQL = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten([[CAST(ord(d) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] for d in string_split(CAST({id} AS VARCHAR), '')])),
      lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END), 4294967295)"""


def _runs_sql(levels: int = 16) -> str:
    """Grams named by ranks, doubled ``levels`` times: enough for documents of up to ``2 ** (levels + 2)`` words."""
    ctes = ["""d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, """ + CRC_SQL.format(id="doc_id") + """ AS h FROM documents)""",
            """p AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS g FROM d)""",
            """o AS (SELECT r, n, i, w[CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // g) ELSE i END + 1] AS word FROM p, LATERAL (SELECT unnest(range(n)) AS i))""",
            """k1 AS (SELECT r, n, i, dense_rank() OVER (ORDER BY r, word) AS c FROM o)"""]
    pair = "SELECT a.r, a.n, a.i, dense_rank() OVER (ORDER BY a.c, b.c) AS c FROM {a} a JOIN {b} b ON a.r = b.r AND b.i = a.i + {m}"
    again = " QUALIFY count(*) OVER (PARTITION BY a.c, b.c) > 1"
    found = []
    for j in range(levels):
        m = 1 << j
        ctes.append(f"k{2 * m} AS MATERIALIZED ({pair.format(a=f'k{m}', b=f'k{m}', m=m)}{again})")
        if j == 1:
            ctes.append(f"s1 AS ({pair.format(a='k4', b='k1', m=4)})")
            found.append(("s1", 1, 5))
        if j:
            ctes.append(f"s{m} AS ({pair.format(a=f'k{2 * m}', b=f'k{m}', m=2 * m)})")
            found.append((f"s{m}", m, 3 * m))
    hits = " UNION ALL ".join(f"(SELECT r, i, {k} AS k, lead(i) OVER (PARTITION BY r, c ORDER BY i) - i AS q FROM {s} QUALIFY q >= {m} AND q < {2 * m})" for s, m, k in found)
    return f"""WITH {', '.join(ctes)}, hits AS ({hits}),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS b FROM hits),
runs AS (SELECT r, q AS period, min(i) AS start, max(i) - min(i) + min(k) + q AS length FROM isl GROUP BY r, q, b HAVING length >= greatest(6, 4 * q)),
best AS (SELECT r, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, p := period), struct_pack(e := -CAST(length AS DOUBLE) / period, s := start, p := period)) AS x,
                sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, sha256(string_agg(word, ' ' ORDER BY i)) AS h FROM o ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(x.s AS BIGINT) AS start, CAST(x.l AS BIGINT) AS length, CAST(x.p AS BIGINT) AS period,
       CAST(1000 * x.l // x.p AS BIGINT) AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(kept.h, sha256('')) AS collapsed_sha256
FROM p LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""


@query("op11_periodic_runs", _runs_sql())
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find_runs(table(spark, sf_dir, "documents"))


TRIE_SQL = """
WITH r AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations),
c AS (SELECT conv_id, count(*) AS own, """ + CRC_SQL.format(id="conv_id") + """ % 6 AS h FROM r GROUP BY conv_id),
b AS (SELECT c.*, least(c.h, coalesce(x.own, 0)) AS taken, c.conv_id - c.conv_id % 100 AS base FROM c LEFT JOIN c x ON x.conv_id = c.conv_id - c.conv_id % 100),
t AS (SELECT b.conv_id, r.pos, r.role, r.text FROM b JOIN r ON r.conv_id = b.base AND r.pos < b.taken
      UNION ALL SELECT r.conv_id, r.pos - b.h + b.taken, r.role, r.text FROM r JOIN b USING (conv_id) WHERE r.pos >= b.h),
m AS (SELECT conv_id, pos + 1 AS depth, length(text) AS chars, sha256(role || chr(0) || text) AS x FROM t),
path AS (SELECT conv_id, depth, chars, sha256(string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS node FROM m
         UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
p AS (SELECT *, lag(node) OVER w AS parent, lead(node) OVER w IS NULL AS last FROM path WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
n AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM p GROUP BY node),
k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
s AS (SELECT v.node, sum((u.n_convs - 1) * u.chars) AS saved, count(*) FILTER (u.n_children = 0) AS leaves
      FROM (SELECT DISTINCT a.node AS v, z.node AS u FROM p a JOIN p z ON a.conv_id = z.conv_id AND z.depth >= a.depth) e JOIN f v ON v.node = e.v JOIN f u ON u.node = e.u GROUP BY v.node)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, par.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (node) LEFT JOIN f par ON par.node = f.parent
"""


@query("op12_conversation_trie", TRIE_SQL)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), F.crc32(F.col("conv").cast("string").cast("binary")) % 6)


@query("op13_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))
