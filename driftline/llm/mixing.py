"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Slot i of the schedule maps the golden-ratio point frac(i / phi) through the cumulative targets to a source. Each source's
documents, in hashed order, form a stream of words that is cut into equal blocks; the r-th slot of a source takes block
r modulo their number, so a source that must repeat goes round its blocks again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.stage import stage
from .common import WORD

#: Points are multiples of 1 / 2**31 with this odd step, 2**31 / phi, so that they are exact for any slot number.
UNIT = 1 << 31
STEP = 1327217885
BINS = 4096


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``source, source_size`` to ``target`` and whole ``quota``: all words shared by weight, capped at ``most`` times the
    source's words, the excess reshared by weight among the others.

    With sources in order of size per weight the capped ones come first, so one pass of running sums finds the level.
    One row per source; null is a source of its own and comes last.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("_w", w.cast("double")).withColumn("_cap", most * F.col("source_size").cast("double"))
    up = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    s = (s.withColumn("_below", F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("_rest", F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("_all", F.sum("source_size").over(Window.partitionBy()).cast("double")))
    level = (F.col("_all") - F.col("_below")) / F.col("_rest")
    s = s.withColumn("_level", F.max(F.when(F.col("_cap") / F.col("_w") >= level, level)).over(Window.partitionBy()))
    target = F.when(F.col("_all") == 0, F.lit(0.0)).otherwise(F.least(F.col("_cap"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("_w")))
    return s.select("source", "source_size", target.alias("target"), F.round(target).cast("long").alias("quota"))


def _blocks(quota: Column, size: Column, block: int) -> Column:
    """Slots that a source needs: whole rounds of its blocks, then as many as the rest asks for."""
    return F.when(size > 0, F.floor(quota / size) * F.ceil(size / block) + F.ceil((quota - F.floor(quota / size) * size) / block)).otherwise(0).cast("long")


def schedule(plan: DataFrame, total: int, block: int, span: int = 65_536) -> DataFrame:
    """``source, rank, slot``: who serves each slot, and which of the source's slots that is.

    Points that a source no longer needs are passed over; what discrepancy leaves short (a few slots per source) is
    appended. Ranks are running counts over spans of slots, so that a source with most slots isn't ranked in one task.
    """
    spark = plan.sparkSession
    n = -(-total // block)
    width = UNIT // BINS
    upto = Window.orderBy(F.col("source").isNull(), "source")
    edges = (plan.where("quota > 0").withColumn("_hi", F.sum("target").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("_all", F.sum("target").over(Window.partitionBy()))
             .withColumn("_to", F.floor(F.col("_hi") / F.col("_all") * UNIT).cast("long"))
             .withColumn("_from", F.coalesce(F.lag("_to").over(upto), F.lit(0)))
             .withColumn("_to", F.when(F.lead("_to").over(upto).isNull(), F.lit(UNIT)).otherwise(F.col("_to")))
             .where("_to > _from")
             .select("source", "need", "_from", "_to", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))).alias("_bin")))
    point = F.pmod(F.pmod(F.col("slot"), F.lit(UNIT)) * F.lit(STEP), F.lit(UNIT))
    slots = (spark.range(n).select(F.col("id").alias("slot")).withColumn("_p", point).withColumn("_bin", F.floor(F.col("_p") / width))
             .join(edges, "_bin").where("_p >= _from AND _p < _to").select("slot", "source", "need", F.floor(F.col("slot") / span).alias("_span")))
    counts = slots.groupBy("source", "_span").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("source", "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_span").orderBy("slot")
    b = base.select(F.col("source").alias("_s"), F.col("_span").alias("_sp"), "_base")
    ranked = (slots.withColumn("_k", F.row_number().over(inside) - 1)
              .join(b, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_span") == F.col("_sp")))
              .withColumn("rank", F.col("_base") + F.col("_k")).where("rank < need").select("source", "rank", "slot"))
    got = counts.groupBy("source").agg(F.sum("_n").alias("_got")).withColumnRenamed("source", "_s")
    short = (plan.where("need > 0").join(got, F.col("source").eqNullSafe(F.col("_s")), "left")
             .withColumn("_got", F.coalesce("_got", F.lit(0))).where("_got < need")
             .select("source", F.explode(F.sequence(F.col("_got"), F.col("need") - 1)).alias("rank"), F.lit(None).cast("long").alias("slot")))
    return ranked.unionByName(short)


def mix(docs: DataFrame, seed: str = "mix", block: int | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        carry: list[Column] | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row, and the columns ``carry`` asks for.

    Null and wordless texts have size 0 and nothing is taken of them; null ids are hashed like others; rows that repeat are
    documents of their own. The block is given, or follows from the corpus: a 400,000th of all words, 32 at least, so the
    schedule's length is bounded and no source is off by more than half a word.
    """
    given = docs.select(*(carry or [])).columns if carry else []
    narrow = stage(docs.select(*(carry or []), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"),
                               F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary")).alias("_h")))
    n, total = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = block or max(32, total // 400_000)
    digits = 3 if n < 20_000_000 else 5
    keyed = narrow.withColumn("_g", F.substring("_h", 1, digits))
    plan = stage(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")))
                 .withColumn("need", _blocks(F.col("quota"), F.col("source_size"), block)))
    sums = keyed.groupBy("source", "_g").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("source").alias("_s"), F.col("_g").alias("_gg"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_g").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, 0)
    p = plan.select(F.col("source").alias("_s2"), "source_size", "target", "quota")
    placed = (keyed.withColumn("_end", F.sum("size").over(inside))
              .join(base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_g") == F.col("_gg")))
              .withColumn("_start", F.col("_base") + F.col("_end") - F.col("size"))
              .join(p, F.col("source").eqNullSafe(F.col("_s2")))
              .select(*given, "doc_id", "source", "size", "source_size", "target", "_start"))
    parts = (placed.where("size > 0")
             .withColumn("_block", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block))))
             .withColumn("_lo", F.greatest(F.col("_start"), F.col("_block") * block))
             .withColumn("_hi", F.least(F.col("_start") + F.col("size"), (F.col("_block") + 1) * block)))
    q = plan.select(F.col("source").alias("_s3"), F.col("quota").alias("_q"), F.col("source_size").alias("_size"))
    served = (schedule(plan, total, block).join(q, F.col("source").eqNullSafe(F.col("_s3")))
              .withColumn("_round", F.floor(F.col("rank") / F.ceil(F.col("_size") / block)))
              .select(F.col("source").alias("_s4"), F.pmod(F.col("rank"), F.ceil(F.col("_size") / block)).alias("_b4"),
                      (F.col("_q") - F.col("_round") * F.col("_size")).alias("_left")))
    # The last round ends within a block; a block that no slot takes has no such end.
    words = F.when(F.col("_left").isNotNull(), F.greatest(F.lit(0), F.least(F.col("_hi"), F.col("_left")) - F.col("_lo"))).otherwise(0)
    taken = (parts.join(served, F.col("source").eqNullSafe(F.col("_s4")) & (F.col("_block") == F.col("_b4")), "left")
             .groupBy(*given, "doc_id", "source", "size", "source_size", "target", "_start").agg(F.sum(words).alias("taken")))
    return (taken.select(*given, "doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
            .unionByName(placed.where("size = 0").select(*given, "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))))


def repeat(docs: DataFrame, **kw) -> DataFrame:
    """The mix as documents: each row as often as ``taken`` holds its size, to the nearest whole number; rows of size 0 once.

    Rows are matched by id, source and text; of rows that agree in all of these each is matched once.
    """
    doc_id, text, source = kw.get("doc_id", "doc_id"), kw.get("text", "text"), kw.get("source", "source")
    key = [F.xxhash64(F.col(doc_id), F.col(source).cast("string")).alias("__key"), F.xxhash64(F.col(text)).alias("__text")]
    named = docs.select("*", *key)
    same = Window.partitionBy("__key", "__text").orderBy("__key")
    named = named.withColumn("__nth", F.row_number().over(same))
    got = mix(docs, carry=[F.xxhash64(F.col(doc_id), F.col(source).cast("string")).alias("__k"), F.xxhash64(F.col(text)).alias("__t")], **kw)
    got = got.withColumn("__n", F.row_number().over(Window.partitionBy("__k", "__t").orderBy("taken")))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int").alias("__times")
    got = got.select("__k", "__t", "__n", times).where("__times > 0")
    return (named.join(got, (F.col("__key") == F.col("__k")) & (F.col("__text") == F.col("__t")) & (F.col("__nth") == F.col("__n")))
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns))
