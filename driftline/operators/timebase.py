"""Time parsing, cadence, gaps, grids and resampling."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..core.facts import with_facts
from ..core.axis import Axis
from ..core.halo import doubles
from ..core.scan import CORE, HALO, IDX, halo_rows, scan
from ..core.stats import median
from ..schema import seconds_between


def steps(df: DataFrame, axis: Axis) -> DataFrame:
    """Rows with ``prev_ts`` and ``step_s``, the seconds since the previous sample of the entity."""
    s = scan(df, axis, prev={"prev_ts": axis.ts})
    return s.withColumn("step_s", seconds_between("prev_ts", axis.ts))


def cadence(df: DataFrame, axis: Axis, method: str = "median") -> DataFrame:
    """Sampling step and rate per entity from positive steps.

    ``median``: rate is one over the median step. ``mean_rounded``: one over the mean step, rounded to whole
    Hz from 1 Hz upward.
    """
    keys = list(axis.keys)
    pos = steps(df.select(*keys, *axis.order), axis).where(F.col("step_s") > 0)
    if method == "median":
        return median(pos, keys, "step_s", "step_s").withColumn("fs_hz", 1.0 / F.col("step_s"))
    if method != "mean_rounded":
        raise ValueError(f"unknown method {method}")
    hz = 1.0 / F.col("step_s")
    return pos.groupBy(*keys).agg(F.avg("step_s").alias("step_s")).withColumn(
        "fs_hz", F.when(hz >= 1, F.round(hz)).otherwise(hz))


# --- parsing -----------------------------------------------------------------------------------------

# At or above this median an epoch number is taken as milliseconds, below as seconds.
EPOCH_MS_FROM = 1e11
DEFAULT_DATE_PATTERN = "MM/dd/yy"
DEFAULT_TIME_PATTERN = "H:mm:ss"
ISO_PATTERN = "yyyy-MM-dd HH:mm:ss"


#: Texts that mean that no layout was declared.
UNDECLARED = {"", "unknown", "nan", "none"}
_TOKEN = re.compile(r"MON|\.[0S]+|([YMDHS])\1*|.", re.S)


def _letters(token: str, before: str, after: str) -> str:
    """Spark's letters for one token of a layout; ``before`` and ``after`` are its neighbours among letter tokens."""
    match token[0], len(token):
        case "Y", n:
            return "yyyy" if n > 2 else "yy"
        case "M", n if token == "MON" or n == 3:
            return "MMM"
        case "M", _:
            return "mm" if before[:1] == "H" or after[:1] == "S" else "MM"
        case "D" | "H" | "S", _:
            return {"D": "dd", "H": "HH", "S": "ss"}[token[0]]
    return token.replace("0", "S") if len(token) > 1 else token  # a fraction


def spark_pattern(unit: str | None) -> str | None:
    """Spark datetime pattern of a declared layout such as ``HH:MM:SS DD-Mon-YYYY``; null when undeclared.

    MM means minutes right after hours or right before seconds, else months.
    """
    text = " ".join((unit or "").split())
    if text.lower() in UNDECLARED:
        return None
    tokens = [m[0] for m in _TOKEN.finditer(text.upper())]
    dated = [k for k, t in enumerate(tokens) if t[0] in "YMDHS"]
    beside = lambda k, step: next((tokens[j] for j in (dated if step > 0 else reversed(dated)) if (j - k) * step > 0), "")
    return "".join(_letters(t, beside(k, -1), beside(k, 1)) for k, t in enumerate(tokens))


def _per_recording(df: DataFrame, keys: list[str] | None, fact: Column) -> DataFrame:
    """Adds an aggregate of each recording, or of all rows when these are one recording."""
    if not keys:
        return with_facts(df, df.agg(fact))
    facts = df.groupBy(*[F.col(k).alias(f"__of_{k}") for k in keys]).agg(fact)
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]
    return df.join(facts, reduce(lambda a, b: a & b, same)).drop(*[f"__of_{k}" for k in keys])


def epoch_to_ts(df: DataFrame, col: str, out: str = "ts", keys: list[str] | None = None) -> DataFrame:
    """Unix numbers to instants; the unit follows from the median magnitude of each recording, which ``keys`` tell apart."""
    num = df.withColumn("__num", F.expr(f"try_cast({col} AS double)"))
    return _per_recording(num, keys, F.when(F.percentile_approx("__num", 0.5) >= EPOCH_MS_FROM, 1e3).otherwise(1e6).alias("__mul")).withColumn(
        out, F.timestamp_micros(F.round(F.col("__num") * F.col("__mul")).cast("bigint"))).drop("__num", "__mul")


def try_patterns(text: Column, patterns: list[str | None]) -> Column:
    """First pattern that parses the text, then Spark's own cast, else null."""
    tries = []
    for p in patterns:
        if p:
            t = F.try_to_timestamp(text, F.lit(p))
            if "yy" in p.replace("yyyy", ""):  # two-digit years from 69 on belong to the last century
                t = F.when(F.year(t) >= 2069, t - F.expr("INTERVAL 100 YEARS")).otherwise(t)
            tries.append(t)
    return F.coalesce(*tries, F.try_to_timestamp(text))


def build_datetime(df: DataFrame, tz: str = "UTC", units: dict[str, str] | None = None, out: str = "ts", keys: list[str] | None = None) -> DataFrame:
    """Make the instant column from whichever time layout the frame has; ``keys`` tell recordings apart, each of which has its
    own epoch unit and sub-second rate.

    Precedence: datetime, datetimenum, datetimenum_utc, datetime_utc, date_utc+time_utc (with the optional
    sub-second counter time_hz), date+time, date_local+time_local. Naive local values are placed in ``tz``.
    """
    units = units or {}
    have = set(df.columns)
    local = lambda c: F.to_utc_timestamp(c, tz)
    if "datetime" in have:
        return df.withColumn(out, local(try_patterns(F.col("datetime").cast("string"), [spark_pattern(units.get("datetime")), ISO_PATTERN])))
    for c in ("datetimenum", "datetimenum_utc"):
        if c in have:
            return epoch_to_ts(df, c, out, keys)
    if "datetime_utc" in have:
        if df.schema["datetime_utc"].dataType.typeName() == "timestamp":
            return df.withColumn(out, F.col("datetime_utc"))
        if df.schema["datetime_utc"].dataType.typeName() in ("double", "float", "long", "integer", "decimal"):
            return epoch_to_ts(df, "datetime_utc", out, keys)
        return df.withColumn(out, try_patterns(F.col("datetime_utc"), [ISO_PATTERN]))
    for d, t, utc in (("date_utc", "time_utc", True), ("date", "time", False), ("date_local", "time_local", False)):
        if d in have and t in have:
            dp = spark_pattern(units.get(d)) or DEFAULT_DATE_PATTERN
            tp = spark_pattern(units.get(t))
            text = F.concat_ws(" ", F.col(d), F.col(t))
            pats = [f"{dp} {p}" for p in (tp, DEFAULT_TIME_PATTERN + ".SSS", DEFAULT_TIME_PATTERN, "h:mm:ss a") if p]
            ts = try_patterns(text, pats)
            ts = ts if utc else local(ts)
            hz = next((c for c in ("time_hz", "time_Hz") if c in have), None) if utc else None
            if hz is None:
                return df.withColumn(out, ts)
            top = F.round(F.max(F.col(hz).cast("double"))).alias("__hz")
            return _per_recording(df, keys, top).withColumn(out, F.when(
                F.col("__hz") > 1, F.timestamp_micros(F.unix_micros(ts) + F.round(
                    (F.col(hz).cast("double") - 1) / F.col("__hz") * 1_000_000).cast("bigint"))).otherwise(ts)).drop("__hz")
    raise ValueError(f"no known time layout among {sorted(have)}")


# --- cadence, gaps, order ----------------------------------------------------------------------------

def find_time_gaps(df: DataFrame, axis: Axis, factor: float = 1.5, min_report_s: float = 0.0) -> DataFrame:
    """Steps longer than ``factor`` nominal intervals (and at least ``min_report_s``), per entity.

    An entity without a cadence has no positive steps and so no gaps.
    """
    keys = list(axis.keys)
    st = steps(df.select(*keys, *axis.order), axis)
    nominal = median(st.where(F.col("step_s") > 0), keys, "step_s", "nominal_s")
    return st.join(nominal, keys, "left").where(
        (F.col("step_s") > 0) & (F.col("step_s") > F.coalesce(F.col("nominal_s") * factor, F.lit(0.0)))
        & (F.col("step_s") >= min_report_s)
    ).select(*keys, F.col("prev_ts").alias("gap_start"), F.col(axis.ts).alias("gap_end"), F.col("step_s").alias("gap_s"), "nominal_s")


def order_check(df: DataFrame, axis: Axis, arrival: list[str]) -> DataFrame:
    """How many rows of each entity step back in time in ``arrival`` order (a unique integer column)."""
    s = scan(df, axis.with_(order=tuple(arrival)), prev={"__p": axis.ts})
    return s.groupBy(*axis.keys).agg(F.count_if(F.col(axis.ts) < F.col("__p")).alias("n_backward"),
                                     F.count(F.lit(1)).alias("n"))


# --- grids -------------------------------------------------------------------------------------------

BLOCK = 65_536


def grid_axis(axis: Axis, bounds: DataFrame, lo: str, hi: str, step_us: int) -> Axis:
    """``axis`` with tasks for the rows of ``grid`` on these bounds, too; one count over the bounds."""
    n = bounds.agg(F.sum(F.greatest(F.lit(0), F.floor((F.unix_micros(hi) - F.unix_micros(lo)) / step_us) + 1))).first()[0]
    return axis.for_rows(int(n or 0))


def grid(bounds: DataFrame, keys: list[str], lo: str, hi: str, step_us: Column | int, out: str = "ts", tasks: int = 0) -> DataFrame:
    """Regular instants ``lo, lo+step, … ≤ hi`` per row of ``bounds``.

    Laid out in blocks that are spread over the tasks before they are filled, so the length of one
    recording bounds neither an array nor a task. The number of tasks is given, ``tasks`` or the session's if that is more, because adaptive
    execution would join the few rows that stand for many. Spark sizes the grid by those few rows too, so a join with it is hinted as a merge,
    never a broadcast.
    """
    step = step_us if isinstance(step_us, Column) else F.lit(int(step_us))
    tasks = max(tasks, int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    b = bounds.select(*keys, F.unix_micros(lo).alias("__lo"), F.unix_micros(hi).alias("__hi"), step.cast("bigint").alias("__st"))
    b = b.where((F.col("__hi") >= F.col("__lo")) & (F.col("__st") > 0)).withColumn(
        "__n", F.floor((F.col("__hi") - F.col("__lo")) / F.col("__st")))
    blocks = b.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("__n") / BLOCK)))).repartition(tasks, *keys, "__b")
    i = F.explode(F.sequence(F.col("__b") * BLOCK, F.least(F.col("__n"), (F.col("__b") + 1) * BLOCK - 1)))
    return blocks.select(*keys, "__lo", "__st", i.alias("__i")).select(
        *keys, F.timestamp_micros(F.col("__lo") + F.col("__i") * F.col("__st")).alias(out)).hint("merge")


def bucket(ts: Column | str, step_s: float) -> Column:
    """Left-closed bin start of an instant, aligned to the epoch."""
    w = int(step_s * 1_000_000)
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_micros((F.floor(F.unix_micros(t) / F.lit(w)) * F.lit(w)).cast("bigint"))


_HOW = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "median": lambda c: F.percentile(c, F.lit(0.5))}


def resample(df: DataFrame, axis: Axis, step_s: float, values: dict[str, tuple[str, str]], fill_grid: bool = True) -> DataFrame:
    """Aggregate into regular bins labelled by their start; empty bins between first and last are null rows.

    ``values``: output -> (how, column). Bins are aggregated map-side, then laid on the grid.
    """
    keys = list(axis.keys)
    agg = df.groupBy(*keys, bucket(axis.ts, step_s).alias("bin_ts")).agg(
        *[_HOW[how](F.col(c)).alias(o) for o, (how, c) in values.items()])
    if not fill_grid:
        return agg
    bounds = df.groupBy(*keys).agg(F.min(axis.ts).alias("a"), F.max(axis.ts).alias("b")).select(
        *keys, bucket("a", step_s).alias("a"), bucket("b", step_s).alias("b"))
    g = grid(bounds, keys, "a", "b", int(step_s * 1_000_000), "bin_ts")
    return g.join(agg, [*keys, "bin_ts"], "left")


def resample_linear(df: DataFrame, axis: Axis, step_s: float, values: dict[str, tuple[str, str]], index: str | None = None) -> DataFrame:
    """``linear_fill`` (edges ``inside``) of ``resample``, without a shuffle of the grid.

    Only the bins that hold rows are scanned: each learns the next one and the known values on either side, and fills the grid as far as the
    next bin by itself. ``index`` names the 0-based number of the bin within the entity, which then needs no scan either.
    """
    keys, step, names = list(axis.keys), int(step_s * 1_000_000), list(values)
    one = axis.with_(order=("bin_ts",))
    agg = resample(df, axis, step_s, values, fill_grid=False)
    pack = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("bin_ts").alias("t"), F.col(c).cast("double").alias("v"))) for c in names}
    s = scan(agg, one, nxt={"__next": "bin_ts"}, ffill={f"__b_{c}": p for c, p in pack.items()}, bfill={f"__f_{c}": p for c, p in pack.items()})
    bins = F.coalesce(F.floor((F.unix_micros("__next") - F.unix_micros("bin_ts")) / step), F.lit(1)).cast("bigint")
    s = scan(s.withColumn("__bins", bins), one, nxt={f"__a_{c}": f"__f_{c}" for c in names}, run_sum={"__upto": "__bins"})
    hi = F.timestamp_micros(F.unix_micros("bin_ts") + (F.col("__bins") - 1) * step)
    s = s.withColumns({"__hi": hi, "__at": F.col("bin_ts"), "__first": F.col("__upto") - F.col("__bins")})
    ends = [f"__{k}_{c}" for c in names for k in "ba"]
    g = grid(s, [*keys, "__at", "__first", *ends], "bin_ts", "__hi", step, "bin_ts", axis.tasks)
    t, out = F.col("bin_ts"), {}
    for c in names:
        b, f = F.col(f"__b_{c}"), F.col(f"__a_{c}")
        lin = b["v"] + (f["v"] - b["v"]) * (seconds_between(b["t"], t) / seconds_between(b["t"], f["t"]))
        out[c] = F.when(b["t"] == t, b["v"]).otherwise(lin)
    if index:
        out[index] = F.col("__first") + F.floor((F.unix_micros(t) - F.unix_micros("__at")) / step).cast("bigint")
    return g.withColumns(out).select(*keys, "bin_ts", *out)


def series_aggregates(df: DataFrame, axis: Axis, step_s: float, xyz: tuple[str, str, str], others: dict[str, str] | None = None,
                      centre_label: bool = False) -> DataFrame:
    """Mean and peak-to-peak of the vector magnitude and of other channels per bin, with ``n_samples``.

    Empty bins are emitted with null statistics and zero samples.
    """
    keys = list(axis.keys)
    mag = F.sqrt(sum((F.col(c) * F.col(c) for c in xyz), F.lit(0.0)))
    d = df.withColumn("__m", mag)
    chans = {"activity": "__m", **(others or {})}
    agg = d.groupBy(*keys, bucket(axis.ts, step_s).alias("bin_ts")).agg(
        *[F.avg(c).alias(o) for o, c in chans.items()],
        *[(F.max(c) - F.min(c)).alias(f"{o}_range") for o, c in chans.items()],
        F.count("__m").alias("n_samples"))
    b = d.groupBy(*keys).agg(F.min(axis.ts).alias("a"), F.max(axis.ts).alias("b")).select(
        *keys, bucket("a", step_s).alias("a"), bucket("b", step_s).alias("b"))
    g = grid(b, keys, "a", "b", int(step_s * 1_000_000), "bin_ts")
    out = g.join(agg, [*keys, "bin_ts"], "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))
    if centre_label:
        out = out.withColumn("bin_ts", F.timestamp_micros(F.unix_micros("bin_ts") + int(step_s * 500_000)))
    return out


# --- interpolation -----------------------------------------------------------------------------------

def linear_fill(df: DataFrame, axis: Axis, columns: list[str], edges: str = "inside", at: Column | None = None) -> DataFrame:
    """Fill nulls of numeric columns linearly in time between their nearest known samples.

    ``edges``: ``inside`` leaves leading and trailing nulls, ``both`` extends the first and last known value.
    ``at`` restricts filling to flagged rows.
    """
    ts = F.col(axis.ts)
    pack = {c: F.when(F.col(c).isNotNull(), F.struct(ts.alias("t"), F.col(c).cast("double").alias("v"))) for c in columns}
    s = scan(df, axis, ffill={f"__b_{c}": p for c, p in pack.items()}, bfill={f"__f_{c}": p for c, p in pack.items()})
    out = {}
    for c in columns:
        b, f = F.col(f"__b_{c}"), F.col(f"__f_{c}")
        span = seconds_between(b["t"], f["t"])
        lin = b["v"] + (f["v"] - b["v"]) * F.when(span > 0, seconds_between(b["t"], ts) / span).otherwise(0.0)
        if edges == "both":
            lin = F.coalesce(lin, b["v"], f["v"])
        known = F.col(c).isNotNull()
        out[c] = F.when(known | (~at if at is not None else F.lit(False)), F.col(c).cast("double")).otherwise(lin)
    return s.withColumns(out).select(*df.columns)


def hold_fill(df: DataFrame, axis: Axis, columns: list[str], at: Column | None = None, backward: bool = True) -> DataFrame:
    """Fill nulls with the last known value, then (``backward``) with the next one."""
    s = scan(df, axis, ffill={f"__b_{c}": c for c in columns}, bfill={f"__f_{c}": c for c in columns} if backward else None)
    pick = lambda c: F.coalesce(*[F.col(x) for x in ([f"__b_{c}", f"__f_{c}"] if backward else [f"__b_{c}"])])
    return s.withColumns({c: pick(c) if at is None else F.when(at & F.col(c).isNull(), pick(c)).otherwise(F.col(c))
                          for c in columns}).select(*df.columns)


def limited_fill(df: DataFrame, axis: Axis, columns: list[str], forward: int, backward: int = 0) -> DataFrame:
    """Nulls filled with the last known value over at most ``forward`` rows, then with the next one over at most ``backward`` rows."""
    s = scan(df, axis, index="__i")
    pack = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(c).alias("v")))
    s = scan(s, axis, ffill={f"__b_{c}": pack(c) for c in columns}, bfill={f"__f_{c}": pack(c) for c in columns} if backward else None)

    def filled(c: str) -> Column:
        tries = [F.col(c), F.when(F.col("__i") - F.col(f"__b_{c}.i") <= forward, F.col(f"__b_{c}.v"))]
        return F.coalesce(*tries, *([F.when(F.col(f"__f_{c}.i") - F.col("__i") <= backward, F.col(f"__f_{c}.v"))] if backward else []))

    return s.withColumns({c: filled(c) for c in columns}).select(*df.columns)


def limited_ffill(df: DataFrame, axis: Axis, columns: list[str], limit: int) -> DataFrame:
    """Forward fill over at most ``limit`` rows."""
    return limited_fill(df, axis, columns, limit)


def on_regular_grid(features: DataFrame, recordings: DataFrame, axis: Axis, columns: list[str], limit: int, step_s: float = 1.0) -> DataFrame:
    """Epoch features on a grid of ``step_s`` over each recording: the features of a step (the last by order) where there are any, held over at
    most ``limit`` steps and then drawn back over at most ``limit + 1``.

    ``recordings``: keys, ``a`` and ``b``, first and last instant; the grid starts at the step that holds the first.
    """
    keys = list(axis.keys)
    width = int(step_s * 1_000_000)
    r = recordings.select(*keys, bucket("a", step_s).alias("a"), "b")
    axis = grid_axis(axis, r, "a", "b", width)
    g = grid(r, keys, "a", "b", width, axis.ts, axis.tasks)
    f = features.groupBy(*keys, bucket(axis.ts, step_s).alias(axis.ts)).agg(*[F.max_by(c, F.struct(*axis.order)).alias(c) for c in columns])
    return limited_fill(g.join(f, [*keys, axis.ts], "left"), axis.with_(order=(axis.ts,)), columns, limit, limit + 1)


def interpolate_onto(points: DataFrame, samples: DataFrame, axis: Axis, columns: list[str], edges: str = "inside") -> DataFrame:
    """Values of ``samples`` at the instants of ``points`` (keys, ts), linear in time: one stacked scan."""
    keys = list(axis.keys)
    p = points.select(*keys, axis.ts, F.lit(1).alias("__kind"))
    s = samples.select(*keys, axis.ts, F.lit(0).alias("__kind"), *[F.col(c).cast("double").alias(c) for c in columns])
    both = s.unionByName(p, allowMissingColumns=True)
    ax = axis.with_(order=(axis.ts, "__kind"))
    return linear_fill(both, ax, columns, edges).where(F.col("__kind") == 1).drop("__kind")


def fill_short_gaps(df: DataFrame, axis: Axis, numeric: list[str], other: list[str], limit_s: float = 120.0) -> DataFrame:
    """Reindex onto the grid of the smallest step and fill what was missing.

    Duplicate instants, and gaps that meet or exceed ``limit_s`` beyond one step, raise an error when the
    job runs. Numeric columns are linear in time, others are carried forward, then backward. Adds ``inserted``.
    """
    keys = list(axis.keys)
    st = steps(df, axis)
    facts = st.groupBy(*keys).agg(
        F.min(axis.ts).alias("a"), F.max(axis.ts).alias("b"), F.count_if(F.col("step_s") == 0).alias("dup"),
        F.min(F.when(F.col("step_s") > 0, F.unix_micros(axis.ts) - F.unix_micros("prev_ts"))).alias("us"),
        F.max("step_s").alias("worst"))
    over = F.col("worst") - F.col("us") / 1e6 >= limit_s
    facts = facts.withColumn("us", F.when(F.col("dup") > 0, F.raise_error(F.concat(
        F.col("dup").cast("string"), F.lit(" duplicate timestamps; cannot interpolate gaps"))).cast("bigint")).when(
        over, F.raise_error(F.concat(F.lit("gap of "), F.col("worst").cast("string"), F.lit(
            f" s meets or exceeds the {limit_s:g} s interpolation limit"))).cast("bigint")).otherwise(
        F.coalesce("us", F.lit(1).cast("bigint"))))
    g = grid(facts, keys, "a", "b", F.col("us"), axis.ts)
    full = g.join(df.withColumn("__had", F.lit(True)), [*keys, axis.ts], "left").withColumn(
        "inserted", F.col("__had").isNull()).drop("__had")
    gx = axis.with_(order=(axis.ts,))
    if numeric:
        full = linear_fill(full, gx, numeric, at=F.col("inserted"))
    if other:
        full = hold_fill(full, gx, other, at=F.col("inserted"))
    return full


def upsample(df: DataFrame, axis: Axis, step_s: float, columns: list[str]) -> DataFrame:
    """Repeat each sample on a finer regular grid until the next sample comes."""
    keys = list(axis.keys)
    b = df.groupBy(*keys).agg(F.min(axis.ts).alias("a"), F.max(axis.ts).alias("b"))
    g = grid(b, keys, "a", "b", int(step_s * 1_000_000), axis.ts)
    both = df.select(*keys, axis.ts, F.lit(0).alias("__kind"), *columns).unionByName(
        g.withColumn("__kind", F.lit(1)), allowMissingColumns=True)
    return hold_fill(both, axis.with_(order=(axis.ts, "__kind")), columns, backward=False).where("__kind = 1").drop("__kind")


def collate(signals: dict[str, tuple[DataFrame, list[str]]], axis: Axis, anchor: str, step_s: float) -> DataFrame:
    """Bring signals to one rate: bin means, gaps linear, joined onto the anchor signal's grid of bins."""
    keys = list(axis.keys)
    base = signals[anchor][0].groupBy(*keys).agg(F.min(axis.ts).alias("a"), F.max(axis.ts).alias("b")).select(
        *keys, bucket("a", step_s).alias("a"), bucket("b", step_s).alias("b"))
    out = grid(base, keys, "a", "b", int(step_s * 1_000_000), "bin_ts")
    for df, cols in signals.values():
        r = resample(df, axis, step_s, {c: ("mean", c) for c in cols})
        r = linear_fill(r, axis.with_(order=("bin_ts",)), cols)
        out = out.join(r.hint("merge"), [*keys, "bin_ts"], "left")
    return out


# --- decimation --------------------------------------------------------------------------------------

def stride(df: DataFrame, axis: Axis, k: int) -> DataFrame:
    """Every k-th row of each entity, from the first."""
    return scan(df, axis, index="__i").where(F.col("__i") % k == 0).drop("__i")


def stride_last(df: DataFrame, axis: Axis, k: int) -> DataFrame:
    """Every k-th row plus the exact last one."""
    s = scan(df, axis, index="__i", nxt={"__more": F.lit(1)})
    return s.where((F.col("__i") % k == 0) | F.col("__more").isNull()).drop("__i", "__more")


def snap_jitter(df: DataFrame, axis: Axis, hz: float, off_by_s: float = 0.005) -> DataFrame:
    """Replace jittered stamps by first stamp + row number / rate; ``off`` marks rows moved more than ``off_by_s``."""
    keys = list(axis.keys)
    first = df.groupBy(*keys).agg(F.min(axis.ts).alias("__t0"))
    s = scan(df, axis, index="__i").join(first, keys)
    snapped = F.timestamp_micros((F.unix_micros("__t0") + F.round(F.col("__i") * (1e6 / hz))).cast("bigint"))
    return s.withColumn("snapped_ts", snapped).withColumn(
        "off", F.abs(seconds_between(axis.ts, "snapped_ts")) > off_by_s).drop("__i", "__t0")


# --- chunk grid, spans -------------------------------------------------------------------------------

# The clean chunk lengths in seconds that an automatic chunk size is rounded up to.
CLEAN_INTERVALS_S = [60, 120, 300, 600, 900, 1800, 3600]


def chunk_grid(periods: DataFrame, axis: Axis, end: str, chunk_s: int | None = None) -> DataFrame:
    """Processing chunks of attachment periods, the last one short, with ``gap`` chunks between periods.

    The automatic size is a tenth of the entity's attached time, rounded up to a clean interval.
    """
    keys, start = list(axis.keys), axis.ts
    if chunk_s is None:
        raw = periods.groupBy(*keys).agg((F.sum(seconds_between(start, end)) / 10).alias("raw"))
        size = F.coalesce(*[F.when(F.col("raw") <= c, F.lit(c)) for c in CLEAN_INTERVALS_S], F.lit(CLEAN_INTERVALS_S[-1]))
        sized = periods.join(raw.select(*keys, size.alias("chunk_s")), keys)
    else:
        sized = periods.withColumn("chunk_s", F.lit(chunk_s))
    us = F.col("chunk_s").cast("bigint") * 1_000_000
    n = F.ceil((F.unix_micros(end) - F.unix_micros(start)) / us)
    work = sized.where(F.col(end) > F.col(start)).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    work = work.select(*keys, F.timestamp_micros(F.unix_micros(start) + F.col("__i") * us).alias("chunk_start"),
                       F.least(F.timestamp_micros(F.unix_micros(start) + (F.col("__i") + 1) * us), F.col(end)).alias("chunk_end"),
                       F.lit("pending").alias("status"))
    nx = scan(periods.select(*keys, start, end), axis, nxt={"__next": start})
    gaps = nx.where(F.col("__next") > F.col(end)).select(
        *keys, F.col(end).alias("chunk_start"), F.col("__next").alias("chunk_end"), F.lit("gap").alias("status"))
    return work.unionByName(gaps)


def shared_window(df: DataFrame, keys: list[str], signal: str, ts: str) -> DataFrame:
    """Window common to all signals of an entity: latest start to earliest end, or their union if that is empty."""
    per = df.groupBy(*keys, signal).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    w = per.groupBy(*keys).agg(F.max("a").alias("s"), F.min("b").alias("e"), F.min("a").alias("us"), F.max("b").alias("ue"))
    ok = F.col("e") > F.col("s")
    return w.select(*keys, F.when(ok, F.col("s")).otherwise(F.col("us")).alias("start_ts"),
                    F.when(ok, F.col("e")).otherwise(F.col("ue")).alias("end_ts"), ok.alias("overlapping"))


def middle_window(start: str, end: str, minutes: float) -> tuple[Column, Column]:
    """The middle N minutes of a window, or all of it when it is shorter."""
    a, b = F.unix_micros(start), F.unix_micros(end)
    half = int(minutes * 30_000_000)
    mid = F.floor((a + b) / 2)
    return (F.timestamp_micros(F.greatest(a, mid - half).cast("bigint")), F.timestamp_micros(F.least(b, mid + half).cast("bigint")))


# --- lag correlation ---------------------------------------------------------------------------------

def lag_curve(df: DataFrame, axis: Axis, x: str, y: str, max_lag: int, min_pairs: int = 10) -> DataFrame:
    """Correlation of ``x[i]`` with ``y[i-lag]`` for each row lag; a positive best lag means x follows y.

    Each chunk correlates its own rows with those within reach by FFT, all lags at once: the number of pairs in which neither is null,
    and their sums, squares and products. These add up over chunks. Both signals are centred first, so that squares do
    not cancel; a signal that is constant over a lag's pairs has no correlation there.
    """
    keys = list(axis.keys)
    mean = df.groupBy(*keys).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"), F.var_pop(x).alias("__vx"), F.var_pop(y).alias("__vy"))
    d = df.select(*keys, *axis.order, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    h = halo_rows(d, axis, max_lag, max_lag).join(mean, keys).select(*keys, HALO, CORE, IDX, (F.col("__x") - F.col("__mx")).alias("__x"), (F.col("__y") - F.col("__my")).alias("__y"))
    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    lags = np.arange(-max_lag, max_lag + 1)

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t[IDX]))
        u, v, core = doubles(t, "__x"), doubles(t, "__y"), t[CORE].to_numpy()
        size = 1 << int(len(u) + max_lag).bit_length()
        known, other = core & ~np.isnan(u), ~np.isnan(v)
        u, v = np.where(known, u, 0.0), np.where(other, v, 0.0)
        left = [np.fft.rfft(w, size) for w in (known.astype(float), u, u * u)]
        right = [np.conj(np.fft.rfft(w, size)) for w in (other.astype(float), v, v * v)]
        at = {"n": (0, 0), "sx": (1, 0), "sy": (0, 1), "sxx": (2, 0), "syy": (0, 2), "sxy": (1, 1)}
        got = {c: np.fft.irfft(left[i] * right[j], size)[lags] for c, (i, j) in at.items()}
        got["n"] = np.rint(got["n"])
        out = t.slice(0, 1).select(keys).take(np.zeros(len(lags), np.int64))
        for c, w in {"lag": lags.astype(np.int64), **got}.items():
            out = out.append_column(c, pa.array(w))
        return out

    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("lag", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in sums]])
    per = h.groupBy(*keys, HALO).applyInArrow(run, schema).groupBy(*keys, "lag").agg(*[F.sum(c).alias(c) for c in sums]).join(mean, keys)
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") ** 2, n * F.col("syy") - F.col("sy") ** 2
    varies = (vx > 1e-11 * n * n * F.col("__vx")) & (vy > 1e-11 * n * n * F.col("__vy"))
    r = F.when(varies, F.least(F.greatest((n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy), F.lit(-1.0)), F.lit(1.0)))
    return per.where(n >= min_pairs).select(*keys, "lag", r.alias("r"), n.cast("bigint").alias("pairs"))


def best_lag(curve: DataFrame, keys: list[str]) -> DataFrame:
    """The lag of greatest absolute correlation, the smallest lag on ties."""
    return curve.where(F.col("r").isNotNull() & ~F.isnan("r")).groupBy(*keys).agg(
        F.max_by(F.struct("lag", "r"), F.struct(F.abs("r"), -F.col("lag"))).alias("b")).select(*keys, "b.lag", "b.r")


def estimate_lag(ref: DataFrame, target: DataFrame, axis: Axis, x: str, y: str, step_s: float, max_lag: int) -> DataFrame:
    """Lag of the target behind the reference signal, both interpolated onto one grid; positive = target lags."""
    keys = list(axis.keys)
    span = lambda d: d.groupBy(*keys).agg(F.min(axis.ts).alias("a"), F.max(axis.ts).alias("b"))
    b = span(ref).join(span(target).withColumnsRenamed({"a": "a2", "b": "b2"}), keys).select(
        *keys, F.greatest("a", "a2").alias("a"), F.least("b", "b2").alias("b"))
    g = grid(b, keys, "a", "b", int(step_s * 1_000_000), axis.ts)
    one = axis.with_(order=(axis.ts,))
    gx = interpolate_onto(g, ref, one, [x])
    gy = interpolate_onto(g, target, one, [y])
    # y[i - lag'] against x[i] with lag' = -lag: the target at i+lag looks like the reference at i
    c = lag_curve(gx.join(gy.hint("merge"), [*keys, axis.ts]), one, x, y, max_lag)
    return best_lag(c, keys).select(*keys, (-F.col("lag")).alias("lag"), (-F.col("lag") * step_s).alias("lag_s"), "r")
