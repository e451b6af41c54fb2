"""Peak detection and beat-rate chains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..core.facts import with_facts
from ..core.axis import Axis
from ..core.fold import chunked_fold
from ..core.halo import MORE, doubles, entity_apply, halo_apply, halo_time_apply, indexed, whole_entities
from ..core.order import SlidingOrder
from ..core.scan import CORE, HALO, IDX, halo_rows, row_frame, scan
from ..core.stage import stage
from ..core.stats import median, quantiles
from ..functions import dsp
from ..schema import seconds_between
from .intervals import complement, merge_near, points_in
from .islands import membership
from .joins import asof
from .timebase import grid, grid_axis, interpolate_onto, linear_fill

ACCEPTED, SUGGESTED = "beat_auto_detect_accepted", "beat_auto_detect_suggested"
REJECTED, CONFLICT = "beat_auto_detect_rejected", "beat_auto_detect_rejected_conflict"


# --- detection ---------------------------------------------------------------------------------------

def _decide(v: np.ndarray, height: float, distance: int, at_start: bool, at_end: bool) -> np.ndarray:
    """0 no peak, 1 peak, 2 not decidable from what is visible."""
    n = len(v)
    out = np.zeros(n)
    if n == 0:
        return out
    edge = np.flatnonzero(np.diff(v) != 0)
    first = np.concatenate([[0], edge + 1])
    last = np.concatenate([edge, [n - 1]])
    val = v[first]
    up = np.concatenate([[False], val[1:] > val[:-1]])
    down = np.concatenate([val[:-1] > val[1:], [False]])
    peak = up & down & (val >= height)
    if not at_start and len(val) > 1:
        out[first[0]:last[0] + 1] = np.where(val[0] >= height and val[0] > val[1], 2, 0)
    if not at_end and len(val) > 1:
        out[first[-1]:last[-1] + 1] = np.where(val[-1] >= height and val[-1] > val[-2], 2, 0)
    pos = (first[peak] + last[peak]) // 2
    h = v[pos]
    lo_vis = -np.inf if at_start else last[0] + distance
    hi_vis = np.inf if at_end else first[-1] - distance
    seen = (pos >= lo_vis) & (pos <= hi_vis)
    rank = np.empty(len(pos), np.int64)
    rank[np.lexsort((pos, h))] = np.arange(len(pos))
    near = np.searchsorted(pos, pos + distance) - np.arange(len(pos)) - 1  # later peaks within the distance
    i = np.repeat(np.arange(len(pos)), near)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(near) - near, near)
    low, high = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
    state = np.zeros(len(pos), dtype=int)  # 1 kept, -1 removed, 2 unknown; all whose higher neighbours are settled at once
    has = lambda s: np.bincount(low[state[high] == s], minlength=len(pos)) > 0
    while (todo := state == 0).any():
        kept, open_, unsure = has(1), has(0), has(2)
        state = np.where(todo & kept, -1, np.where(todo & ~open_, np.where(unsure | ~seen, 2, 1), state))
    out[pos[state == 1]] = 1
    out[pos[state == 2]] = 2
    return out


def select_peaks(df: DataFrame, axis: Axis, column: str, height: float, distance: int, halo: int | None = None) -> DataFrame:
    """Local maxima (middle of plateaus) of at least ``height``, the higher of any two closer than ``distance`` rows.

    Which peak wins can depend on a chain of neighbours. Each chunk decides what its halo proves; if any
    row stays open the halo is doubled, so the result equals one pass over the whole recording.
    """
    halo = halo or 8 * distance + 2
    while True:  # at last the halo holds the whole recording, where nothing stays open
        run = lambda x, a, b: {"__peak": _decide(x[column], height, distance, a, b)}
        got = stage(halo_apply(df, axis, halo, halo, run, [column], {"__peak": "double"}))
        if got.where(F.col("__peak") == 2).isEmpty():
            return got.where(F.col("__peak") == 1).drop("__peak")
        halo *= 2


def refine_peaks(peaks: DataFrame, samples: DataFrame, axis: Axis, column: str, radius: int) -> DataFrame:
    """Move each peak to the largest sample within ``radius`` rows; peaks that meet become one."""
    keys = list(axis.keys)
    mark = peaks.select(*keys, *axis.order, F.lit(True).alias("__is_peak"))
    s = samples.join(mark, [*keys, *axis.order], "left")
    h = halo_rows(s, axis, radius, radius)
    best = F.max_by(F.struct(*axis.order), F.struct(F.col(column), -F.col(IDX))).over(row_frame(axis, radius, radius))
    d = h.withColumn("__best", best).where(F.col(CORE) & F.col("__is_peak"))
    target = d.select(*keys, "__best.*").distinct()
    return samples.join(target, [*keys, *axis.order], "left_semi")


# The detector's settings. Cut-offs in Hz, spans in seconds, switches 1 or 0.
BEAT_DEFAULTS = {"broad_low": 1.0, "broad_high": 35.0, "narrow_low": 5.0, "narrow_high": 20.0, "filter_order": 2.0, "spike_threshold": 400.0, "smooth_s": 0.1, "window_s": 2.0,
                 "noise": 1e-10, "height": 1.0, "distance_s": 0.3, "min_height": 0.0, "max_height": 1e12, "enable_bandpass": 1.0, "enable_spike_removal": 1.0,
                 "enable_absolute": 1.0, "enable_smoothing": 1.0, "enable_normalization": 1.0}
REACH, ROWS = "__reach", ("smooth", "window", "distance")


def band_reach(p: dict[str, float], fs: float) -> int:
    """Rows that the two band-passes see on either side."""
    if not p["enable_bandpass"]:
        return 0
    if max(p["broad_high"], p["narrow_high"]) >= fs / 2:
        raise ValueError(f"cutoff {max(p['broad_high'], p['narrow_high'])} Hz is not below half the rate {fs} Hz")
    return 2 * sum(dsp.reach(int(p["filter_order"]), (p[f"{b}_low"], p[f"{b}_high"]), fs) for b in ("broad", "narrow"))


def _local_stats(v: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the known values among rows ``[i - half, i + half)``."""
    known = ~np.isnan(v)
    x = np.where(known, v, 0.0)
    c = x.sum() / max(known.sum(), 1)
    x = np.where(known, v - c, 0.0)  # centred, so squares do not cancel
    run = lambda a: np.concatenate([[0.0], np.cumsum(a)])
    i = np.arange(len(v))
    lo, hi = np.maximum(i - half, 0), np.minimum(i + half, len(v))
    n, s, q = (r[hi] - r[lo] for r in map(run, (known.astype(float), x, x * x)))
    with np.errstate(divide="ignore", invalid="ignore"):
        mu = s / n
        return mu + c, np.sqrt(np.maximum(q / n - mu * mu, 0.0))


def _detect(df: DataFrame, axis: Axis, column: str, fs: float, params: dict[str, "float | str"], reach: "int | Column") -> tuple[DataFrame, DataFrame]:
    """The detector, with parameters as numbers or as names of columns that are constant within an entity.

    An entity that fits one chunk takes all steps in one task. A larger one takes three halo maps on one row numbering: both
    band-passes; rectifying and smoothing, once the entity's spikes are known; local z-score and peaks, once the smoothed signal's
    spread is known. Returns (peaks, all rows).
    """
    keys, named = list(axis.keys), [v for v in params.values() if isinstance(v, str)]
    value = lambda x, n: float(x[params[n]][0]) if isinstance(params[n], str) else float(params[n])
    col = lambda n: F.col(params[n]) if isinstance(params[n], str) else F.lit(float(params[n]))

    def rows(n: str, least: int, ask) -> "int | Column":
        """A span in rows, at least so many; a column if its parameter is one."""
        if isinstance(params[n], str):
            return F.greatest(F.lit(least), (F.col(params[n]) * fs).cast("int"))
        return max(least, int(ask(n) * fs))

    plain = lambda n: float(params[n])

    def band(x, at_start, at_end):
        v = x[column]
        if value(x, "enable_bandpass"):
            for b in ("broad", "narrow"):
                v = dsp.zero_phase_between_nulls(v, int(value(x, "filter_order")), (value(x, f"{b}_low"), value(x, f"{b}_high")), fs, at_start, at_end)
        return {"__nb": v}

    def smooth(x, at_start, at_end):
        v = np.abs(x["__nb"]) if value(x, "enable_absolute") else x["__nb"]
        n = max(1, int(value(x, "smooth_s") * fs))
        if value(x, "enable_smoothing"):
            w = np.bartlett(n)
            v = dsp.fir_centred(v, w / w.sum(), (n - 1) // 2)
        return {"smoothed": v}

    def decide(x, at_start, at_end):
        v = x["smoothed"]
        if value(x, "enable_normalization"):
            mu, sd = _local_stats(v, max(1, max(2, int(value(x, "window_s") * fs)) // 2))
            v = (v - mu) / np.maximum(sd, x["__floor"][0])
        return {"normalized": v, "__peak": _decide(v, value(x, "height"), max(1, int(value(x, "distance_s") * fs)), at_start, at_end)}

    def whole(x):
        """The same steps on an entity that is all there."""
        x = dict(x, **band(x, True, True))
        known = x["__nb"][~np.isnan(x["__nb"])]
        if len(known) and value(x, "enable_spike_removal"):
            med = np.median(known)
            far = np.abs(x["__nb"] - med) > value(x, "spike_threshold") * np.median(np.abs(known - med))
            x["__nb"] = np.where(far, med, x["__nb"])
        x.update(smooth(x, True, True))
        known = x["smoothed"][~np.isnan(x["smoothed"])]
        spread, noise = (known.std() if len(known) else 0.0), value(x, "noise")
        x["__floor"] = [max(noise * (spread or 1.0) if 1e-6 < noise < 1 else noise, 1e-12)]
        return {"smoothed": x["smoothed"], **decide(x, True, True), IDX: np.arange(len(x[column]))}

    rest = [REACH] if isinstance(reach, Column) else []
    small, d = whole_entities(df, axis)
    parts = []
    if small is not None:
        parts.append(stage(entity_apply(small, axis, whole, [column, *named], {"smoothed": "double", "normalized": "double", "__peak": "double", IDX: "bigint"})))
    if d is not None:
        d = stage(halo_apply(indexed(d, axis), axis, reach, reach, band, [column, *named], {"__nb": "double"}))
        med = median(d, keys, "__nb", "__med")
        mad = median(d.join(med, keys).withColumn("__dev", F.abs(F.col("__nb") - F.col("__med"))), keys, "__dev", "__mad")
        d = d.join(med, keys, "left").join(mad, keys, "left")
        spike = (col("enable_spike_removal") > 0) & (F.abs(F.col("__nb") - F.col("__med")) > col("spike_threshold") * F.col("__mad"))
        d = d.withColumn("__nb", F.when(spike, F.col("__med")).otherwise(F.col("__nb"))).drop("__med", "__mad")
        n = rows("smooth_s", 1, plain)
        d = stage(halo_apply(d, axis, n, n, smooth, ["__nb", *named], {"smoothed": "double"}).drop("__nb"))
        spread = d.groupBy(*keys).agg(F.stddev_pop("smoothed").alias("__g"))
        gs = F.when(F.col("__g") > 0, F.col("__g")).otherwise(F.lit(1.0))
        share = (col("noise") > 1e-6) & (col("noise") < 1)
        d = d.join(spread, keys).withColumn("__floor", F.greatest(F.when(share, col("noise") * gs).otherwise(col("noise")), F.lit(1e-12))).drop("__g")
        halo = rows("window_s", 2, plain) + 8 * rows("distance_s", 1, plain) + 2
        while True:  # at last the halo holds the whole recording, where no peak stays open
            got = stage(halo_apply(d, axis, halo, halo, decide, ["smoothed", "__floor", *named], {"normalized": "double", "__peak": "double"}))
            if got.where(F.col("__peak") == 2).isEmpty():
                break
            halo = halo * 2
        parts.append(got.drop("__floor", MORE))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.where(F.col("__peak") == 1).drop("__peak", *rest), out.drop("__peak", *rest)


def detect_beats(df: DataFrame, axis: Axis, column: str, fs: float, broad: tuple[float, float], narrow: tuple[float, float], spike: float = 400.0,
                 smooth_s: float = 0.1, window_s: float = 2.0, height: float = 1.0, distance_s: float = 0.3, noise: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """Band-pass, spike removal, rectification, smoothing, local z-score and peak picking.

    Returns (peaks, processed signal with ``smoothed`` and ``normalized``).
    """
    p = {**BEAT_DEFAULTS, "broad_low": broad[0], "broad_high": broad[1], "narrow_low": narrow[0], "narrow_high": narrow[1], "spike_threshold": spike, "smooth_s": smooth_s,
         "window_s": window_s, "height": height, "distance_s": distance_s, "noise": noise}
    found, d = _detect(df, axis, column, fs, p, band_reach(p, fs))
    return found.drop(IDX), d.drop(IDX)


def detect_beats_by_chunk(df: DataFrame, axis: Axis, column: str, fs: float, chunks: DataFrame, defaults: dict[str, float] | None = None, bin_s: float = 3600.0) -> DataFrame:
    """The detector on each chunk of a grid by itself, with the chunk's own parameters, all chunks in one job.

    ``chunks``: keys, chunk_start, chunk_end (closed), status, params_override (map of texts, sparse; null for none). Chunks of status ``gap``
    and chunks without samples give nothing. Returns the peaks with ``chunk_start``, ``smoothed``, ``normalized``, ``key`` by the
    chunk's height limits, and ``refined_index``, the row number over all chunks' samples in order. A sample on an edge that two
    chunks share is in both, as they are detected apart. Overrides that are no number leave the default.
    """
    base = {**BEAT_DEFAULTS, **(defaults or {})}
    keys, names = list(axis.keys), list(base)
    own = {n: f"__p_{n}" for n in names}
    live = chunks.where(F.coalesce(F.col("status"), F.lit("")) != "gap").select(
        *keys, "chunk_start", "chunk_end", *[F.coalesce(F.expr(f"try_cast(params_override['{n}'] AS double)"), F.lit(float(base[n]))).alias(own[n]) for n in names])

    def designed(frames):
        """Filters are designed per chunk; different sets are few, so each is solved once."""
        for f in frames:
            sets = f[[own[n] for n in names]].itertuples(index=False)
            yield f.assign(**{REACH: [band_reach(dict(zip(names, s)), fs) for s in sets]})

    kinds = ", ".join(f"`{n}` {t}" for n, t in live.dtypes)
    live = stage(live.mapInPandas(designed, f"{kinds}, {REACH} int"))
    # Parameters that repeat are next to nothing in the file, whose size Spark goes by; as rows by bin they would fill the driver as a broadcast.
    rows = points_in(df, live.hint("merge"), keys, axis.ts, ("chunk_start", "chunk_end"), bin_s).drop("chunk_end")
    inner = axis.with_(keys=(*keys, "chunk_start"))
    found, d = _detect(rows, inner, column, fs, own, F.col(REACH))
    before = W.partitionBy(*keys).orderBy("chunk_start").rowsBetween(W.unboundedPreceding, -1)
    offset = d.groupBy(*keys, "chunk_start").agg(F.count(F.lit(1)).alias("__n")).select(*keys, "chunk_start", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    high = F.col("smoothed").between(F.col(own["min_height"]), F.col(own["max_height"]))
    return found.join(offset, [*keys, "chunk_start"]).withColumns({"refined_index": F.col(IDX) + F.col("__before"), "key": F.when(high, ACCEPTED).otherwise(REJECTED)}).select(
        *df.columns, "chunk_start", "smoothed", "normalized", "refined_index", "key")


def pooled_peaks(df: DataFrame, axis: Axis, sources: list[str], height: float, distance: int) -> DataFrame:
    """Union of the peaks of several source signals, each row once."""
    out = None
    for s in sources:
        p = select_peaks(df, axis, s, height, distance).select(*axis.keys, *axis.order)
        out = p if out is None else out.unionByName(p)
    return df.join(out.distinct(), [*axis.keys, *axis.order], "left_semi")


def accept_by_height(df: DataFrame, height: str, lo: float, hi: float) -> DataFrame:
    return df.withColumn("key", F.when(F.col(height).between(lo, hi), ACCEPTED).otherwise(REJECTED))


def with_chunk_parameters(df: DataFrame, chunks: DataFrame, axis: Axis, defaults: dict[str, float], bin_s: float = 3600.0) -> DataFrame:
    """Per-chunk parameter overrides as columns: the chunk grid's map where it has the name, else the default.

    ``chunks``: keys, chunk_start, chunk_end, params_override (map).
    """
    j = points_in(df, chunks.select(*axis.keys, "chunk_start", "chunk_end", "params_override"), list(axis.keys), axis.ts,
                  ("chunk_start", "chunk_end"), bin_s, "left", closed=False)
    return j.withColumns({n: F.coalesce(F.expr(f"try_cast(params_override['{n}'] AS double)"), F.lit(float(v))) for n, v in defaults.items()}
                         ).drop("chunk_start", "chunk_end", "params_override")


# --- beat tables: keys, ts (and tiebreak) ------------------------------------------------------------

def beat_rates(beats: DataFrame, axis: Axis, scale: float = 60.0, halve: bool = False) -> DataFrame:
    """Seconds to the next beat and the rate over that interval; the last beat repeats the last rate."""
    s = scan(beats, axis, nxt={"__next": axis.ts})
    s = s.withColumn("rr_s", seconds_between(axis.ts, "__next"))
    rate = F.when(F.col("rr_s") > 0, F.lit(scale / (2 if halve else 1)) / F.col("rr_s"))
    s = s.withColumn("rate", rate)
    s = scan(s, axis, ffill={"__last_rate": "rate"})
    return s.withColumn("rate", F.when(F.col("__next").isNull(), F.col("__last_rate")).otherwise(F.col("rate"))).drop("__next", "__last_rate")


def rate_signal(samples: DataFrame, beats: DataFrame, axis: Axis, halve: bool = False) -> DataFrame:
    """Beat rate on every sample as a step function, null before the first beat."""
    b = beat_rates(beats, axis, halve=halve).select(*axis.keys, F.col(axis.ts).alias("__bt"), "rate")
    return asof(samples, b, axis, "__bt", ["rate"], direction="backward").drop("dt_s")


def rate_preview(beats: DataFrame, axis: Axis, per_minute: bool = True) -> DataFrame:
    """Rate from accepted beats against the previous one; non-positive intervals are dropped."""
    s = scan(beats, axis, prev={"__p": axis.ts}).withColumn("rr_s", seconds_between("__p", axis.ts)).drop("__p")
    return s.where(F.col("rr_s") > 0).withColumn("rate", F.lit(60.0 if per_minute else 1.0) / F.col("rr_s"))


def rate_jumps(beats: DataFrame, axis: Axis, frac: float) -> DataFrame:
    """Beats whose rate over the interval just ended changed by more than ``frac``: ``direction`` up or down.

    Carries ``prev_ts``, the beat that opens the interval.
    """
    s = scan(beats, axis, prev={"prev_ts": axis.ts}).withColumn("hr", 60.0 / F.nullif(seconds_between("prev_ts", axis.ts), F.lit(0.0)))
    s = scan(s, axis, prev={"prev_hr": "hr"}).withColumn("frac_change", (F.col("hr") - F.col("prev_hr")) / F.col("prev_hr"))
    return s.where(F.abs("frac_change") > frac).withColumn("direction", F.when(F.col("frac_change") > 0, "up").otherwise("down"))


def suggest_beats(jumps: DataFrame, samples: DataFrame, axis: Axis, column: str, min_height: float, min_samples: int = 3, bin_s: float = 60.0) -> DataFrame:
    """For each down-jump, the largest sample of the interval before it if it is high enough."""
    keys = list(axis.keys)
    iv = jumps.where("direction = 'down'").select(*keys, F.col("prev_ts").alias("__a"), F.col(axis.ts).alias("__b"))
    j = points_in(samples.select(*keys, *axis.order, column), iv, keys, axis.ts, ("__a", "__b"), bin_s, closed=False)
    pick = F.max_by(F.struct(*axis.order, column), F.struct(F.col(column), -F.unix_micros(axis.ts)))
    g = j.groupBy(*keys, "__a", "__b").agg(pick.alias("__p"), F.count(F.lit(1)).alias("__n"))
    return g.where((F.col("__n") >= min_samples) & (F.col(f"__p.{column}") >= min_height)).select(*keys, "__p.*").withColumn("key", F.lit(SUGGESTED))


def conflict_pairs(beats: DataFrame, axis: Axis, factor: float, window_s: float, reject_earlier: bool = True) -> DataFrame:
    """Beats that form a pair much closer than the local median interval.

    The reference interval is the median over pairs whose midpoints lie within ±window/2: halo chunks in time, indexed by
    rank, so a pair costs the same however wide the window is. Returns the beats to reject.
    """
    keys, half = list(axis.keys), int(window_s * 500_000)
    s = scan(beats.select(*keys, *axis.order), axis, nxt={"__nxt": F.struct(*axis.order)})
    s = s.where(F.col("__nxt").isNotNull())
    us = F.unix_micros(axis.ts)
    s = s.withColumns({"rr_s": seconds_between(axis.ts, f"__nxt.{axis.ts}"),
                       "__mid": F.timestamp_micros(F.floor((us + F.unix_micros(f"__nxt.{axis.ts}")) / 2).cast("bigint"))})
    m_axis = axis.with_(order=("__mid", *axis.order))

    def local_median(x, pos):
        ok = x["rr_s"] > 0
        at = pos[ok]
        return {"__ref": SlidingOrder(x["rr_s"][ok]).quantile(np.searchsorted(at, pos - half), np.searchsorted(at, pos + half, side="right"), 0.5)}

    bad = halo_time_apply(s, m_axis, half, half, local_median, ["rr_s"], {"__ref": "double"}).where(F.col("rr_s") < F.col("__ref") * factor)
    return bad.select(*keys, *[F.col(o) for o in axis.order]) if reject_earlier else bad.select(*keys, "__nxt.*")


def up_jump_rejections(beats: DataFrame, axis: Axis, frac: float, min_rr_s: float) -> tuple[DataFrame, DataFrame]:
    """Up-jumps reject the beat before them; returns (beats to reject, gaps where the repaired interval is too short).

    Working through the jumps in order, the beat directly before a jump is always still standing, and the
    last standing beat before that one is the latest that does not itself precede a jump. Both are window
    lookups, so the order-dependent loop needs no loop.
    """
    keys = list(axis.keys)
    j = rate_jumps(beats, axis, frac).where("direction = 'up'").select(*keys, *axis.order, F.lit(True).alias("__up"))
    s = beats.select(*keys, *axis.order).join(j, [*keys, *axis.order], "left")
    s = scan(s, axis, nxt={"__next_up": "__up", "__next_ts": axis.ts})
    s = s.withColumn("__rej", F.coalesce("__next_up", F.lit(False)))
    s = scan(s, axis, prev={"__prev_stand": F.when(~F.col("__rej"), F.col(axis.ts))})
    s = scan(s, axis, ffill={"__stand": F.when(~F.col("__rej"), F.col(axis.ts))})
    s = scan(s, axis, prev={"__before": "__stand"})
    rej = s.where("__rej")
    gaps = rej.where(F.col("__before").isNotNull() & (seconds_between("__before", "__next_ts") < min_rr_s)).select(
        *keys, F.col("__before").alias("start_ts"), F.col("__next_ts").alias("end_ts"))
    return rej.select(*keys, *axis.order), gaps


def strict_rate(samples: DataFrame, beats: DataFrame, axis: Axis, gaps: DataFrame, unusable: DataFrame, min_rr_s: float, min_bpm: float,
                max_bpm: float, bin_s: float = 3600.0) -> DataFrame:
    """Rate rebuilt strictly: too short intervals and gap spans are null (``rate_nan``), the rest clamped;
    ``rate_fixed`` fills linearly in both directions and is null again inside unusable spans (half-open, like gaps).

    An entity whose samples fit one chunk meets its beats and spans in one task; larger ones go through joins and scans.
    """
    small, large = whole_entities(samples, axis)
    parts = []
    if small is not None:
        parts.append(_strict_whole(small, beats, axis, gaps, unusable, min_rr_s, min_bpm, max_bpm))
    if large is not None:
        parts.append(_strict_joined(large, beats, axis, gaps, unusable, min_rr_s, min_bpm, max_bpm, bin_s))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _strict_whole(samples: DataFrame, beats: DataFrame, axis: Axis, gaps: DataFrame, unusable: DataFrame, min_rr_s: float, min_bpm: float, max_bpm: float) -> DataFrame:
    keys, cols = list(axis.keys), list(samples.columns)
    mark = lambda d, kind, a, b: d.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.lit(kind).alias("__kind"), F.unix_micros(a).alias("__a"), F.unix_micros(b).alias("__b"))
    marks = mark(beats, 0, axis.ts, axis.ts).unionAll(mark(gaps, 1, "start_ts", "end_ts")).unionAll(mark(unusable, 2, "start_ts", "end_ts"))
    rows = samples.withColumn("__us", F.unix_micros(axis.ts))
    schema = T.StructType([*samples.schema.fields, T.StructField("rate_nan", T.DoubleType()), T.StructField("rate_fixed", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([(o, "ascending") for o in axis.order])
        us, kind, start, stop = (c.to_numpy() for c in (left["__us"], right["__kind"], right["__a"], right["__b"]))

        def within(k: int) -> np.ndarray:
            ok = (kind == k) & (stop > start)
            return np.searchsorted(np.sort(start[ok]), us, side="right") > np.searchsorted(np.sort(stop[ok]), us, side="right")

        at = np.sort(start[kind == 0])
        rr = np.append(np.diff(at) / 1e6, np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            rate = np.append(np.where(rr >= min_rr_s, np.clip(60.0 / rr, min_bpm, max_bpm), np.nan), np.nan)  # the last place stands for no beat yet
        strict = np.where(within(1), np.nan, rate[np.searchsorted(at, us, side="right") - 1])
        fixed = strict
        known = np.flatnonzero(~np.isnan(strict))
        if len(known):
            i = np.searchsorted(known, np.arange(len(us)), side="right")
            p, q = known[np.maximum(i - 1, 0)], known[np.minimum(i, len(known) - 1)]
            span = us[q] - us[p]
            w = np.where(span > 0, (us - us[p]) / np.where(span > 0, span, 1), 0.0)
            fixed = np.where(np.isnan(strict), np.where(p < q, strict[p] + (strict[q] - strict[p]) * w, strict[p]), strict)
        fixed = np.where(within(2), np.nan, np.clip(fixed, min_bpm, max_bpm))
        out = left.select(cols)
        for n, v in (("rate_nan", strict), ("rate_fixed", fixed)):
            out = out.append_column(n, pa.array(v, pa.float64(), from_pandas=True))
        return out

    return rows.groupBy(*keys).cogroup(marks.groupBy(*[f"__of_{k}" for k in keys])).applyInArrow(run, schema)


def _strict_joined(samples: DataFrame, beats: DataFrame, axis: Axis, gaps: DataFrame, unusable: DataFrame, min_rr_s: float, min_bpm: float,
                   max_bpm: float, bin_s: float) -> DataFrame:
    s = scan(beats.select(*axis.keys, *axis.order), axis, nxt={"__n": axis.ts}).withColumn("__rr", seconds_between(axis.ts, "__n"))
    rate = F.when(F.col("__rr") >= min_rr_s, F.greatest(F.least(60.0 / F.col("__rr"), F.lit(float(max_bpm))), F.lit(float(min_bpm))))
    b = s.select(*axis.keys, F.col(axis.ts).alias("__bt"), rate.alias("rate_nan"))
    d = asof(samples, b, axis, "__bt", ["rate_nan"], direction="backward").drop("dt_s")
    half_open = lambda sp: sp.select(*axis.keys, "start_ts", F.timestamp_micros(F.unix_micros("end_ts") - 1).alias("end_ts")).where("end_ts >= start_ts")
    d = membership(d, half_open(gaps), axis, "__gap", bin_s=bin_s)
    d = membership(d, half_open(unusable), axis, "__bad", bin_s=bin_s)
    d = d.withColumn("rate_nan", F.when(~F.col("__gap"), F.col("rate_nan"))).withColumn("rate_fixed", F.col("rate_nan"))
    d = linear_fill(d, axis, ["rate_fixed"], "both")
    return d.withColumn("rate_fixed", F.when(~F.col("__bad") & F.col("rate_fixed").isNotNull(), F.greatest(F.least("rate_fixed", F.lit(float(max_bpm))), F.lit(float(min_bpm))))).drop("__gap", "__bad")


def quality_states(unusable: DataFrame, samples: DataFrame, axis: Axis) -> DataFrame:
    """Merged unusable spans and the usable spans between them, over each recording's extent."""
    keys = list(axis.keys)
    ax = axis.with_(order=("start_ts", "end_ts"))
    m = merge_near(unusable.where("end_ts > start_ts").select(*keys, "start_ts", "end_ts"), ax)
    b = samples.groupBy(*keys).agg(F.min(axis.ts).alias("lo"), F.max(axis.ts).alias("hi"))
    good = complement(m, axis.with_(order=("start_ts",)), b)
    tag = lambda d, k: d.select(*keys, "start_ts", "end_ts", F.lit(k).alias("key"), seconds_between("start_ts", "end_ts").alias("duration_s"))
    return tag(m, "QC_unusable_ecg").unionByName(tag(good, "QC_usable_ecg"))


def snap_to_samples(labels: DataFrame, samples: DataFrame, axis: Axis, tolerance_s: float, take: list[str]) -> DataFrame:
    """Labels moved to the nearest sample within a tolerance; several on one sample count once."""
    s = samples.select(*axis.keys, F.col(axis.ts).alias("__st"), *take)
    j = asof(labels, s.withColumn("sample_ts", F.col("__st")), axis.with_(order=(axis.ts, *axis.order[1:])), "__st", ["sample_ts", *take], tolerance_s)
    return j.where(F.col("sample_ts").isNotNull()).select(*axis.keys, "sample_ts", *take).distinct()


def suggest_parameters(rr: DataFrame, keys: list[str], rr_col: str) -> DataFrame:
    """Detector parameters from labelled intervals: distance half the median RR, top rate 1.3·60/min RR up to 500."""
    q = quantiles(rr.where(F.col(rr_col) > 0), keys, rr_col, {"median_rr": 0.5, "min_rr": 0.0})
    return q.select(*keys, (F.col("median_rr") * 0.5).alias("peak_distance_s"), F.least(F.lit(500.0), 78.0 / F.col("min_rr")).alias("max_bpm"))


# --- candidates --------------------------------------------------------------------------------------

def window_arrays(candidates: DataFrame, samples: DataFrame, axis: Axis, columns: list[str], half: int) -> DataFrame:
    """Samples within ``half`` rows of each candidate as arrays ``<c>_win`` (2·half+1 values at most, nulls left out), with ``n_left``, the
    count of rows before it. Only candidates leave their chunk, with arrays cut from the chunk's columns."""
    keys = list(axis.keys)
    mark = candidates.select(*keys, *axis.order, F.lit(True).alias("__cand")).distinct()
    s = samples.select(*keys, *axis.order, *columns).join(mark, [*keys, *axis.order], "left")
    h = halo_rows(s, axis, half, half)
    shown = [*keys, *axis.order]
    schema = T.StructType([*[s.schema[c] for c in shown], T.StructField("n_left", T.IntegerType()), *[s.schema[c] for c in columns],
                           *[T.StructField(f"{c}_win", T.ArrayType(T.DoubleType())) for c in columns]])

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t[IDX]))
        at = np.flatnonzero(pc.and_kleene(t[CORE], t["__cand"].fill_null(False)).to_numpy())
        lo, hi = np.maximum(at - half, 0), np.minimum(at + half + 1, t.num_rows)
        row = np.repeat(lo - np.cumsum(np.append(0, hi - lo)[:-1]), hi - lo) + np.arange(int((hi - lo).sum()))
        picked = t.take(pa.array(at))
        out = picked.select(shown).append_column("n_left", pa.array(np.minimum(picked[IDX].to_numpy(), half).astype(np.int32)))
        for c in columns:
            out = out.append_column(c, picked[c])
        for c in columns:
            known = t[c].is_valid().to_numpy()[row]
            ends = np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(at)), hi - lo)[known], minlength=len(at)))).astype(np.int32)
            out = out.append_column(f"{c}_win", pa.ListArray.from_arrays(pa.array(ends), pa.array(doubles(t, c)[row][known])))
        return out

    return h.groupBy(*keys, HALO).applyInArrow(run, schema)


def window_features(c: str) -> dict[str, Column]:
    """Mean, deviation and five shape descriptors of ``<c>_win`` as columns."""
    w = F.col(f"{c}_win")
    n = F.size(w)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total(w) / n
    dev = F.transform(w, lambda x: x - mean)
    var = total(F.transform(dev, lambda x: x * x)) / n
    pairs = F.zip_with(F.slice(dev, 1, n - 1), F.slice(dev, 2, n - 1), lambda a, b: a * b)
    lo, hi = F.array_min(w), F.array_max(w)
    bins = F.transform(w, lambda x: F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * 10), F.lit(9))).otherwise(F.lit(5)))
    shares = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.size(F.filter(bins, lambda b: b == k)) / n)
    run = F.aggregate(dev, F.struct(F.lit(0).alias("r"), F.lit(0).alias("m")), lambda s, x: F.struct(
        F.when(x > 0, s["r"] + 1).otherwise(0).alias("r"), F.greatest(s["m"], F.when(x > 0, s["r"] + 1).otherwise(0)).alias("m")))
    ok = lambda e: F.when(n >= 4, e)
    return {
        f"{c}_mean": mean, f"{c}_std": F.sqrt(var),
        f"{c}_ac1": ok(F.when(var > 1e-12, total(pairs) / (n - 1) / var)),
        f"{c}_zero_cross_rate": ok(F.size(F.filter(pairs, lambda p: p < 0)) / (n - 1)),
        f"{c}_mean_abs_diff": ok(total(F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1), lambda a, b: F.abs(b - a))) / (n - 1)),
        f"{c}_entropy_bins10": ok(-total(F.transform(F.filter(shares, lambda p: p > 0), lambda p: p * F.log(p)))),
        f"{c}_above_mean_runmax": ok(run["m"].cast("double")),
    }


def candidate_features(candidates: DataFrame, samples: DataFrame, axis: Axis, columns: list[str], height: str, half: int) -> DataFrame:
    """Window statistics per candidate and channel, prominence of ``height`` and seconds to both neighbours."""
    w = stage(window_arrays(candidates, samples, axis, columns, half))
    hw = F.col(f"{height}_win")
    left, right = F.array_min(F.slice(hw, F.lit(1), F.col("n_left") + 1)), F.array_min(F.slice(hw, F.col("n_left") + 1, F.size(hw)))
    feats = {k: v for c in columns for k, v in window_features(c).items()}
    w = w.withColumns(feats).withColumns({"left_trough": left, "right_trough": right, "prominence": F.col(height) - F.greatest(left, right)})
    s = scan(w, axis, prev={"__p": axis.ts}, nxt={"__n": axis.ts})
    return s.withColumns({"rr_prev_s": seconds_between("__p", axis.ts), "rr_next_s": seconds_between(axis.ts, "__n")}).drop("__p", "__n")


def label_candidates(candidates: DataFrame, events: DataFrame, axis: Axis, tolerance_s: float = 0.2) -> DataFrame:
    """``label`` 1 for a candidate with a positive event as its nearest within the tolerance, else 0.

    ``events``: keys, ts, positive (boolean).
    """
    e = events.select(*axis.keys, F.col("ts").alias("__et"), "positive")
    j = asof(candidates, e, axis, "__et", ["positive"], tolerance_s, prefix="__near_")
    return j.withColumn("label", F.coalesce(F.col("__near_positive").cast("int"), F.lit(0))).drop("__near_positive", "__near_dt_s")


MANUAL_OK = "beat_manual_ok"


def training_labels(candidates: DataFrame, events: DataFrame, axis: Axis, key: str = "key", tolerance_s: float = 0.2, manual_only: bool = False) -> DataFrame:
    """Labels to train on: the detector's own verdict, overridden by the nearest event within the tolerance.

    ``candidates`` has the detector's ``key``; ``events``: keys, ts, key, of which accepted, rejected and manually confirmed beats count. With
    ``manual_only`` all candidates start as 0 and only confirmed beats make a 1. Adds ``label``, ``label_source``, ``manual_positive`` (a
    confirmed beat lies within the tolerance) and ``in_training_span`` (from the entity's first confirmed beat to its last).
    """
    keys = list(axis.keys)
    manual = events.where(F.col("key") == MANUAL_OK)
    used = manual if manual_only else events.where(F.col("key").isin(MANUAL_OK, ACCEPTED, REJECTED))
    c = asof(candidates, used.select(*keys, F.col("ts").alias("__et"), F.col("key").alias("__key")), axis, "__et", ["__key"], tolerance_s, prefix="__near_")
    c = asof(c.drop("__near_dt_s"), manual.select(*keys, F.col("ts").alias("__et"), F.lit(True).alias("__ok")), axis, "__et", ["__ok"], tolerance_s, prefix="__near_")
    span = manual.groupBy(*keys).agg(F.min("ts").alias("__a"), F.max("ts").alias("__b"))
    near = F.col("__near___key")
    base = F.lit(0) if manual_only else (F.coalesce(F.col(key), F.lit("")) == ACCEPTED).cast("int")
    return c.join(span, keys, "left").withColumns({
        "label": F.when(near.isNull(), base).otherwise((near != REJECTED).cast("int")),
        "label_source": F.when(near.isNotNull(), "event").otherwise("manual_only" if manual_only else "detector"),
        "manual_positive": F.coalesce("__near___ok", F.lit(False)),
        "in_training_span": F.coalesce(F.col(axis.ts).between(F.col("__a"), F.col("__b")), F.lit(False))}).drop("__near___key", "__near___ok", "__near_dt_s", "__a", "__b")


def smoothness_penalty(df: DataFrame, score: str, lam: float, jump_frac: float = 0.8, min_bpm: float = 0.1, max_bpm: float = 240.0) -> DataFrame:
    """Score damped by exp(-lambda · (jump excess + range excess)) and kept in [0, 1]."""
    hr = lambda c: F.when(F.col(c) > 0, 60.0 / F.col(c))
    p, n = hr("rr_prev_s"), hr("rr_next_s")
    jump = F.coalesce(F.greatest(F.abs(n - p) / F.greatest(F.abs(p), F.lit(1e-9)) - jump_frac, F.lit(0.0)), F.lit(0.0))
    off = lambda v: F.coalesce(F.greatest(F.lit(min_bpm) - v, F.lit(0.0)) + F.greatest(v - max_bpm, F.lit(0.0)), F.lit(0.0))
    rng = (off(p) + off(n)) / max(max_bpm, 1.0)
    raw = F.col(score) * F.exp(-max(lam, 0.0) * (jump + rng)) if lam > 0 else F.col(score)
    return df.withColumn("penalized", F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))))


def probability_signal(candidates: DataFrame, bounds: DataFrame, axis: Axis, prob: str, window_s: float = 1.0, step_s: float = 0.04) -> tuple[DataFrame, DataFrame]:
    """Candidate probabilities as a regular, centred-rolling-mean signal, and that signal back at the candidates.

    ``bounds``: keys, lo, hi. Returns (signal with ``prob``, candidates with ``prob_local``).
    """
    from .rolling import rolling_mean
    keys = list(axis.keys)
    one = grid_axis(axis.with_(order=(axis.ts,)), bounds, "lo", "hi", int(step_s * 1e6))
    c = candidates.groupBy(*keys, axis.ts).agg(F.max(prob).alias("p"))
    g = grid(bounds, keys, "lo", "hi", int(step_s * 1e6), axis.ts, one.tasks)
    s = stage(interpolate_onto(g, c, one, ["p"], "both"))
    n = max(1, int(round(window_s / step_s)))
    s = rolling_mean(s, one, n + (1 - n % 2), ["p"], 1, "_roll").select(*keys, axis.ts, F.when(F.col("p_roll").isNotNull(), F.least(F.greatest("p_roll", F.lit(0.0)), F.lit(1.0))).alias("prob"))
    s = stage(s)
    at = interpolate_onto(candidates.select(*keys, axis.ts).distinct(), s, one, ["prob"], "both").withColumnRenamed("prob", "prob_local")
    return s, candidates.join(at, [*keys, axis.ts])


def down_jump_insertions(accepted: DataFrame, candidates: DataFrame, axis: Axis, frac: float, prob: str, height: str, min_prob: float, min_height: float,
                         bin_s: float = 3600.0) -> DataFrame:
    """Per down-jump the best unused candidate of the interval before it, by (probability, height)."""
    keys = list(axis.keys)
    j = rate_jumps(accepted, axis, frac).where("direction = 'down'").select(*keys, F.col("prev_ts").alias("__a"), F.col(axis.ts).alias("__b"))
    free = candidates.where((F.col(prob) >= min_prob) & (F.col(height) >= min_height)).join(accepted.select(*keys, *axis.order), [*keys, *axis.order], "left_anti")
    p = points_in(free.select(*keys, *axis.order, prob, height), j, keys, axis.ts, ("__a", "__b"), bin_s)
    g = p.groupBy(*keys, "__a", "__b").agg(F.max_by(F.struct(*axis.order, prob, height), F.struct(F.col(prob), F.col(height), -F.unix_micros(axis.ts))).alias("__c"))
    return g.select(*keys, "__c.*").distinct()


def model_cleanup(beats: DataFrame, axis: Axis, prob: str, conflict_factor: float = 0.75, jump_frac: float = 0.8, keep_later: bool = True) -> DataFrame:
    """Thin accepted beats until no pair is closer than a fraction of the median interval and no rate jumps up.

    Offences are settled from the left, each before the next is looked at. Of a close pair the earlier beat goes, or the less
    probable one (the earlier on ties, the later if a probability is missing); passes with the entity's current median repeat
    until one removes nothing, with at least 3 beats. Of an interval that ends a jump the less probable end goes, with at least
    4 beats; one fold settles all of these, because a wider interval cannot start an offence to its left.

    An entity whose beats fit one chunk is settled in one task; the passes over larger ones are folded chunk by chunk.
    """
    def whole(x):
        return {"__stay": _cleaned(x["__us"], x["__pr"], conflict_factor, jump_frac, keep_later)}

    small, large = whole_entities(beats, axis)
    parts = []
    if small is not None:
        d = small.withColumns({"__us": F.unix_micros(axis.ts), "__pr": F.col(prob).cast("double")})
        parts.append(entity_apply(d, axis, whole, ["__us", "__pr"], {"__stay": "boolean"}, keep="__stay").select(*beats.columns))
    if large is not None:
        parts.append(_cleanup_passes(large, axis, prob, conflict_factor, jump_frac, keep_later))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _standing(fold, rows: np.ndarray, columns: dict[str, list]) -> np.ndarray:
    """Those of ``rows`` that a fold (see ``_settled``) leaves."""
    kept: list[int] = []
    for row, said in zip(rows.tolist(), fold(columns, None)[0]):
        if said is None:
            kept[-1] = row
        elif said:
            kept.append(row)
    return np.array(kept, np.int64)


def _cleaned(us: np.ndarray, prob: np.ndarray, conflict_factor: float, jump_frac: float, keep_later: bool) -> np.ndarray:
    left = np.arange(len(us))
    columns = lambda lim: {"__s": (us[left] / 1e6).tolist(), "__pr": prob[left].tolist(), "__lim": [lim] * len(left)}
    while len(left) >= 3:
        rr = np.diff(us[left]) / 1e6
        lim = np.median(rr) * conflict_factor
        close = rr < lim
        if lim <= 0 or not close.any():
            break
        left = left[~np.append(close, False)] if keep_later else _standing(_close_pairs, left, columns(lim))
    if len(left) >= 4:
        left = _standing(_up_jumps, left, columns(1.0 + jump_frac))
    stay = np.zeros(len(us), bool)
    stay[left] = True
    return stay


def _cleanup_passes(beats: DataFrame, axis: Axis, prob: str, conflict_factor: float, jump_frac: float, keep_later: bool) -> DataFrame:
    keys, at = list(axis.keys), axis.ts
    cur, done = stage(beats), []
    while True:
        s = scan(cur, axis, nxt={"__n": at}).withColumn("__rr", seconds_between(at, "__n"))
        low = median(s.where(F.col("__rr").isNotNull()), keys, "__rr", "__med")
        many = cur.groupBy(*keys).agg(F.count(F.lit(1)).alias("__k"))
        lim = low.join(many, keys).select(*keys, F.when((F.col("__k") >= 3) & (F.col("__med") > 0), F.col("__med") * conflict_factor).alias("__lim"))
        s = stage(s.join(lim, keys, "left"))
        open_ = s.where(F.col("__rr") < F.col("__lim")).select(*keys).distinct()
        if open_.isEmpty():
            done.append(cur)
            break
        done.append(s.join(open_, keys, "left_anti").select(*beats.columns))  # these are settled and take no further pass
        s = s.join(open_, keys, "left_semi")
        kept = s.where(~F.coalesce(F.col("__rr") < F.col("__lim"), F.lit(False))) if keep_later else _settled(s, axis, prob, _close_pairs, ["__lim"])
        cur = stage(kept.select(*beats.columns))
    cur = done[0]
    for part in done[1:]:
        cur = cur.unionByName(part)
    cur = stage(cur)
    many = cur.groupBy(*keys).agg(F.count(F.lit(1)).alias("__k"))
    folded = cur.join(many, keys).withColumn("__lim", F.when(F.col("__k") >= 4, F.lit(1.0 + jump_frac)))
    return _settled(folded, axis, prob, _up_jumps, ["__lim"]).select(*beats.columns)


def _settled(df: DataFrame, axis: Axis, prob: str, fold, more: list[str]) -> DataFrame:
    """Rows that a fold keeps. It says False for a row that goes, None for one that takes the place of the last kept row."""
    d = df.withColumns({"__s": F.unix_micros(axis.ts) / 1e6, "__pr": F.col(prob).cast("double")})
    d = stage(chunked_fold(d, axis, ["__s", "__pr", *more], fold, "__keep"))
    d = d.withColumn("__stay", F.coalesce("__keep", F.lit(True))).where("__stay")
    return scan(d.withColumn("__takes", F.col("__keep").isNull()), axis, nxt={"__taken": "__takes"}).where(~F.coalesce("__taken", F.lit(False)))


def _close_pairs(x: dict[str, list], state: list[float] | None) -> tuple[list, list[float] | None]:
    """State: time and probability of the last kept beat."""
    out = []
    for t, p, lim in zip(x["__s"], x["__pr"], x["__lim"]):
        if state is None or not t - state[0] < lim:
            out.append(True)
        elif state[1] <= p:
            out.append(None)
        else:
            out.append(False)
            continue
        state = [t, p]
    return out, state


def _up_jumps(x: dict[str, list], state: list[float] | None) -> tuple[list, list[float] | None]:
    """State: time of the last kept beat but one (not a number at the start), time and probability of the last."""
    out = []
    for t, p, factor in zip(x["__s"], x["__pr"], x["__lim"]):
        if state is None:
            out.append(True)
            state = [float("nan"), t, p]
            continue
        before, rr = state[1] - state[0], t - state[1]
        if not (rr > 0 and before > 0 and before > rr * factor):
            out.append(True)
            state = [state[1], t, p]
        elif state[2] <= p:
            out.append(None)
            state = [state[0], t, p]
        else:
            out.append(False)
    return out, state


def fused_windows(df: DataFrame, windows: list[str], length: int, out: str = "fused") -> DataFrame:
    """Mean of z-scored channel windows, zero-padded to ``length``."""
    def z(c):
        w = F.col(c)
        n = F.size(w)
        m = F.aggregate(w, F.lit(0.0), lambda s, x: s + x) / n
        sd = F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n)
        v = F.transform(w, lambda x: F.when(sd > 1e-12, (x - m) / sd).otherwise(0.0))
        return F.concat(v, F.array_repeat(F.lit(0.0), F.lit(length) - n))
    acc = z(windows[0])
    for c in windows[1:]:
        acc = F.zip_with(acc, z(c), lambda a, b: a + b)
    return df.withColumn(out, F.transform(acc, lambda x: x / len(windows)))


# --- scores ------------------------------------------------------------------------------------------

def threshold_sweep(df: DataFrame, label: str, score: str, beta: float = 2.0, steps: int = 91, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """F-beta at each threshold of an even grid, from one pass over the scores.

    Rows are reduced to counts per grid cell first; the sweep runs on those ``steps`` + 1 rows.
    """
    width = (hi - lo) / (steps - 1)
    cell = F.least(F.greatest(F.floor((F.col(score) - lo) / width + 1e-9), F.lit(-1)), F.lit(steps - 1))
    g = df.where(F.col(score).isNotNull()).groupBy(cell.cast("int").alias("c")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    full = df.sparkSession.range(-1, steps).select(F.col("id").cast("int").alias("c")).join(g, "c", "left").fillna(0, ["p", "n"])
    w = W.orderBy(F.desc("c")).rowsBetween(W.unboundedPreceding, 0)  # steps + 1 rows
    t = full.select("c", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"), F.sum("p").over(W.partitionBy(F.lit(1))).alias("pos"))
    prec, rec, b2 = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("pos")), beta * beta
    f = F.coalesce(F.try_divide((1 + b2) * prec * rec, b2 * prec + rec), F.lit(0.0))
    return t.where("c >= 0").select((F.lit(lo) + F.col("c") * width).alias("threshold"), f.alias("fbeta"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.max_by("threshold", F.struct("fbeta", -F.col("threshold"))).alias("threshold"), F.max("fbeta").alias("fbeta"))


def precision_recall(df: DataFrame, keys: list[str], label: Column, predicted: Column) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count_if(label & predicted).alias("tp"), F.count_if(~label & predicted).alias("fp"), F.count_if(label & ~predicted).alias("fn"))
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    q = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return g.withColumns({"precision": p, "recall": q}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def tail_pseudo_labels(df: DataFrame, keys: list[str], score: str, share: float = 0.2) -> DataFrame:
    """1 for the top and 0 for the bottom share of scores, null between; by exact quantiles, not a global ranking."""
    q = quantiles(df, keys, score, {"__lo": share, "__hi": 1 - share})
    j = df.join(q, keys) if keys else with_facts(df, q)
    return j.withColumn("pseudo_label", F.when(F.col(score) >= F.col("__hi"), 1).when(F.col(score) <= F.col("__lo"), 0)).drop("__lo", "__hi")


def rate_from_candidates(samples: DataFrame, accepted: DataFrame, axis: Axis) -> DataFrame:
    """Continuous rate from accepted candidates: step rate per interval, gaps linear, ends extended."""
    b = rate_preview(accepted, axis).select(*axis.keys, axis.ts, "rate")
    one = axis.with_(order=(axis.ts,))
    return interpolate_onto(samples.select(*axis.keys, axis.ts).distinct(), b.groupBy(*axis.keys, axis.ts).agg(F.max("rate").alias("rate")), one, ["rate"], "both")
