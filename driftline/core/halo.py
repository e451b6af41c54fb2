"""Grouped-map functions over row chunks with overlap: exact for any function of bounded reach."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .axis import Axis
from .scan import CORE, HALO, IDX, halo_rows, halo_time, scan

MORE = "__more"

# (input arrays by name, chunk holds the first row, chunk holds the last row) -> output arrays by name
HaloFn = Callable[[dict[str, np.ndarray], bool, bool], dict[str, np.ndarray]]


def doubles(t: pa.Table, name: str) -> np.ndarray:
    """Column as float64 with NaN for null."""
    return pc.cast(t[name], pa.float64()).to_numpy()


def _starts(t: pa.Table, by: list[str]) -> np.ndarray:
    """Rows of a sorted table that open a new group of ``by``, without the first."""
    new = np.zeros(max(t.num_rows - 1, 0), bool)
    for c in by:
        v = t[c].combine_chunks()
        a, b = v[:-1], v[1:]
        new |= pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False) & ~pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


def sorted_apply(df: DataFrame, by: list[str], order: list[str], fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], inputs: list[str],
                 finish: Callable[[pa.Table, dict[str, np.ndarray]], pa.Table], schema: T.StructType) -> DataFrame:
    """Groups of ``by`` through ``fn`` in ``order``, many small ones in one Arrow batch: a task holds one group and one batch, and no group costs a
    stream of its own. ``finish`` makes a table of ``schema`` of the rows and the groups' outputs, end to end."""
    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        x = {c: doubles(t, c) for c in inputs}
        ends = [0, *_starts(t, by).tolist(), t.num_rows]
        got = [fn({c: v[a:z] for c, v in x.items()}) for a, z in zip(ends[:-1], ends[1:])]
        yield from finish(t, {n: np.concatenate([np.asarray(g[n]) for g in got]) for n in got[0]}).to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of a group that may go on
        for b in batches:
            if b.num_rows == 0:
                continue
            last = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            new = _starts(pa.Table.from_batches([*last, b]), by) - len(last)
            if len(new):
                done, held = [*held, b.slice(0, new[-1])], []
                yield from solve([p for p in done if p.num_rows])
                b = b.slice(new[-1])
            held.append(b)
        if held:
            yield from solve(held)

    rows = df.repartition(*by).sortWithinPartitions(*by, *[F.asc_nulls_last(o) for o in order])
    return rows.mapInArrow(run, schema)


def indexed(df: DataFrame, axis: Axis) -> DataFrame:
    """Adds what ``halo_apply`` needs to know of a row: its number within the entity, and whether another follows. Halo maps that follow
    each other on rows that keep these columns need no scan of their own."""
    return df if IDX in df.columns and MORE in df.columns else scan(df, axis, index=IDX, nxt={MORE: F.lit(1)})


def halo_apply(df: DataFrame, axis: Axis, before: int | Column, after: int | Column, fn: HaloFn, inputs: list[str], outputs: dict[str, str]) -> DataFrame:
    """Add ``outputs`` computed by ``fn`` on chunks of ``axis.rows`` rows plus ``before``/``after`` neighbours, which may be columns
    that are constant within an entity.

    A task holds one chunk and its halo, never a whole entity. Chunks travel as Arrow tables.
    """
    h = halo_rows(indexed(df, axis), axis, before, after)
    cols, names = list(df.columns), list(outputs)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in outputs.items()]])

    def one(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        got = fn({c: x[c] for c in inputs}, x[IDX][0] == 0, np.isnan(x[MORE][-1]))
        return {n: np.asarray(got[n], float) for n in names}

    def finish(t: pa.Table, got: dict[str, np.ndarray]) -> pa.Table:
        out = t.select(cols)
        for n in names:
            out = out.append_column(n, pa.array(got[n], type=pa.float64(), from_pandas=True))
        return out.filter(t[CORE])

    return sorted_apply(h, [*axis.keys, HALO], [IDX], one, list(dict.fromkeys([*inputs, IDX, MORE])), finish, schema)


def halo_time_apply(df: DataFrame, axis: Axis, before: int, after: int, fn: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]],
                    inputs: list[str], outputs: dict[str, str]) -> DataFrame:
    """Time version: ``fn`` gets the arrays of a time chunk with neighbours up to ``before``/``after`` axis units away, and the positions."""
    h = halo_time(df, axis, before, after)
    cols, names = list(df.columns), list(outputs)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in outputs.items()]])

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t["__pos"]))
        got = fn({c: doubles(t, c) for c in inputs}, t["__pos"].to_numpy())
        out = t.select(cols)
        for n in names:
            out = out.append_column(n, pa.array(got[n], type=pa.float64(), from_pandas=True))
        return out.filter(t[CORE])

    return h.groupBy(*axis.keys, HALO).applyInArrow(run, schema)


_ARROW = {"double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}


def whole_entities(df: DataFrame, axis: Axis) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of the entities that fit one chunk, rows of the larger ones), None where there are none. One count by key decides."""
    keys = list(axis.keys)
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > axis.rows).select(*keys)
    if large.isEmpty():
        return df, None
    return df.join(large, keys, "left_anti"), df.join(large, keys, "left_semi")


def entity_apply(df: DataFrame, axis: Axis, fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], inputs: list[str], outputs: dict[str, str],
                 keep: str | None = None) -> DataFrame:
    """Add ``outputs`` computed by ``fn`` on whole entities in order, none larger than a chunk (``whole_entities``). ``keep`` names an
    output that says which rows stay, and is dropped."""
    cols = list(df.columns)
    shown = {n: t for n, t in outputs.items() if n != keep}
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in shown.items()]])

    def one(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        got = fn(x)
        return {n: got[n] for n in outputs}

    def finish(t: pa.Table, got: dict[str, np.ndarray]) -> pa.Table:
        out = t.select(cols)
        for n, kind in shown.items():
            out = out.append_column(n, pa.array(got[n], type=_ARROW[kind], from_pandas=True))
        return out.filter(pa.array(np.asarray(got[keep], bool))) if keep else out

    return sorted_apply(df, list(axis.keys), list(axis.order), one, inputs, finish, schema)
