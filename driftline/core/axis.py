"""The ordered axis of an entity, cut into chunks of bounded size.

Every order-dependent operator takes an ``Axis``. A window partitioned by the entity alone would put a
whole recording into one task; here windows are partitioned by ``(entity, chunk)`` and the little that
crosses a chunk edge travels in a table with one row per chunk (see ``core.scan``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

CHUNK = "__chunk"
DAY_US = 86_400_000_000
WIDTH_CONF = "driftline.chunk.seconds"
#: Rows of a scan or a grid that a task gets on average at the most: about 1 GB where it sorts them both ways.
ROWS_A_TASK = 1_000_000


@dataclass(frozen=True)
class Axis:
    """Entity ``keys`` (non-null), total ``order`` columns (first one is the axis position) and the chunk width.

    ``width`` is in microseconds for timestamp axes and in units of the column for integer axes.
    ``rows`` is the row count aimed at per chunk for row-indexed frames. ``tasks`` is how many tasks its rows want; where the session
    has fewer shuffle partitions, chunks are dealt to that many, as adaptive execution joins partitions but does not add any.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    width: int = 30 * DAY_US
    rows: int = 1_000_000
    tasks: int = 0

    @property
    def ts(self) -> str:
        return self.order[0]

    def pos(self, df: DataFrame) -> Column:
        """Axis position as BIGINT."""
        return position(df, self.ts)

    def chunk(self, df: DataFrame) -> Column:
        return F.floor(self.pos(df) / F.lit(self.width)).cast("bigint")

    def ord(self) -> Column:
        return F.struct(*self.order)

    def dealt(self, df: DataFrame, *by: str) -> DataFrame:
        """``df`` dealt by ``by``, which a window over them needs, to ``tasks`` tasks if the session's number is less."""
        return df.repartition(self.tasks, *by) if self.tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df

    def for_rows(self, rows: int) -> "Axis":
        """The axis with tasks for so many rows, or for more that it has already."""
        return replace(self, tasks=max(self.tasks, -(-rows // ROWS_A_TASK)))

    def with_(self, **kw) -> "Axis":
        return replace(self, **kw)


def position(df: DataFrame, name: str) -> Column:
    t = df.schema[name].dataType
    if isinstance(t, T.TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType)):
        return F.col(name).cast("bigint")
    raise TypeError(f"axis column {name} must be TIMESTAMP or an integer, got {t.simpleString()}")


def fit_axis(
    df: DataFrame,
    keys: list[str] | tuple[str, ...],
    order: list[str] | tuple[str, ...],
    target_rows: int = 1_000_000,
    probe_width: int = DAY_US,
) -> Axis:
    """Choose a chunk width so that the fullest (entity, chunk) holds about ``target_rows`` rows.

    One map-side-combined count over the key and time columns only; it is repeated at a finer width until
    the fullest chunk is near the target or a chunk is a single instant, so a burst inside one entity is also cut.
    ``driftline.chunk.seconds`` in the session configuration overrides the probe.
    """
    forced = df.sparkSession.conf.get(WIDTH_CONF, None)
    axis = Axis(tuple(keys), tuple(order), probe_width, target_rows)
    if forced:
        return axis.with_(width=max(1, int(float(forced) * 1_000_000)))
    width = probe_width
    while True:
        probe = axis.with_(width=width)
        fullest, rows = df.groupBy(*keys, probe.chunk(df).alias(CHUNK)).count().agg(F.max("count"), F.sum("count")).first()
        fullest, axis = fullest or 1, axis.for_rows(rows or 0)
        if width == probe_width and fullest <= target_rows:
            return axis.with_(width=min(width * max(1, target_rows // fullest), 36_500 * DAY_US))
        if fullest <= 2 * target_rows or width <= 1:
            break
        width = max(1, width * target_rows // fullest)
    return axis.with_(width=width)
