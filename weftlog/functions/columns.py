"""Names of the event-log columns and small column helpers.

Operators begin by projecting the columns they need onto short internal names
(``case_id``, ``activity``, ``ts_us``, ``ord``), so that extra columns of the
input, whatever they are called, never clash with theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The log format's column names and lifecycle vocabulary.
CASE = "case:concept:name"
ACTIVITY = "concept:name"
TIME = "time:timestamp"
START = "start_timestamp"
LIFECYCLE = "lifecycle:transition"
INSTANCE = "concept:instance"
ORD = "event_ord"
END_TRANSITIONS = ("complete", "ate_abort")
START_TRANSITIONS = ("start",)

DAY_US = 86_400_000_000

LARGE = 1_000_000  # rows of an entity's time slice beyond which it may be cut
MOST_HOT = 1000
PARTS = 64


def col(name: str) -> Column:
    """A top-level column whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp column, independent of the session's zone for zoneless columns."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col(name))
    quoted = "`" + name.replace("`", "``") + "`"
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {quoted})")
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return col(name).cast("long")
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({quoted} as timestamp_ntz))")


def first_of_repeats(df: DataFrame, ordinal: str = ORD) -> DataFrame:
    """Rows equal in all columns but the ordinal become one row with the smallest ordinal.

    Nulls count as equal. Partial aggregation combines repeats before the shuffle.
    """
    others = [c for c in df.columns if c != ordinal]
    return df.groupBy(*[col(c) for c in others]).agg(F.min(col(ordinal)).alias(ordinal))


def time_slices(rows: DataFrame, keys: list[str], time: str, width_us: int) -> DataFrame:
    """``rows`` with ``slice``, which grows with time: slices of ``width_us``, cut finer where one entity has very many rows in one.

    The ``MOST_HOT`` largest slices of more than ``LARGE`` rows are cut into up
    to ``PARTS`` of like size at approximate percentiles of their times; all
    others hold less than one in ``MOST_HOT`` of the rows. Only those cuts are
    broadcast, and no row is shuffled for them.
    """
    cut = rows.withColumn("slice", (F.floor(F.col(time) / F.lit(width_us)) * PARTS).cast("long"))
    counted = cut.groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > LARGE)
    hot = counted.orderBy(F.desc("_rows"), *keys, "slice").limit(MOST_HOT).select(*keys, "slice")
    if not counted.take(1):
        return cut
    places = cut.join(F.broadcast(hot), [*keys, "slice"], "left_semi").groupBy(*keys, "slice").agg(F.percentile_approx(time, [i / PARTS for i in range(1, PARTS)]).alias("_cuts"))
    finer = cut.join(F.broadcast(places), [*keys, "slice"], "left")
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(time))), F.lit(0))
    return finer.select(*[F.col(c) for c in rows.columns], (F.col("slice") + F.greatest(part, F.lit(0))).alias("slice"))


def sliced_lag(events: DataFrame, values: list[str], order: tuple[str, str] = ("ts_us", "ord"), entity: str | list[str] = "case_id", width_us: int = 30 * DAY_US) -> DataFrame:
    """Position and previous values of every event in its entity's order, without one task ever holding a whole entity.

    An entity is cut into :func:`time_slices`. Windows run inside a slice; what a slice needs from the ones before it (its offset, the values
    of the last event) is carried over by a window over slice summaries, one
    row per entity and slice. Adds ``slice``, ``pos`` (from 0) and
    ``prev_<value>`` (null for the entity's first event).

    Entities are not null. ``order[0]`` is in microseconds and not null; ties are ordered by
    ``order[1]``, which is unique. An empty input gives an empty result.
    """
    keys = [entity] if isinstance(entity, str) else entity
    cut = time_slices(events, keys, order[0], width_us)
    inside = Window.partitionBy(*keys, "slice").orderBy(*order)
    rows = cut.withColumn("_n", F.row_number().over(inside)).withColumns({f"_lag_{v}": F.lag(v).over(inside) for v in values})
    tails = cut.groupBy(*keys, "slice").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_tail"), F.count(F.lit(1)).alias("_rows"))
    over_slices = Window.partitionBy(*keys).orderBy("slice")
    heads = tails.select(
        *keys,
        "slice",
        F.lag("_tail").over(over_slices).alias("_before"),
        F.coalesce(F.sum("_rows").over(over_slices.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
    )
    joined = rows.join(heads, [*keys, "slice"])
    return joined.select(
        *[F.col(c) for c in events.columns],
        "slice",
        (F.col("_offset") + F.col("_n") - 1).alias("pos"),
        *[F.when(F.col("_n") == 1, F.col(f"_before.{v}")).otherwise(F.col(f"_lag_{v}")).alias(f"prev_{v}") for v in values],
    )


def shuffle_partitions(session) -> int:
    """Partitions of a shuffle that run-time coalescing leaves alone: as many as the session says, one for each core at least."""
    return max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores by ``keys``, for steps whose work is out of proportion to their bytes.

    A partition number that is asked for is not coalesced away at run time.
    """
    return df.repartition(shuffle_partitions(df.sparkSession), *keys)


def require(df: DataFrame, *names: str) -> None:
    """Raise ValueError unless all named columns are there."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
