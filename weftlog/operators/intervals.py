"""Continuous periods and gaps of overlapping time intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions.columns import CASE, DAY_US, START, TIME, col, micros, time_slices


def busy_spans(log: DataFrame, entity: str = CASE, start: str = START, end: str = TIME, width_us: int = 30 * DAY_US) -> DataFrame:
    """Maximal continuous periods per entity and the gaps between successive periods.

    Returns ``case_id, span_kind ('period' | 'gap'), from_us, to_us``.

    ``session_window`` with each row's own duration merges what overlaps. It
    drops empty durations and its view of touching sessions is not ours, so
    bounds are doubled and the end lengthened by one: points get a duration,
    touching intervals overlap, and intervals one microsecond apart do not.

    Sessions are formed per entity and time slice of the start (a third of all
    rows may belong to one entity, and most of them to one month), then stitched: a window over one summary
    row per slice carries the latest end so far; a session opens a period when
    it starts after that end; a period ends where the gap before the next
    opening begins (``lead``).

    Defined cases: rows with a null entity or bound, or whose start is after
    their end, are ignored; a point is an interval; repeated rows change
    nothing; an empty log gives no rows; other columns are not read.
    """
    rows = log.select(col(entity).cast("string").alias("case_id"), micros(log, start).alias("a"), micros(log, end).alias("b")).where("case_id is not null and a is not null and b is not null and a <= b")
    doubled = time_slices(rows, ["case_id"], "a", width_us).select(
        "case_id",
        "slice",
        F.timestamp_micros(F.col("a") * 2).alias("opens"),
        ((F.col("b") - F.col("a")) * 2 + 1).alias("lasts"),
    )
    length = F.expr("make_interval(0, 0, 0, 0, 0, 0, cast(lasts as decimal(20, 0)) / 1000000)")
    sessions = doubled.groupBy("case_id", "slice", F.session_window("opens", length).alias("w")).agg(F.count(F.lit(1)).alias("rows"))
    pieces = sessions.select("case_id", "slice", F.expr("unix_micros(w.start) div 2").alias("a"), F.expr("(unix_micros(w.end) - 1) div 2").alias("b"))

    slices = Window.partitionBy("case_id").orderBy("slice")
    inside = Window.partitionBy("case_id", "slice").orderBy("a")
    carried = (
        pieces.groupBy("case_id", "slice")
        .agg(F.max("b").alias("latest"))
        .select("case_id", "slice", F.max("latest").over(slices.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"), F.max("latest").over(Window.partitionBy("case_id")).alias("final"))
    )
    openings = (
        pieces.withColumn("before", F.lag("b").over(inside))
        .join(carried, ["case_id", "slice"])
        .select("case_id", "slice", "a", F.greatest("before", "carry").alias("idle_from"), "final")
        .where("idle_from is null or a > idle_from")
    )
    following = openings.groupBy("case_id", "slice").agg(F.min_by("idle_from", "a").alias("first_idle")).select("case_id", "slice", F.lead("first_idle").over(slices).alias("next_idle"))
    closed = openings.withColumn("ends", F.lead("idle_from").over(inside)).join(following, ["case_id", "slice"]).select("case_id", "a", "idle_from", F.coalesce("ends", "next_idle", "final").alias("b"))
    spans = F.array(
        F.struct(F.lit("period").alias("span_kind"), F.col("a").alias("from_us"), F.col("b").alias("to_us")),
        F.struct(F.lit("gap").alias("span_kind"), F.col("idle_from").alias("from_us"), F.col("a").alias("to_us")),
    )
    return closed.select("case_id", F.inline(spans)).where("from_us is not null")
