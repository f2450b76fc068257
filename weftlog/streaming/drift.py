"""Structured Streaming: languages of arriving traces and their drift from a reference language."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions.columns import ACTIVITY, CASE, TIME, col


def windowed_activity_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour", time: str = TIME, activity: str = ACTIVITY) -> DataFrame:
    """Counts per activity and tumbling window of an event stream: ``window_start, activity, n``.

    Events later than ``late`` behind the watermark are dropped by Spark.
    """
    rows = events.select(col(time).cast("timestamp").alias("ts"), col(activity).alias("activity")).where("ts is not null and activity is not null")
    counts = rows.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "activity").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "activity", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = TIME, case: str = CASE) -> DataFrame:
    """Sessions of each case in an event stream: ``case_id, from_ts, to_ts, n``."""
    rows = events.select(col(time).cast("timestamp").alias("ts"), col(case).alias("case_id")).where("ts is not null and case_id is not null")
    found = rows.withWatermark("ts", late).groupBy("case_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("case_id", F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "n")


def drift(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """Distance of every window's activity frequencies to a reference ``activity, frequency``: ``window_start, drift``.

    Half the sum of absolute differences (0/1 cost), 0 for equal and 1 for
    disjoint distributions; for use on batches (``foreachBatch``).
    """
    shares = counts.select("window_start", "activity", (F.col("n") / F.sum("n").over(Window.partitionBy("window_start"))).alias("share"))
    # Reference mass of activities that a window lacks counts whole: 1 minus the reference mass that it shares.
    matched = shares.join(reference.select("activity", "frequency"), "activity", "left")
    apart = matched.groupBy("window_start").agg(F.sum(F.abs(F.col("share") - F.coalesce("frequency", F.lit(0.0)))).alias("inside"), F.sum(F.coalesce("frequency", F.lit(0.0))).alias("covered"))
    return apart.select("window_start", ((F.col("inside") + 1 - F.col("covered")) / 2).alias("drift"))
