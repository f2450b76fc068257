"""Traces: one ordered array per case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.functions.columns import ACTIVITY, CASE, LIFECYCLE, ORD, START, TIME, col, micros
from weftlog.operators.prepare import DURATION, seconds_between


def _traces(rows: DataFrame, payload: Column, tiebreak: str | None, time: str, case: str, ordinal: str) -> DataFrame:
    order = [micros(rows, time).alias("t"), (col(tiebreak) if tiebreak else F.lit(0)).alias("b"), col(ordinal).alias("o")]
    kept = rows.where(col(case).isNotNull() & col(time).isNotNull()).select(col(case).alias("case_id"), F.struct(*order).alias("k"), payload.alias("v"))
    return kept.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("k", "v")))["v"].alias("trace"), F.min("k").alias("case_order"))


def extract_traces(log: DataFrame, complete_only: bool = True, tiebreak: str | None = ACTIVITY, activity: str = ACTIVITY, time: str = TIME, case: str = CASE, ordinal: str = ORD) -> DataFrame:
    """``case_id, trace array<string>, case_order``: the activities of every case by time.

    Where the log has a lifecycle column and ``complete_only`` is set, only
    ``complete`` rows count. Ties in time are ordered by ``tiebreak``, then the
    ordinal. ``case_order`` orders cases by their first event.

    Defined cases: rows with a null case or time are left out; a null activity
    stays a null step; an empty log gives no rows. A trace is one value, so a
    case must fit a row (2 GB); operators that need not hold whole traces work
    on events instead.
    """
    rows = log.where(col(LIFECYCLE) == "complete") if complete_only and LIFECYCLE in log.columns else log
    return _traces(rows, col(activity), tiebreak, time, case, ordinal)


def extract_valued_traces(log: DataFrame, value: str | Column, tiebreak: str | None = ACTIVITY, activity: str = ACTIVITY, time: str = TIME, case: str = CASE, ordinal: str = ORD) -> DataFrame:
    """Traces of ``struct<activity, value>`` with a numeric attribute; no lifecycle filter."""
    number = (value if isinstance(value, Column) else col(value)).cast("double")
    return _traces(log, F.struct(col(activity).alias("activity"), number.alias("value")), tiebreak, time, case, ordinal)


def extract_service_times(log: DataFrame, tiebreak: str | None = ACTIVITY, **names: str) -> DataFrame:
    """Traces of ``struct<activity, value>`` with seconds from start to end, computed where the log has none."""
    value = col(DURATION) if DURATION in log.columns else seconds_between(log, START, TIME)
    return extract_valued_traces(log, value, tiebreak, **names)


def extract_binned_traces(log: DataFrame, value: str | Column, model: DataFrame, tiebreak: str | None = ACTIVITY, activity: str = ACTIVITY, time: str = TIME, case: str = CASE, ordinal: str = ORD) -> DataFrame:
    """Traces of ``struct<activity, bin>``; values are binned by the ``model`` of their activity before collecting.

    Activities that the model does not know get bin 0.
    """
    from weftlog.operators.binning import bin_column

    number = (value if isinstance(value, Column) else col(value)).cast("double")
    needed = dict.fromkeys([case, activity, time, ordinal] + ([tiebreak] if tiebreak else []))
    rows = log.select(*[col(c) for c in needed], number.alias("_value")).join(model.select(F.col("label").alias("_label"), "kind", "edges"), col(activity) == F.col("_label"), "left")
    binned = rows.withColumn("_bin", bin_column(F.col("_value")))
    return _traces(binned, F.struct(col(activity).alias("activity"), F.col("_bin").alias("bin")), tiebreak, time, case, ordinal)
