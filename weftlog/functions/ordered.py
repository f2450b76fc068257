"""Global order of events without a task that holds a whole entity."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions.checkpoints import materialise
from weftlog.functions.columns import shuffle_partitions

EDGES = "part int, cases long, first_case string, last_case string, last_us long"


def in_order(events: DataFrame, *order: str) -> DataFrame:
    """Rows sorted by ``order`` over range partitions of like size, written once to shared storage.

    ``order`` begins with the entity and ends with something unique inside it,
    so an entity with a third of all rows is cut like any other stretch of
    rows, at row counts and not at times. Tasks that read the result see
    whole, sorted partitions. Adds ``row_no``, which grows along the order
    (with jumps between partitions); rows of one partition whose
    ``row_no >> k`` agree are at most ``2 ** k`` neighbours.
    """
    n = shuffle_partitions(events.sparkSession)
    return materialise(events.repartitionByRange(n, *order).sortWithinPartitions(*order)).withColumn("row_no", F.monotonically_increasing_id())


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with ``number``, from 0 inside each key in ``order``, which is unique there; no task holds a whole key."""
    ordered = in_order(rows, key, *order).withColumn("_part", F.shiftright("row_no", 33))
    along = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("row_no").alias("_first"))
    parts = parts.select(key, "_part", (F.coalesce(F.sum("_n").over(along), F.lit(0)) - F.col("_first")).alias("_shift"))
    return ordered.join(parts, [key, "_part"]).select(*[F.col(c) for c in rows.columns], (F.col("row_no") + F.col("_shift")).cast("int").alias("number"))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cases, first, last, last_us = 0, None, None, None
    for batch in batches:
        if batch.num_rows:
            names = batch.column(0)
            head = names[0].as_py()
            cases += len(names.unique()) - (head == last)
            first = head if first is None else first
            last, last_us = names[-1].as_py(), batch.column(1)[-1].as_py()
    if cases:
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "cases": [cases], "first_case": [first], "last_case": [last], "last_us": [last_us]})


def before_parts(ordered: DataFrame) -> tuple[dict[int, tuple[int, str | None, int | None]], int]:
    """What comes before each partition of :func:`in_order` (the number of cases, the last case and its last time), and the number of all cases.

    A case that goes on in the next partition counts there as not yet new.
    One row per partition reaches the driver, however many events there are.
    """
    found = sorted(ordered.select("case_id", "ts_us").mapInArrow(_edges, EDGES).collect())
    out, cases, last, last_us = {}, 0, None, None
    for part, own, first, last_case, us in found:
        out[part] = (cases, last, last_us)
        cases, last, last_us = cases + own - (first == last), last_case, us
    return out, cases
