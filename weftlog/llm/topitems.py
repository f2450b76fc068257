"""Most frequent values of a column, exactly and with bounded memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.functions.checkpoints import materialise
from weftlog.functions.columns import ACTIVITY, col


def field_values(trace_steps: DataFrame, languages: DataFrame) -> DataFrame:
    """The non-null values of both fields: ``field_name, item_key``.

    Every element of ``variants`` is one value, its steps joined with ``>``
    (null steps left out); null languages, null and empty arrays have none.
    """
    steps = trace_steps.select(F.lit(ACTIVITY).alias("field_name"), col(ACTIVITY).cast("string").alias("item_key"))
    variants = languages.select(F.explode("variants").alias("v")).where("v is not null").select(F.lit("variants").alias("field_name"), F.array_join("v", ">").alias("item_key"))
    return steps.where("item_key is not null").unionByName(variants)


def top_items(values: DataFrame, k: int = 199) -> DataFrame:
    """The ``k`` most frequent values of every field with exact counts: ``field_name, item_key, n, n_field``.

    One aggregation with map-side combining, the only pass over the values;
    hash partitions spill to disk, so memory does not grow with the number of
    distinct values. Counts are written once; ``limit`` after an
    order takes the top k of every partition before the final k. Ties: the
    value that sorts first. ``n_field`` is the number of non-null values.
    """
    counts = materialise(values.groupBy("field_name", "item_key").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("field_name").agg(F.sum("n").alias("n_field"))
    fields = [r["field_name"] for r in totals.select("field_name").collect()]
    best = None
    for name in fields:
        part = counts.where(F.col("field_name") == name).orderBy(F.desc("n"), "item_key").limit(k)
        best = part if best is None else best.unionByName(part)
    if best is None:
        best = counts.limit(0)
    return best.join(totals, "field_name").select("field_name", "item_key", "n", "n_field")


def heavy_items(values: DataFrame, one_in: int = 200, least: int = 5) -> DataFrame:
    """Values that make up more than one in ``one_in`` of their field's non-null values and occur ``least`` times.

    Fewer than ``one_in`` values can, so the top ``one_in - 1`` hold them all.
    """
    return top_items(values, one_in - 1).where((F.col("n") * one_in > F.col("n_field")) & (F.col("n") >= least)).select("field_name", "item_key")
