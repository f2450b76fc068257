"""Populations of traces and their stochastic languages.

A population is a table ``pair_id, side, case_id, trace``: the cases of many
small comparisons at once, each ``pair_id`` with the cases of its first log
(side 1) and its second (side 2). ``trace`` is any array that Spark can group
by. Comparing two logs is the case of a single pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.functions.ordered import numbered


def population(first: DataFrame, second: DataFrame, pair_id: int = 0) -> DataFrame:
    """The population of one comparison from the extracted traces of two logs."""
    sides = [t.select(F.lit(pair_id).cast("long").alias("pair_id"), F.lit(i).alias("side"), F.col("case_id").cast("string").alias("case_id"), "trace") for i, t in ((1, first), (2, second))]
    return sides[0].unionByName(sides[1])


def log_pairs(traces: DataFrame, log_number: str = "log_number") -> DataFrame:
    """Pairs of neighbouring logs: numbers 2k and 2k + 1 are the sides of pair k, which may lack one."""
    n = F.col(log_number)
    return traces.where(n.isNotNull()).select(F.floor(n / 2).cast("long").alias("pair_id"), (F.pmod(n, F.lit(2)) + 1).cast("int").alias("side"), F.col("case_id").cast("string").alias("case_id"), "trace")


def both_sides(pop: DataFrame) -> DataFrame:
    """Without the pairs that lack a side, which cannot be compared."""
    whole = pop.groupBy("pair_id").agg(F.countDistinct("side").alias("sides")).where("sides = 2").select("pair_id")
    return pop.join(whole, "pair_id", "left_semi")


def paired_population(traces: DataFrame, log_number: str = "log_number") -> DataFrame:
    """Pairs of neighbouring logs: numbers 2k and 2k + 1 are the sides of pair k.

    Pairs that lack a side cannot be compared and are left out.
    """
    return both_sides(log_pairs(traces, log_number))


def variants(pop: DataFrame) -> DataFrame:
    """Distinct traces of every pair: ``pair_id, variant_id, trace, c1, c2, n1, n2``.

    ``c1`` and ``c2`` count the cases of each side, ``n1`` and ``n2`` are the
    sides' sizes. Variants are numbered from 0 in order of their first case,
    those of side 1 first.
    """
    counted = pop.groupBy("pair_id", "trace").agg(F.count_if(F.col("side") == 1).alias("c1"), F.count_if(F.col("side") == 2).alias("c2"), F.min(F.struct("side", "case_id")).alias("first"))
    sizes = pop.groupBy("pair_id").agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2"))
    return numbered(counted, "pair_id", "first").join(sizes, "pair_id").select("pair_id", F.col("number").alias("variant_id"), "trace", "c1", "c2", "n1", "n2")


def stochastic_language(traces: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Variants and relative frequencies of a table of traces, per ``keys``: ``..., trace, n, frequency``."""
    keys = keys or []
    counts = traces.groupBy(*keys, "trace").agg(F.count(F.lit(1)).alias("n"))
    sums = traces.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    # Without keys the totals are a single row.
    whole = counts.join(sums, keys) if keys else counts.join(F.broadcast(sums))
    return whole.withColumn("frequency", F.col("n") / F.col("total")).drop("total")
