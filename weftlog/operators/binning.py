"""Learned discretisation of numbers per label.

A fitted model is a table ``label, kind, edges, num_bins``: ``edges`` are
either bounds (a value's bin is the number of bounds that it reaches) or
centres (its bin is the nearest, ties to the lower).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions.checkpoints import materialise
from weftlog.functions.columns import shuffle_partitions

MODEL = "label string, kind string, edges array<double>, num_bins int"


def bin_column(value: Column, kind: str | Column = "kind", edges: str | Column = "edges") -> Column:
    """Bin of ``value`` under the model columns of its row; 0 where the row has no model."""
    bounds = F.size(F.filter(edges, lambda e: e <= value))
    away = F.transform(edges, lambda e: F.abs(e - value))
    nearest = F.array_position(away, F.array_min(away)).cast("int") - 1
    return F.coalesce(F.when(value.isNull(), F.lit(0)).when((F.col(kind) if isinstance(kind, str) else kind) == "bounds", bounds).otherwise(nearest), F.lit(0))


def fit_percentiles(values: DataFrame, low: float = 25.0, high: float = 75.0, label: str = "label", value: str = "value") -> DataFrame:
    """Three bins per label: below the low percentile, below the high one, the rest.

    Percentiles are exact with linear interpolation; null values are not seen.
    Equal values become one with a count, and the values at the ranks around
    each percentile are found by running counts over range partitions, so no
    task holds a label's values.
    """
    weighed = _weighed(values, label, value, None)
    n = weighed.groupBy("label").agg(F.sum("w").alias("n"))
    shares = [F.lit(low / 100), F.lit(high / 100)]
    places = [(F.col("n") - 1) * s for s in shares]
    ranks = F.array(*[edge(p) + 1 for p in places for edge in (F.floor, F.ceil)])
    found = _reached(weighed, F.col("w"), n.select("label", F.transform(ranks, lambda r: r.cast("double")).alias("goals"), F.lit(False).alias("relative"))).join(n, "label")
    below, above = [[F.get("drawn", F.lit(2 * i + k)) for i in (0, 1)] for k in (0, 1)]
    edges = F.array(*[b + (a - b) * (p - F.floor(p)) for a, b, p in zip(above, below, places)])
    return found.select("label", F.lit("bounds").alias("kind"), edges.alias("edges"), F.lit(3).alias("num_bins"))


def fit_iqr(values: DataFrame, **names: str) -> DataFrame:
    """Bins below the first quartile, up to the third, and from there on."""
    return fit_percentiles(values, 25.0, 75.0, **names)


def fit_outer_percentiles(values: DataFrame, outer_percent: float = 10.0, **names: str) -> DataFrame:
    """Bins that cut off ``outer_percent`` at both ends."""
    return fit_percentiles(values, outer_percent, 100.0 - outer_percent, **names)


def greedy_centres(values: np.ndarray, k: int, seed: int | None, trials: int = 10) -> np.ndarray:
    """Greedy k-means++ seeding: centres are data points, each the best of ``trials`` drawn by squared distance."""
    rng = np.random.RandomState(seed)
    k = min(k, len(values))
    centres = [values[rng.choice(len(values))]]
    nearest = (values - centres[0]) ** 2
    while len(centres) < k:
        mass = np.cumsum(nearest)
        drawn = np.minimum(np.searchsorted(mass, rng.uniform(size=trials) * mass[-1]), len(values) - 1)
        left = np.minimum(nearest[None, :], (values[None, :] - values[drawn][:, None]) ** 2)
        best = int(left.sum(axis=1).argmin())
        centres.append(values[drawn[best]])
        nearest = left[best]
    return np.sort(np.asarray(centres, dtype=float))


def _weighed(values: DataFrame, label: str, value: str, order: str | None) -> DataFrame:
    """``label, value, o, w, part``: equal rows as one with a weight, in the order of label, ``order`` and value over parts."""
    rows = values.where(F.col(label).isNotNull() & F.col(value).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(value).cast("double").alias("value"), (F.col(order) if order else F.lit(0)).cast("long").alias("o"))
    weighed = rows.groupBy("label", "value", "o").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return materialise(weighed.repartitionByRange(shuffle_partitions(values.sparkSession), "label", "o", "value").withColumn("part", F.spark_partition_id()))


def _reached(rows: DataFrame, mass: Column, goals: DataFrame) -> DataFrame:
    """Per label the values at which the running sum of ``mass``, in the order of ``o`` and value, reaches the label's goals.

    ``goals`` is ``label, goals, relative``: relative goals are shares of the
    label's sum. Running sums are taken inside parts of the order and carried
    over by sums of parts. Returns ``label, drawn`` in the order of the goals.
    """
    rows = rows.withColumn("m", mass)
    along = Window.partitionBy("label").orderBy("part")
    parts = rows.groupBy("label", "part").agg(F.sum("m").alias("m")).withColumn("upto", F.sum("m").over(along))
    parts = parts.withColumns({"before": F.lag("upto").over(along), "total": F.max("upto").over(Window.partitionBy("label"))})
    asked = parts.join(goals, "label").select("label", "part", "upto", "before", "total", "relative", F.posexplode("goals").alias("trial", "goal"))
    asked = asked.withColumn("goal", F.when(F.col("relative"), F.col("goal") * F.col("total")).otherwise(F.col("goal")))
    asked = asked.where("goal <= upto and (before is null or goal > before)").select("label", "part", "trial", "goal", F.coalesce("before", F.lit(0.0)).alias("before"))
    order = F.struct("o", "value")
    inside = Window.partitionBy("label", "part").orderBy("o", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.join(asked.select("label", "part").distinct(), ["label", "part"], "left_semi").withColumn("sum", F.sum("m").over(inside))
    # Where rounding leaves a part's running sum below the goal, its last value of any mass is taken.
    first = F.min_by("value", F.when(F.col("before") + F.col("sum") >= F.col("goal"), order))
    found = near.join(asked, ["label", "part"]).groupBy("label", "trial").agg(F.coalesce(first, F.max_by("value", F.when(F.col("m") > 0, order))).alias("value"))
    return found.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("trial", "value")))["value"].alias("drawn"))


def fit_kmeans_seeds(values: DataFrame, k: int = 3, seed: int | None = None, label: str = "label", value: str = "value", order: str | None = None, trials: int = 10) -> DataFrame:
    """Centres per label by k-means++ seeding (no further iterations), drawn from the label's values.

    The same as ``greedy_centres`` of the label's values in the order of
    ``order`` (then of value), from all of them: equal rows become one with a
    weight, and each of the ``k - 1`` rounds draws and judges its trials by sums
    over all rows, so no task holds a label's values.
    """
    weighed = _weighed(values, label, value, order)

    def draws(n):
        rng = np.random.RandomState(seed)
        return [float(rng.choice(int(n)) + 1), *rng.uniform(size=max(0, min(k, int(n)) - 1) * trials).tolist()]

    state = materialise(weighed.groupBy("label").agg(F.sum("w").alias("n")).withColumn("draws", F.udf(draws, "array<double>")("n")))
    goals = state.select("label", F.slice("draws", 1, 1).alias("goals"), F.lit(False).alias("relative"))
    state = materialise(state.join(_reached(weighed, F.col("w"), goals), "label").withColumnRenamed("drawn", "centres"))

    def away(centres: Column) -> Column:
        return F.array_min(F.transform(centres, lambda c: (F.col("value") - c) * (F.col("value") - c)))

    for done in range(1, k):
        open_ = state.where(F.col("n") > done)
        left = weighed.join(open_.select("label", "centres"), "label").withColumn("nearest", away(F.col("centres"))).drop("centres")
        goals = open_.select("label", F.slice("draws", 2 + (done - 1) * trials, trials).alias("goals"), F.lit(True).alias("relative"))
        drawn = materialise(_reached(left, F.col("w") * F.col("nearest"), goals))
        rest = [F.sum(F.col("w") * F.least("nearest", away(F.array(F.col("drawn")[t])))) for t in range(trials)]
        judged = left.join(drawn, "label").groupBy("label", "drawn").agg(F.array(*rest).alias("rest"))
        best = judged.select("label", F.element_at("drawn", F.array_position("rest", F.array_min("rest")).cast("int")).alias("best"))
        state = materialise(state.join(best, "label", "left").select("label", "n", "draws", F.when(F.col("best").isNull(), F.col("centres")).otherwise(F.array_append("centres", F.col("best"))).alias("centres")))
    return state.select("label", F.lit("centres").alias("kind"), F.array_sort("centres").alias("edges"), F.size("centres").alias("num_bins"))


def fit_custom(values: DataFrame, factory: Callable[[list[float]], list[float]], label: str = "label", value: str = "value") -> DataFrame:
    """Bounds per label from a user's function of the label's values (the label's values must fit one task)."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        edges = sorted(float(x) for x in factory(group["value"].tolist()))
        return pd.DataFrame([(group["label"].iloc[0], "bounds", edges, len(edges) + 1)], columns=["label", "kind", "edges", "num_bins"])

    rows = values.where(F.col(label).isNotNull() & F.col(value).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("label").applyInPandas(fit, MODEL)


def num_bins(model: DataFrame) -> int:
    """The most bins of any label."""
    return model.agg(F.coalesce(F.max("num_bins"), F.lit(1))).first()[0]
