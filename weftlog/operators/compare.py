"""Hypothesis tests on pairs of logs: cost, resampling and p-value put together."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions.checkpoints import materialise, shuffles_freed
from weftlog.functions.columns import ACTIVITY, START, TIME, col
from weftlog.operators import binning, distance, extract, prepare, resample, transport, whole_pairs
from weftlog.operators.language import both_sides, population, variants

# Messages that users of the tests rely on.
EMPTY_LOG = "Cannot compare with an empty event log"
INVALID_STYLE = "Invalid bootstrapping style: {}. Must be 'replacement' or 'split'."

DENSE = 2000  # variants of one comparison up to which its matrix travels as one row (32 MB)
BINNERS = {"kmeans": binning.fit_kmeans_seeds, "iqr": binning.fit_iqr, "outer_percentile": binning.fit_outer_percentiles}


def distances(draws: DataFrame, vs: DataFrame, cost: str | Callable) -> DataFrame:
    """Distances of replicates under a cost.

    ``discrete``, ``line``, ``levenshtein`` (post-normalised), ``weighted``
    (binned traces), ``weighted:N`` (the same scaled to N bins), or a function of
    two struct columns.
    """
    if cost == "discrete":
        return transport.solve_discrete(draws)
    if cost == "line":
        return transport.solve_line(draws, vs.select("pair_id", "variant_id", F.size("trace").alias("position")))
    if cost == "levenshtein":
        return _solved(draws, vs, lambda v: distance.cost_matrix(distance.encoded(v), distance.postnormalised))
    if isinstance(cost, str) and cost.startswith("weighted"):
        bins = cost.partition(":")[2]
        return _solved(draws, vs, lambda v: distance.weighted_matrix(v, int(bins) if bins else None))
    if callable(cost):
        return _solved(draws, vs, lambda v: distance.cost_matrix(v, cost, symmetric=False), mirrored=False)
    raise ValueError(f"unknown cost: {cost}")


def _solved(draws: DataFrame, vs: DataFrame, matrix: Callable[[DataFrame], DataFrame], mirrored: bool = True) -> DataFrame:
    """Exact distances; comparisons of more variants than fit one row as a dense matrix travel row by row."""
    large = vs.where(F.col("variant_id") >= DENSE).select("pair_id").distinct()
    if not large.take(1):
        return transport.solve_exact(draws, matrix(vs), mirrored=mirrored)
    large = materialise(large)
    small = transport.solve_exact(draws.join(large, "pair_id", "left_anti"), matrix(vs.join(large, "pair_id", "left_anti")), mirrored=mirrored)
    return small.unionByName(transport.solve_rows(draws.join(large, "pair_id", "left_semi"), matrix(vs.join(large, "pair_id", "left_semi")), mirrored=mirrored))


def share_beyond(null: DataFrame, actual: DataFrame, strict: bool) -> DataFrame:
    """p-values: the share of replicates above (``strict``) or at least at the logs' distance."""
    beyond = F.col("emd") > F.col("logs_emd") if strict else F.col("emd") >= F.col("logs_emd")
    joined = null.join(actual, "pair_id")
    return joined.groupBy("pair_id").agg(F.first("logs_emd").alias("logs_emd"), F.avg(F.when(beyond, F.lit(1).cast("double")).otherwise(F.lit(0).cast("double"))).alias("pvalue"), F.count(F.lit(1)).alias("n_replicates"))


def ks_greater(reference: DataFrame, logs: DataFrame) -> DataFrame:
    """One-sided two-sample Kolmogorov-Smirnov test: ``pair_id, statistic, pvalue``.

    The statistic is the greatest excess of the reference's distribution
    function over the logs', taken where all ties of a value are in. Both
    sides have the same number n of values, so the p-value is an exact product
    over lattice paths with as many factors as the statistic has n-ths.
    """
    both = reference.select("pair_id", "emd", F.lit(1).alias("r"), F.lit(0).alias("l")).unionByName(logs.select("pair_id", "emd", F.lit(0).alias("r"), F.lit(1).alias("l")))
    points = both.groupBy("pair_id", "emd").agg(F.sum("r").alias("r"), F.sum("l").alias("l"))
    along = Window.partitionBy("pair_id").orderBy("emd")
    ahead = points.withColumn("ahead", F.sum(F.col("r") - F.col("l")).over(along))
    return _ks_values(ahead.groupBy("pair_id").agg(F.greatest(F.max("ahead"), F.lit(0)).alias("h"), F.sum("r").alias("n")))


def _ks_values(found: DataFrame) -> DataFrame:
    """Statistic and p-value from the greatest excess ``h`` of ``n`` values."""
    factors = F.transform(F.sequence(F.lit(0), F.col("h").cast("int") - 1), lambda j: F.log((F.col("n") - j).cast("double")) - F.log((F.col("n") + j + 1).cast("double")))
    exact = F.when(F.col("h") == 0, F.lit(1.0)).otherwise(F.exp(F.aggregate(factors, F.lit(0.0), lambda s, x: s + x)))
    return found.select("pair_id", (F.col("h") / F.col("n")).alias("statistic"), exact.alias("pvalue"))


def _apart(pop: DataFrame, cost: str | Callable, n: int, lone: bool = False) -> tuple[DataFrame | None, DataFrame | None, bool]:
    """A population of many pairs as rows that hold a small pair each, what is left of it (None: nothing), and whether pairs are cut into several rows.

    One comparison alone goes the other way, whose replicates are spread over tasks. With ``lone``, pairs that lack a side are left out.
    """
    if n < 1 or not whole_pairs.fits(pop, cost):
        return None, both_sides(pop) if lone else pop, False
    with shuffles_freed(pop.sparkSession):
        sizes = whole_pairs.sizes(pop, lone)
        small = [F.coalesce(f(F.when(~F.col("large"), F.col(c))), F.lit(0)) for f, c in ((F.sum, "cases"), (F.max, "steps"))]
        pairs, large, *most = sizes.agg(F.count(F.lit(1)), F.count_if("large"), *small).first()
    if pairs - large < 2:
        return None, both_sides(pop) if lone else pop, False
    parts, shares = whole_pairs.parts(pop.sparkSession, n, pairs - large), whole_pairs.shares(*most)
    if not large:
        return whole_pairs.blocks(pop, n, parts, lone, shares), None, parts > 1
    where = materialise(sizes.where("large").select("pair_id"))
    return whole_pairs.blocks(pop.join(where, "pair_id", "left_anti"), n, parts, lone, shares), pop.join(where, "pair_id", "left_semi"), parts > 1


def run_test(pop: DataFrame, test: str = "permutation", cost: str | Callable = "levenshtein", n: int = 10_000, seed: int = 0, resample_size: int | float | None = None, sampler: str = "hash", lone: bool = False) -> tuple[DataFrame, DataFrame]:
    """Null distribution ``pair_id, rep, emd`` and p-values ``pair_id, logs_emd, pvalue, n_replicates`` of a population's pairs.

    Permutation tests count replicates strictly above the logs' distance,
    bootstrap tests also those at it. ``sampler`` is ``hash`` (inside Spark) or
    ``numpy`` (the public random streams, for one small pair). With ``lone``,
    pairs may lack a side and are then left out.
    """
    strict = test == "permutation"
    rows, rest, _ = _apart(pop, cost, n, lone) if sampler == "hash" else (None, both_sides(pop) if lone else pop, False)
    null = found = None
    if rows is not None:
        null = whole_pairs.judged(rows, [test], cost, seed, resample_size, "rows").select("pair_id", "rep", F.col("emd1").alias("emd"))
        counts = whole_pairs.judged(rows, [test], cost, seed, resample_size, "above" if strict else "reached").groupBy("pair_id")
        found = counts.agg(F.first("logs_emd").alias("logs_emd"), (F.sum("beyond") / F.sum("n")).alias("pvalue"), F.sum("n").alias("n_replicates"))
        if rest is None:
            return null, found
    vs = materialise(variants(rest))
    actual = distances(resample.observed(vs), vs, cost).select("pair_id", F.col("emd").alias("logs_emd"))
    if sampler == "numpy":
        draws = resample.numpy_test(rest, vs, test, n, seed, resample_size)
    elif sampler == "hash":
        draws = resample.replicates(rest, vs, test, n, seed, resample_size)
    else:
        raise ValueError(f"unknown sampler: {sampler}; hash or numpy")
    others = distances(draws, vs, cost)
    judged = share_beyond(others, actual, strict)
    return (others, judged) if null is None else (null.unionByName(others), found.unionByName(judged))


def run_double_test(pop: DataFrame, style: str = "smaller", cost: str | Callable = "levenshtein", n: int = 10_000, seed: int = 0, lone: bool = False) -> DataFrame:
    """Double bootstrap: the share of log 1's distances to itself that reach the mean distance to log 2.

    The larger log of a pair is taken as log 1. ``smaller`` draws as many cases
    as the smaller log has; ``split_variants`` draws from two halves of log 1's
    variants. Returns ``pair_id, logs_emd`` (the mean) ``, pvalue, n_replicates``.
    """
    if style not in ("smaller", "split_variants"):
        raise ValueError(f"unknown style: {style}")
    tests = ("own", "smaller") if style == "smaller" else ("split_variants", "halves")
    rows, rest, cut = _apart(pop, cost, n, lone)
    found = None
    if rows is not None and cut:
        own, other = (_rows(rows, test, cost, seed, turn=True) for test in tests)
        found = _mean_reached(own, other)
    elif rows is not None:
        found = whole_pairs.judged(rows, [*tests], cost, seed, None, "mean", turn=True)
        found = found.select("pair_id", "logs_emd", (F.col("beyond") / F.col("n")).alias("pvalue"), F.col("n").alias("n_replicates"))
    if rest is None:
        return found
    sizes = rest.groupBy("pair_id").agg((F.count_if(F.col("side") == 1) < F.count_if(F.col("side") == 2)).alias("swap"))
    turned = rest.join(sizes, "pair_id").withColumn("side", F.when(F.col("swap"), 3 - F.col("side")).otherwise(F.col("side"))).drop("swap")
    vs = materialise(variants(turned))
    others = _mean_reached(*(distances(resample.replicates(turned, vs, test, n, seed), vs, cost) for test in tests))
    return others if found is None else found.unionByName(others)


def _mean_reached(reference: DataFrame, logs: DataFrame) -> DataFrame:
    return share_beyond(reference, logs.groupBy("pair_id").agg(F.avg("emd").alias("logs_emd")), strict=False)


def _rows(rows: DataFrame, test: str, cost: str, seed: int, turn: bool = False) -> DataFrame:
    return whole_pairs.judged(rows, [test], cost, seed, None, "rows", turn).select("pair_id", "rep", F.col("emd1").alias("emd")).dropna()


def run_ks_test(pop: DataFrame, style: str = "replacement", cost: str | Callable = "levenshtein", n: int = 10_000, seed: int = 0, lone: bool = False) -> DataFrame:
    """Kolmogorov-Smirnov test of log 1's distances to itself against those between the logs."""
    if style not in ("replacement", "split"):
        raise ValueError(INVALID_STYLE.format(style))
    tests = ("resample" if style == "replacement" else "split", "between")
    rows, rest, cut = _apart(pop, cost, n, lone)
    found = None
    if rows is not None and cut:
        found = ks_greater(*(_rows(rows, test, cost, seed) for test in tests))
    elif rows is not None:
        found = _ks_values(whole_pairs.judged(rows, [*tests], cost, seed, None, "excess"))
    if rest is None:
        return found
    vs = materialise(variants(rest))
    others = ks_greater(*(distances(resample.replicates(rest, vs, test, n, seed), vs, cost) for test in tests))
    return others if found is None else found.unionByName(others)


def null_histogram(null: DataFrame, bins: int = 50) -> DataFrame:
    """Equi-width histogram of every pair's null distribution: ``pair_id, bin, n``; a single value is bin 0."""
    span = Window.partitionBy("pair_id")
    sized = null.withColumns({"lo": F.min("emd").over(span), "hi": F.max("emd").over(span)})
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("emd") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(F.lit(0))
    return sized.groupBy("pair_id", place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Comparison:
    """Result of comparing two logs."""

    pvalue: float
    logs_emd: float | None
    null_distribution: DataFrame | None
    runtime: float

    def histogram(self, bins: int = 50) -> DataFrame:
        return null_histogram(self.null_distribution, bins)


@dataclass
class LogComparator:
    """Compare two event logs.

    ``representation``: ``control_flow`` (activities), ``timed`` (activities
    with binned service times) or ``numeric`` (activities with the binned
    ``column``). ``test``: ``permutation``, ``replacement``, ``split``,
    ``resample``, ``classic``, ``double_smaller``, ``double_split_variants``,
    ``ks_replacement`` or ``ks_split``. ``cost`` replaces the representation's
    own distance by a function of two struct columns with ``trace``, which need
    not be symmetric. ``binner`` is ``kmeans`` (with ``k``, 3 unless given),
    ``outer_percentile`` (with ``outer_percent``), ``iqr`` or a function (a table
    ``label, value`` in, a model out); ``binner_args`` are its further
    arguments. Without ``resample_size`` the tests ``replacement`` and
    ``resample`` draw as many cases as log 1 has, those without a trace
    counted; a float is a share of that. Results can be read after
    :meth:`compare`.
    """

    log_1: DataFrame
    log_2: DataFrame
    representation: str = "control_flow"
    test: str = "permutation"
    column: str | None = None
    distribution_size: int = 10_000
    resample_size: int | float | None = None
    seed: int = 0
    cost: Callable | None = None
    binner: str | Callable = "kmeans"
    binner_args: dict | None = None
    sampler: str = "hash"
    weighted_time_cost: bool = False
    on_ambiguous: str = "error"
    _result: Comparison | None = field(default=None, repr=False)

    def extract(self) -> tuple[DataFrame, str | Callable]:
        """The population of the two logs and the distance between its traces."""
        if self.representation == "control_flow":
            return population(extract.extract_traces(self.log_1), extract.extract_traces(self.log_2)), self.cost or "levenshtein"
        if self.representation == "timed":
            logs = [prepare.ensure_start(log, on_ambiguous=self.on_ambiguous) for log in (self.log_1, self.log_2)]
            values = [log.withColumn("_number", prepare.seconds_between(log, START, TIME)) for log in logs]
        elif self.representation == "numeric":
            if not self.column:
                raise ValueError("the numeric representation needs a column")
            values = [log.withColumn("_number", col(self.column).cast("double")) for log in (self.log_1, self.log_2)]
        else:
            raise ValueError(f"unknown representation: {self.representation}")
        pooled = values[0].select(col(ACTIVITY).alias("label"), F.col("_number").alias("value")).unionByName(values[1].select(col(ACTIVITY).alias("label"), F.col("_number").alias("value")))
        model = materialise(self._fitted(pooled))
        pop = population(*[extract.extract_binned_traces(v, "_number", model) for v in values])
        bins = binning.num_bins(model) if self.weighted_time_cost else None
        return pop, self.cost or (f"weighted:{bins}" if bins is not None else "weighted")

    def _fitted(self, values: DataFrame) -> DataFrame:
        arguments = dict(self.binner_args or {})
        if callable(self.binner):
            return self.binner(values, **arguments)
        if self.binner not in BINNERS:
            raise ValueError(f"unknown binner: {self.binner}; one of {', '.join(BINNERS)}")
        if self.binner == "kmeans":
            arguments = {"k": 3, "seed": self.seed} | arguments
        return BINNERS[self.binner](values, **arguments)

    def compare(self) -> Comparison:
        """Run the test. Empty logs raise ValueError."""
        began = time.monotonic()
        pop, cost = self.extract()
        pop = materialise(pop)
        if pop.select("side").distinct().count() < 2:
            raise ValueError(EMPTY_LOG)
        null, logs_emd = None, None
        if self.test.startswith("double_"):
            row = run_double_test(pop, self.test.removeprefix("double_"), cost, self.distribution_size, self.seed).first()
            logs_emd = row["logs_emd"]
        elif self.test.startswith("ks_"):
            row = run_ks_test(pop, self.test.removeprefix("ks_"), cost, self.distribution_size, self.seed).first()
        else:
            size = self.resample_size
            if self.test in ("replacement", "resample") and (size is None or isinstance(size, float)):
                size = math.floor((1.0 if size is None else size) * prepare.log_len(self.log_1).first()[0])
            null, row = run_test(pop, self.test, cost, self.distribution_size, self.seed, size, self.sampler)
            null = materialise(null)
            actual = row.select("logs_emd").distinct().first()["logs_emd"]
            row = share_beyond(null, null.sparkSession.createDataFrame([(0, actual)], "pair_id long, logs_emd double"), self.test == "permutation").first()
            logs_emd = actual
        self._result = Comparison(row["pvalue"], logs_emd, null, time.monotonic() - began)
        return self._result

    @property
    def result(self) -> Comparison:
        if self._result is None:
            raise ValueError("compare() has not been called")
        return self._result

    @property
    def pvalue(self) -> float:
        return self.result.pvalue
