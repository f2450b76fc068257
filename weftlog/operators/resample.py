"""Replicates of resampling tests: which variants each side of each replicate has, and how often.

The hash sampler orders and draws by md5 of the seed, the replicate and the
case, inside Spark: it is distributed, repeatable after a lost executor, and
any SQL engine can repeat it. The numpy sampler repeats the public
``default_rng`` streams on the driver, for small populations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions.columns import spread
from weftlog.functions.lists import flat, listed
from weftlog.operators.prepare import hash_key

TESTS = ("permutation", "replacement", "split", "resample", "classic", "between", "smaller", "own", "halves", "split_variants")


ONE_ROW = 100_000  # cases of a pair up to which a replicate is drawn from one row
PACKED = "pair_id long, rep int, v1 array<int>, c1 array<long>, v2 array<int>, c2 array<long>"


def cells(draws: DataFrame) -> DataFrame:
    """Replicates as one row per variant and side."""
    if "v1" not in draws.columns:
        return draws

    def side(k: int) -> Column:
        return F.transform(F.arrays_zip(F.col(f"v{k}").alias("v"), F.col(f"c{k}").alias("c")), lambda e: F.struct(F.lit(k).alias("side"), e["v"].alias("variant_id"), e["c"].alias("cnt")))

    return draws.select("pair_id", "rep", F.inline(F.concat(side(1), side(2))))


def packed(draws: DataFrame) -> DataFrame:
    """Replicates as one row each, with arrays of variants and counts."""
    if "v1" in draws.columns:
        return draws

    def of(side: int, what: str) -> Column:
        return F.transform(F.filter("cells", lambda e: e["side"] == side), lambda e: e[what])

    one = draws.groupBy("pair_id", "rep").agg(F.collect_list(F.struct("side", "variant_id", "cnt")).alias("cells"))
    return one.select("pair_id", "rep", of(1, "variant_id").alias("v1"), of(1, "cnt").alias("c1"), of(2, "variant_id").alias("v2"), of(2, "cnt").alias("c2"))


def _digests(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of a column of lists as pairs of 64-bit numbers, and the row each is of."""
    data = column.flatten().cast(pa.binary(16))
    raw = np.frombuffer(data.buffers()[1], dtype=">u8", count=2 * len(data), offset=16 * data.offset) if len(data) else np.empty(0, ">u8")
    rows = np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False))
    return raw.reshape(-1, 2).astype(np.uint64), rows


def _side(rows: np.ndarray, variants: np.ndarray, n: int, weights: np.ndarray | None = None) -> list[pa.Array]:
    """How often each row has each variant, as lists of variants and of counts."""
    span = int(variants.max(initial=0)) + 1
    if weights is None:
        keys, counts = np.unique(rows * span + variants, return_counts=True)
    else:
        keys, counts = rows * span + variants, weights
    sizes = np.bincount(keys // span, minlength=n)
    return [listed((keys % span).astype(np.int32), sizes), listed(counts.astype(np.int64), sizes)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the cases of each row in the order of their digests and cut after the row's size."""
    for batch in batches:
        n = batch.num_rows
        digests, rows = _digests(batch.column(2))
        variants, _ = flat(batch.column(3))
        order = np.lexsort((digests[:, 1], digests[:, 0], rows))
        begin = np.searchsorted(rows, np.arange(n))
        first = np.arange(len(rows)) - begin[rows] < batch.column(4).to_numpy(zero_copy_only=False)[rows]
        sides = [_side(rows[part], variants[order][part], n) for part in (first, ~first)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sides[0], *sides[1]], names=[f.split()[0] for f in PACKED.split(", ")])


def _shuffled(pop: DataFrame, vs: DataFrame, n: int, seed: int, first_size: Column, only_first: bool, large: bool = False) -> DataFrame:
    """Cases in a random order per replicate, cut after ``first_size``.

    The cases of a small pair are one row, and every replicate is ordered
    where its copy of that row lies; those of a ``large`` pair stay rows.
    """
    cases = pop.join(vs.select("pair_id", "trace", "variant_id", "n1", "n2"), ["pair_id", "trace"]).select("pair_id", "side", "case_id", "variant_id", "n1", "n2")
    if only_first:
        cases = cases.where("side = 1")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if not large:
        pairs = cases.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("side", "case_id", "variant_id"))).alias("cases"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
        reps = spread(pairs.select("pair_id", every.alias("rep"), "cases", first_size.cast("long").alias("size")), "pair_id", "rep")
        digests = F.transform("cases", lambda c: F.unhex(hash_key(seed, F.col("rep"), F.col("pair_id"), c["side"], c["case_id"])))
        return reps.select("pair_id", "rep", digests.alias("digests"), F.col("cases.variant_id").alias("variants"), "size").mapInArrow(_cut, PACKED)
    reps = cases.withColumn("rep", every)
    ordered = Window.partitionBy("pair_id", "rep").orderBy(hash_key(seed, F.col("rep"), F.col("pair_id"), F.col("side"), F.col("case_id")), "side", "case_id")
    cut = reps.withColumn("side", F.when(F.row_number().over(ordered) <= first_size, 1).otherwise(2))
    return cut.groupBy("pair_id", "rep", "side", "variant_id").agg(F.count(F.lit(1)).alias("cnt"))


def _drawer(whole: tuple[bool, bool]):
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Find the variants of drawn numbers by binary search among running sums of weights."""
        for batch in batches:
            n, out = batch.num_rows, []
            for side, all_of_it in zip((2, 4), whole):
                weights, of = flat(batch.column(side))
                begin = np.searchsorted(of, np.arange(n))
                if all_of_it:
                    some = np.flatnonzero(weights)
                    out += _side(of[some], (np.arange(len(of)) - begin[of])[some], n, weights[some])
                    continue
                upto = np.cumsum(weights)
                before = np.r_[0, upto][begin]
                digests, rows = _digests(batch.column(side + 1))
                sums = np.bincount(of, weights, minlength=n).astype(np.uint64)
                number = (digests[:, 0] >> np.uint64(12)) % sums[rows]  # the first 13 hexadecimal digits
                out += _side(rows, np.searchsorted(upto, before[rows] + number.astype(np.int64), side="right") - begin[rows], n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], names=[f.split()[0] for f in PACKED.split(", ")])

    return draw


def _drawn(vs: DataFrame, n: int, seed: int, *sides: tuple[str, Column | None]) -> DataFrame:
    """Both sides of every replicate: as many draws with replacement as given, a variant as likely as its count, or the whole language.

    A side is the counts to draw by and the number of draws (None for the
    whole). A row holds at most ``ONE_ROW`` draws of a side; where a pair takes
    more, the shares of its rows are summed.
    """
    arrays = [F.transform(F.array_sort(F.collect_list(F.struct("variant_id", F.expr(w).alias("w")))), lambda e: e["w"]) for w, _ in sides]
    pairs = vs.groupBy("pair_id").agg(*[a.alias(f"w{k}") for k, a in enumerate(arrays, 1)], F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    sizes = [(F.lit(-1) if size is None else size).cast("int").alias(f"s{k}") for k, (_, size) in enumerate(sides, 1)]
    pairs = pairs.select("pair_id", "w1", "w2", *sizes).where("s1 != 0 and s2 != 0")
    several = bool(pairs.where(F.greatest("s1", "s2") > ONE_ROW).take(1))
    last = F.floor((F.greatest("s1", "s2", F.lit(1)) - 1) / ONE_ROW).cast("int") if several else F.lit(0)
    shares = pairs.select("*", F.explode(F.sequence(F.lit(0), last)).alias("share"))
    reps = spread(shares.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep")), "pair_id", "rep", "share")

    def digests(k: int) -> Column:
        first, end = F.col("share") * ONE_ROW, F.least(F.col(f"s{k}"), (F.col("share") + 1) * ONE_ROW)
        numbers = F.transform(F.sequence(first, end - 1), lambda i: F.unhex(hash_key(seed, F.col("rep"), F.col("pair_id"), F.lit(str(k)), i)))
        return F.when(end > first, numbers).otherwise(F.array().cast("array<binary>"))

    def weights(k: int) -> Column:
        # The whole language comes with the first share alone.
        return F.when(F.col("share") == 0, F.col(f"w{k}")).otherwise(F.array().cast("array<bigint>")) if sides[k - 1][1] is None else F.col(f"w{k}")

    whole = tuple(size is None for _, size in sides)
    drawn = reps.select("pair_id", "rep", weights(1).alias("w1"), digests(1).alias("u1"), weights(2).alias("w2"), digests(2).alias("u2")).mapInArrow(_drawer(whole), PACKED)
    if not several:
        return drawn
    return cells(drawn).groupBy("pair_id", "rep", "side", "variant_id").agg(F.sum("cnt").alias("cnt"))


def _whole(vs: DataFrame, n: int, weight: str, side: int) -> DataFrame:
    """A side's full language in every replicate."""
    return vs.where(F.col(weight) > 0).select("pair_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep"), F.lit(side).alias("side"), "variant_id", F.col(weight).alias("cnt"))


def _split_variants(vs: DataFrame, n: int, seed: int, size: Column) -> DataFrame:
    """Variants of side 1 split into halves at random, then uniform draws from each half."""
    own = vs.where("c1 > 0").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    ordered = Window.partitionBy("pair_id", "rep").orderBy(hash_key(seed, F.col("rep"), F.col("pair_id"), F.lit("half"), F.col("variant_id")))
    counted = own.withColumns({"place": F.row_number().over(ordered), "v": F.count(F.lit(1)).over(Window.partitionBy("pair_id", "rep"))})
    halves = counted.withColumn("side", F.when(F.col("place") <= F.floor(F.col("v") / 2), 1).otherwise(2))
    lists = halves.groupBy("pair_id", "rep", "side").agg(F.array_sort(F.collect_list("variant_id")).alias("half"), F.first("v").alias("v"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    checked = F.when(F.col("v") < 2, F.raise_error(F.lit("a log with one variant cannot be split")).cast("int")).otherwise(size.cast("int"))
    draws = lists.select("pair_id", "rep", "side", "half", F.explode(F.sequence(F.lit(1), checked)).alias("k"))
    number = F.conv(F.substring(hash_key(seed, F.col("rep"), F.col("pair_id"), F.col("side"), F.col("k")), 1, 13), 16, 10).cast("long") % F.size("half")
    return draws.withColumn("variant_id", F.get("half", number.cast("int"))).groupBy("pair_id", "rep", "side", "variant_id").agg(F.count(F.lit(1)).alias("cnt"))


def resolve_size(resample_size: int | float | None, default: Column) -> Column:
    """Sample size: None or 0 is the default, a float a share of the first log's cases, an int itself."""
    if not resample_size:
        return default
    if isinstance(resample_size, float):
        return F.floor(F.col("n1") * F.lit(resample_size))
    return F.lit(resample_size)


def replicates(pop: DataFrame, vs: DataFrame, test: str, n: int, seed: int = 0, resample_size: int | float | None = None) -> DataFrame:
    """Replicates of a test, as :func:`cells` or :func:`packed` gives them.

    * ``permutation``: all cases in random order; the first n1 against the rest.
    * ``replacement``: draws from log 1 against log 1's full language.
    * ``split``: log 1 in random order; its first half against the rest.
    * ``resample``: two draws from log 1 (half its size each, unless given).
    * ``classic``: draws from both logs pooled; n1 against n2 of them.
    * ``between``: draws from log 1 against draws from log 2, half their sizes.
    * ``smaller``: draws from log 1, as many as log 2 has, against log 2's language.
    * ``own``: two draws from log 1, as many as log 2 has.
    * ``halves``: draws from log 1, as many as ``split_variants`` takes, against log 2's language.
    * ``split_variants``: uniform draws from two random halves of log 1's variants.
    """
    half, other_half = F.floor(F.col("n1") / 2), F.floor(F.col("n2") / 2)
    if test in ("permutation", "split"):
        size, only_first = (F.col("n1"), False) if test == "permutation" else (half, True)
        # The sizes of pairs decide where their cases are ordered, not how.
        large = vs.where(F.col("n1") + F.col("n2") > ONE_ROW).select("pair_id").distinct()
        if not large.take(1):
            return _shuffled(pop, vs, n, seed, size, only_first)
        apart = [_shuffled(pop.join(large, "pair_id", how), vs, n, seed, size, only_first, how == "left_semi") for how in ("left_anti", "left_semi")]
        return cells(apart[0]).unionByName(apart[1])
    if test == "replacement":
        return _drawn(vs, n, seed, ("c1", resolve_size(resample_size, F.col("n1"))), ("c1", None))
    if test == "resample":
        size = resolve_size(resample_size, half)
        return _drawn(vs, n, seed, ("c1", size), ("c1", size))
    if test == "classic":
        return _drawn(vs, n, seed, ("c1 + c2", F.col("n1")), ("c1 + c2", F.col("n2")))
    if test == "between":
        return _drawn(vs, n, seed, ("c1", half), ("c2", other_half))
    if test == "smaller":
        return _drawn(vs, n, seed, ("c1", resolve_size(resample_size, F.col("n2"))), ("c2", None))
    if test == "own":
        return _drawn(vs, n, seed, ("c1", F.col("n2")), ("c1", F.col("n2")))
    if test == "halves":
        return _drawn(vs, n, seed, ("c1", resolve_size(resample_size, F.least(half, F.col("n2")))), ("c2", None))
    if test == "split_variants":
        return _split_variants(vs, n, seed, resolve_size(resample_size, F.least(half, F.col("n2"))))
    raise ValueError(f"unknown test: {test}; one of {', '.join(TESTS)}")


def observed(vs: DataFrame) -> DataFrame:
    """The two logs themselves, as replicate 0."""
    return _whole(vs, 1, "c1", 1).unionByName(_whole(vs, 1, "c2", 2))


def numpy_permutations(n: int, size: int, seed: int | None) -> np.ndarray:
    """``n`` permutations of ``size`` cases from one ``default_rng`` stream."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(size) for _ in range(n)]) if n else np.empty((0, size), dtype=np.int64)


def numpy_draws(n: int, size: int, frequencies: np.ndarray, seed: int | None) -> np.ndarray:
    """``n`` draws of ``size`` variants by frequency from one ``default_rng`` stream."""
    return np.random.default_rng(seed).choice(len(frequencies), (n, size), p=frequencies)


def numpy_replicates(spark, first: np.ndarray, second: np.ndarray, pair_id: int = 0) -> DataFrame:
    """Replicates from arrays of variant numbers, one row per replicate and side."""
    rows = []
    for rep, sides in enumerate(zip(first, second)):
        for side, sample in enumerate(sides, 1):
            rows += [(pair_id, rep, side, int(v), int(c)) for v, c in zip(*np.unique(sample, return_counts=True))]
    return spark.createDataFrame(rows, "pair_id long, rep int, side int, variant_id int, cnt long")


MOST_NUMBERS = 5_000_000  # that the numpy sampler may draw on the driver


def numpy_test(pop: DataFrame, vs: DataFrame, test: str, n: int, seed: int | None, resample_size: int | float | None = None) -> DataFrame:
    """Replicates of one pair's test from the public ``default_rng`` streams, cases and variants in the order of ``variants``.

    For ``permutation``, ``replacement``, ``resample`` and ``classic``. The
    draws are made on the driver, at most ``MOST_NUMBERS`` in all; beyond that
    the hash sampler is the one to take.
    """
    counts = vs.select("pair_id", "variant_id", "c1", "c2").orderBy("variant_id").limit(MOST_NUMBERS + 1).toPandas()
    if counts["pair_id"].nunique() > 1:
        raise ValueError("the numpy sampler takes one pair of logs")
    c1, c2 = (counts[c].to_numpy(dtype=np.int64) for c in ("c1", "c2"))
    n1, n2 = int(c1.sum()), int(c2.sum())
    size = int(np.floor(n1 * resample_size)) if isinstance(resample_size, float) else resample_size
    if n * (n1 + n2 + (size or 0)) > MOST_NUMBERS:
        raise ValueError(f"more than {MOST_NUMBERS} numbers to draw; take the hash sampler")
    spark = pop.sparkSession
    if test == "permutation":
        # In the order of sides and variants, as cases of one variant are alike.
        pooled = np.repeat(np.r_[np.arange(len(c1)), np.arange(len(c2))], np.r_[c1, c2])
        samples = pooled[numpy_permutations(n, n1 + n2, seed)]
        return numpy_replicates(spark, samples[:, :n1], samples[:, n1:], int(counts["pair_id"].iloc[0]))
    pair = int(counts["pair_id"].iloc[0])
    if test == "replacement":
        drawn = numpy_draws(n, size or n1, c1 / n1, seed)
        return numpy_replicates(spark, drawn, np.broadcast_to(np.repeat(np.arange(len(c1)), c1), (n, n1)), pair)
    if test == "resample":
        both = np.random.default_rng(seed).choice(len(c1), (n, 2, size or n1 // 2), p=c1 / n1)
        return numpy_replicates(spark, both[:, 0], both[:, 1], pair)
    if test == "classic":
        drawn = numpy_draws(n, n1 + n2, (c1 + c2) / (n1 + n2), seed)
        return numpy_replicates(spark, drawn[:, :n1], drawn[:, n1:], pair)
    raise ValueError(f"the numpy sampler has no test {test}")
