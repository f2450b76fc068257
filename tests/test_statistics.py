import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftlog.operators import binning, compare, distance, extract, language, resample, transport


def brute(cost, a, b):
    rows = [i for i, x in enumerate(a) for _ in range(x)]
    cols = [j for j, x in enumerate(b) for _ in range(x)]
    return min(sum(cost[i, j] for i, j in zip(rows, p)) for p in itertools.permutations(cols))


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_transport_is_optimal(data):
    n, m, k = (data.draw(st.integers(1, x)) for x in (4, 4, 6))
    a = np.bincount(data.draw(st.lists(st.integers(0, n - 1), min_size=k, max_size=k)), minlength=n)
    b = np.bincount(data.draw(st.lists(st.integers(0, m - 1), min_size=k, max_size=k)), minlength=m)
    cost = np.array(data.draw(st.lists(st.integers(0, 9), min_size=n * m, max_size=n * m)), dtype=float).reshape(n, m) / 10
    assert transport.transport(cost, a[None], b[None])[0] == pytest.approx(brute(cost, a, b))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=2, max_size=9))
def test_closed_forms(pairs):
    a, b = (np.array(x) for x in zip(*pairs))
    if not a.sum() or not b.sum():
        return
    v = len(a)
    p, q = a / a.sum(), b / b.sum()
    assert transport.emd(a, b, 1 - np.eye(v)) == pytest.approx(np.abs(p - q).sum() / 2)
    places = np.arange(v)
    assert transport.emd(a, b, np.abs(places[:, None] - places)) == pytest.approx(np.abs(np.cumsum(p - q)).sum())
    assert transport.emd(a, a, np.abs(places[:, None] - places)) == 0


def test_known_distances():
    # Published histograms, costs and distances.
    assert transport.emd([0.5, 0.5], [0.5, 0.5], 1 - np.eye(2)) == 0
    assert transport.emd([0, 1], [0.5, 0.5], 1 - np.eye(2)) == pytest.approx(0.5)
    places = np.arange(3)
    assert transport.emd([0.3, 0.4, 0.3], [0.2, 0.8, 0.0], np.abs(places[:, None] - places)) == pytest.approx(0.4)
    uneven = np.array([[0, 0.5, 1], [1, 0, 0.5], [99, 999, 0]])
    assert transport.emd(np.array([2, 1, 0]), np.array([1, 1, 1]), uneven) == pytest.approx(1 / 3)
    # A distance that is not a metric: cancelling common mass first would give 1/2.
    assert transport.emd(np.array([1, 1, 0]), np.array([0, 1, 1]), np.array([[0, 1 / 3, 1], [1 / 3, 0, 1 / 3], [1, 1 / 3, 0]])) == pytest.approx(1 / 3)


def traces(spark, words):
    return spark.createDataFrame([(str(i), list(w)) for i, w in enumerate(words)], "case_id string, trace array<string>")


def test_published_example(spark):
    # Published languages and distances.
    left = ["abdf"] * 10 + ["acf"] * 8 + ["abef"] * 2
    for right, expected in ((["abdf"] * 10 + ["acf"] * 7 + ["abdef"] * 3, 0.05), (["abdf"] * 4 + ["acf"] * 14 + ["abef"] * 2, 0.15)):
        vs = language.variants(language.population(traces(spark, left), traces(spark, right)))
        assert compare.distances(resample.observed(vs), vs, "levenshtein").first()["emd"] == pytest.approx(expected)


def test_language(spark):
    got = language.stochastic_language(traces(spark, "aaaabbbcdd")).collect()
    assert {r["trace"][0]: r["frequency"] for r in got} == {"a": 0.4, "b": 0.3, "c": 0.1, "d": 0.2}
    vs = language.variants(language.population(traces(spark, "bab"), traces(spark, "cb"))).orderBy("variant_id").collect()
    assert [(r["trace"], r["c1"], r["c2"]) for r in vs] == [(["b"], 2, 1), (["a"], 1, 0), (["c"], 0, 1)]
    assert language.stochastic_language(traces(spark, "a").limit(0)).count() == 0


def python_weighted(a, b, bins):
    scale = max(bins - 1, 1) if bins else 1
    table = np.zeros((len(a) + 1, len(b) + 1))
    table[1:, 0] = np.cumsum([1 + x[1] / scale for x in a])
    table[0, 1:] = np.cumsum([1 + y[1] / scale for y in b])
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i, j] = min(table[i - 1, j] + 1 + x[1] / scale, table[i, j - 1] + 1 + y[1] / scale, table[i - 1, j - 1] + (x[0] != y[0]) + abs(x[1] - y[1]) / scale)
    return table[-1, -1] / max(len(a), len(b)) / (2 if bins else 1)


def test_weighted_distance_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [[("abc"[rng.integers(3)], int(rng.integers(3))) for _ in range(rng.integers(1, 6))] for _ in range(12)]
    vs = spark.createDataFrame([(0, i, w) for i, w in enumerate(words)], "pair_id long, variant_id int, trace array<struct<activity:string,bin:int>>")
    for bins in (None, 3):
        for matrix in (distance.cost_matrix(vs, distance.postnormalised_weighted(bins)), distance.weighted_matrix(vs, bins)):
            for r in matrix.collect():
                assert r["cost"] == pytest.approx(python_weighted(words[r["i"]], words[r["j"]], bins))


def test_matrix_spreads_blocks(spark, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK", 3)
    vs = spark.createDataFrame([(0, i, [str(i)] * (i + 1)) for i in range(10)], "pair_id long, variant_id int, trace array<string>")
    got = {(r["i"], r["j"]): r["cost"] for r in distance.cost_matrix(vs, distance.line).collect()}
    assert got == {(i, j): float(j - i) for i in range(10) for j in range(i, 10)}


def test_binning(spark):
    values = [float(x) for x in (5, 1, 9, 3, 7, 2, 8)]
    rows = spark.createDataFrame([("a", v, i) for i, v in enumerate(values)] + [("b", 4.0, 9), ("c", None, 10)], "label string, value double, o int")

    def bins(model):
        return {r["o"]: r["b"] for r in rows.join(model, "label", "left").select("o", binning.bin_column(F.col("value")).alias("b")).collect()}

    low, high = np.percentile(values, [25, 75])
    quartiles = bins(binning.fit_iqr(rows))
    assert [quartiles[i] for i in range(7)] == [0 if v < low else 1 if v < high else 2 for v in values]
    assert quartiles[9] == 2 and quartiles[10] == 0
    model = binning.fit_kmeans_seeds(rows, 3, 7, order="o").where("label = 'a'").first()
    centres = np.array(model["edges"])
    assert set(centres) <= set(values) and list(centres) == sorted(centres) and model["num_bins"] == 3
    assert np.array_equal(centres, binning.greedy_centres(np.array(values), 3, 7))
    nearest = bins(binning.fit_kmeans_seeds(rows, 3, 7, order="o"))
    assert [nearest[i] for i in range(7)] == [int(np.abs(centres - v).argmin()) for v in values]
    assert bins(binning.fit_custom(rows, lambda v: [min(v) + 0.5]))[1] == 0


def test_extraction(spark, lifecycle_log):
    got = {r["case_id"]: "".join(r["trace"]) for r in extract.extract_traces(lifecycle_log).collect()}
    assert got == {"case1": "acbd", "case2": "baa"}
    assert extract.extract_traces(lifecycle_log.limit(0)).count() == 0


def test_public_random_streams(spark):
    cost = spark.createDataFrame([(0, 0, 0, 0.0), (0, 0, 1, 1.0), (0, 1, 1, 0.0)], "pair_id long, i int, j int, cost double")
    pooled = np.repeat([0, 1], 10)
    samples = pooled[resample.numpy_permutations(1, 20, 42)]
    draws = resample.numpy_draws(2, 20, np.array([0.5, 0.5]), 42)
    for both, expected in ((samples, [0.0]), (draws, [0.0, 0.2])):
        rows = transport.solve_exact(resample.numpy_replicates(spark, both[:, :10], both[:, 10:]), cost).orderBy("rep").collect()
        assert [r["emd"] for r in rows] == pytest.approx(expected)


def test_samplers_keep_sizes(spark):
    pop = language.population(traces(spark, "aabbc"), traces(spark, "abcd"))
    vs = language.variants(pop)
    sizes = {"permutation": (5, 4), "split": (2, 3), "replacement": (5, 5), "resample": (2, 2), "classic": (5, 4), "between": (2, 2), "smaller": (4, 4), "own": (4, 4), "halves": (2, 4), "split_variants": (2, 2)}
    for test, expected in sizes.items():
        got = resample.cells(resample.replicates(pop, vs, test, 3, 1)).groupBy("rep").agg(F.sum(F.when(F.col("side") == 1, F.col("cnt"))).alias("a"), F.sum(F.when(F.col("side") == 2, F.col("cnt"))).alias("b")).collect()
        assert [(r["a"], r["b"]) for r in got] == [expected] * 3, test
    with pytest.raises(ValueError):
        resample.replicates(pop, vs, "other", 3)
    half = resample.cells(resample.replicates(pop, vs, "resample", 1, 1, 0.8)).where("side = 1").agg(F.sum("cnt")).first()[0]
    assert half == 4


def test_comparator(spark, lifecycle_log):
    empty = lifecycle_log.limit(0)
    with pytest.raises(ValueError, match="empty event log"):
        compare.LogComparator(lifecycle_log, empty, distribution_size=2).compare()
    comparator = compare.LogComparator(lifecycle_log, lifecycle_log, distribution_size=5, seed=3)
    with pytest.raises(ValueError):
        comparator.pvalue
    result = comparator.compare()
    assert result.logs_emd == 0 and 0 <= comparator.pvalue <= 1 and result.null_distribution.count() == 5
    timed = compare.LogComparator(lifecycle_log, lifecycle_log, representation="timed", test="replacement", distribution_size=4, weighted_time_cost=True, binner="iqr").compare()
    assert timed.logs_emd == 0 and timed.pvalue == 1.0
    assert compare.LogComparator(lifecycle_log, lifecycle_log, test="ks_split", distribution_size=4).compare().pvalue <= 1.0
    assert 0 <= compare.LogComparator(lifecycle_log, lifecycle_log, test="double_smaller", distribution_size=4).compare().pvalue <= 1


def test_ks_matches_counting_of_orders(spark):
    reference, logs = [0.1, 0.1, 0.2, 0.4], [0.1, 0.3, 0.5, 0.6]
    frames = [spark.createDataFrame([(0, v) for v in x], "pair_id long, emd double") for x in (reference, logs)]
    got = compare.ks_greater(*frames).first()

    def excess(ref, other):
        return max(max(0, sum(x <= v for x in ref) - sum(x <= v for x in other)) for v in ref + other)

    h = excess(reference, logs)
    orders = list(itertools.combinations(range(8), 4))
    share = sum(excess(list(c), [i for i in range(8) if i not in c]) >= h for c in orders) / len(orders)
    assert got["statistic"] == h / 4 and got["pvalue"] == pytest.approx(share)
    assert math.isclose(compare.ks_greater(frames[0], frames[0]).first()["pvalue"], 1.0)


def test_histogram(spark):
    null = spark.createDataFrame([(0, i, float(i)) for i in range(11)] + [(1, 0, 2.0), (1, 1, 2.0)], "pair_id long, rep int, emd double")
    got = {(r["pair_id"], r["bin"]): r["n"] for r in compare.null_histogram(null, 5).collect()}
    assert got == {(0, 0): 2, (0, 1): 2, (0, 2): 2, (0, 3): 2, (0, 4): 3, (1, 0): 2}


def test_asymmetric_costs(spark):
    """A cost whose two directions differ: taking letters away is free, adding one costs 1."""
    pop = language.population(traces(spark, ["a", "ab", "abc"]), traces(spark, ["ab", "abcd", "abcd"]))
    vs = language.variants(pop)

    def added(a, b):
        return F.greatest(F.size(b["trace"]) - F.size(a["trace"]), F.lit(0)).cast("double")

    assert compare.distances(resample.observed(vs), vs, added).first()["emd"] == pytest.approx(4 / 3)
    turned = language.variants(pop.withColumn("side", 3 - F.col("side")))
    assert compare.distances(resample.observed(turned), turned, added).first()["emd"] == pytest.approx(0)
    full = distance.cost_matrix(vs, added, symmetric=False).collect()
    assert len(full) == 16 and {(r["i"], r["j"]) for r in full} == set(itertools.product(range(4), repeat=2))


def test_more_variants_than_one_row_holds(spark, monkeypatch):
    pop = language.population(traces(spark, ["a", "ab", "abc", "b"]), traces(spark, ["ab", "abd", "c", "c"])).unionByName(language.population(traces(spark, "aab"), traces(spark, "abb"), 1))
    vs = language.variants(pop).persist()

    def nulls():
        return sorted(map(tuple, compare.distances(resample.replicates(pop, vs, "permutation", 20, 5), vs, "levenshtein").collect()))

    expected = nulls()
    for dense in (4, 1):
        monkeypatch.setattr(compare, "DENSE", dense)
        assert nulls() == expected and len(expected) == 40


def test_symbols_of_many_activities(spark):
    picked = [0, 89, 90, 35_327, 35_328, 45_567, 45_568, 300_000, distance.MOST_SYMBOLS - 1]
    rows = spark.createDataFrame([(i,) for i in picked], "i int").select("i", distance._symbol(F.col("i")).alias("c")).collect()
    assert all(len(r["c"]) == 1 for r in rows) and len({r["c"] for r in rows}) == len(picked)
    with pytest.raises(Exception, match="more than"):
        spark.createDataFrame([(distance.MOST_SYMBOLS,)], "i int").select(distance._symbol(F.col("i"))).collect()


def test_ks_has_one_formula(spark):
    n = 12_000
    frames = [spark.range(n).select(F.lit(0).cast("long").alias("pair_id"), (F.col("id") + shift).cast("double").alias("emd")) for shift in (0, 100)]
    got = compare.ks_greater(*frames).first()
    expected = math.exp(sum(math.log(n - j) - math.log(n + j + 1) for j in range(100)))
    assert got["statistic"] == pytest.approx(100 / n) and got["pvalue"] == pytest.approx(expected)


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(8)
    values = {"a": rng.normal(size=500), "b": rng.integers(0, 4, 301).astype(float), "c": np.array([2.5]), "d": np.array([1.0, 4.0])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("e", None)], "label string, value double")
    for low, high in ((25, 75), (10, 90), (0, 100)):
        got = {r["label"]: r["edges"] for r in binning.fit_percentiles(rows, low, high).collect()}
        assert got.keys() == values.keys()
        for k, v in values.items():
            assert got[k] == pytest.approx(np.percentile(v, [low, high]))
    assert binning.fit_percentiles(rows.limit(0)).count() == 0


def test_numpy_sampler(spark, lifecycle_log):
    """Draws of whole tests repeat the public streams."""
    pop = language.population(traces(spark, "aaabbc"), traces(spark, "abcc"))
    vs = language.variants(pop)
    frequencies = np.array([3, 2, 1]) / 6
    drawn = np.random.default_rng(4).choice(3, (3, 6), p=frequencies)
    got = resample.numpy_test(pop, vs, "replacement", 3, 4).where("side = 1").collect()
    assert {(r["rep"], r["variant_id"]): r["cnt"] for r in got} == {(k, v): c for k in range(3) for v, c in zip(*np.unique(drawn[k], return_counts=True))}
    for test, sizes in {"permutation": (6, 4), "replacement": (6, 6), "resample": (3, 3), "classic": (6, 4)}.items():
        totals = resample.numpy_test(pop, vs, test, 2, 4).groupBy("rep", "side").agg(F.sum("cnt").alias("n")).collect()
        assert sorted((r["side"], r["n"]) for r in totals) == sorted([(1, sizes[0]), (2, sizes[1])] * 2)
    for wrong in (lambda: resample.numpy_test(pop, vs, "between", 2, 4), lambda: resample.numpy_test(pop, vs, "permutation", 10_000_000, 4)):
        with pytest.raises(ValueError):
            wrong()
    result = compare.LogComparator(lifecycle_log, lifecycle_log, distribution_size=5, sampler="numpy").compare()
    assert result.logs_emd == 0 and result.null_distribution.count() == 5
    with pytest.raises(ValueError):
        compare.LogComparator(lifecycle_log, lifecycle_log, distribution_size=5, sampler="dice").compare()


def test_default_size_counts_cases_without_a_trace(spark, lifecycle_log):
    third = lifecycle_log.where("event_ord = 1").withColumn("case:concept:name", F.lit("case3"))
    log = lifecycle_log.unionByName(third)
    seen = {}
    for size, expected in ((None, 3), (0.7, 2), (5, 5)):
        comparator = compare.LogComparator(log, lifecycle_log, test="replacement", distribution_size=2, resample_size=size)
        original = resample.replicates

        def replicates(*arguments):
            seen[size] = arguments[-1]
            return original(*arguments)

        resample.replicates, result = replicates, None
        try:
            result = comparator.compare()
        finally:
            resample.replicates = original
        assert seen[size] == expected and 0 <= result.pvalue <= 1


def test_binners_of_the_timed_test(spark, lifecycle_log):
    values = spark.createDataFrame([("a", float(x * x % 17)) for x in range(12)], "label string, value double")
    direct = {("kmeans", 3): binning.fit_kmeans_seeds(values, 3, 0), ("kmeans", 2): binning.fit_kmeans_seeds(values, 2, 0), ("outer_percentile", 30.0): binning.fit_percentiles(values, 30, 70), ("iqr", None): binning.fit_percentiles(values, 25, 75)}
    names = {"kmeans": "k", "outer_percentile": "outer_percent"}
    for (binner, argument), model in direct.items():
        comparator = compare.LogComparator(lifecycle_log, lifecycle_log, representation="timed", binner=binner, binner_args={names[binner]: argument} if argument else None)
        assert comparator._fitted(values).first() == model.first()
    assert compare.LogComparator(lifecycle_log, lifecycle_log, representation="timed", distribution_size=2, binner=binning.fit_percentiles, binner_args={"low": 10.0, "high": 50.0}).compare().logs_emd == 0
    with pytest.raises(ValueError):
        compare.LogComparator(lifecycle_log, lifecycle_log, representation="timed", binner="other").compare()


def test_large_pairs_are_ordered_alike(spark, monkeypatch):
    pop = language.population(traces(spark, "aabbc"), traces(spark, "abcd")).unionByName(language.population(traces(spark, "ab"), traces(spark, "b"), 1))
    vs = language.variants(pop).persist()
    for test in ("permutation", "split", "replacement", "classic", "smaller"):
        found = []
        for most in (100_000, 5, 1):
            monkeypatch.setattr(resample, "ONE_ROW", most)
            found.append(sorted(map(tuple, resample.cells(resample.replicates(pop, vs, test, 4, 9)).select("pair_id", "rep", "side", "variant_id", "cnt").collect())))
        assert found[0] == found[1] == found[2] and found[0]
    monkeypatch.setattr(resample, "ONE_ROW", 100_000)
    for test in ("permutation", "classic", "replacement"):
        draws = resample.replicates(pop, vs, test, 6, 3)
        both = [sorted((r["pair_id"], r["rep"], r["emd"]) for r in transport.solve_discrete(d).collect()) for d in (draws, resample.cells(draws))]
        assert both[0] == both[1] and len(both[0]) == 12
