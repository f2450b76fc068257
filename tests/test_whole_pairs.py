"""Small pairs in one row each: same results as replicates that travel, without any that do."""

import hashlib

import numpy as np
import pytest

from weftlog.operators import compare, resample, transport, whole_pairs
from weftlog.operators.digests import digests

WORDS = {1: "aab abc b abcd ab".split(), 2: "ab abd c aab".split()}


def pairs(spark, binned):
    rows = [(p, s, f"{s}-{k}", list(w)) for p in range(3) for s, words in WORDS.items() for k, w in enumerate(words[: 5 - p])]
    if binned:
        return spark.createDataFrame([(p, s, c, [(a, (p + i) % 3) for i, a in enumerate(w)]) for p, s, c, w in rows], "pair_id long, side int, case_id string, trace array<struct<activity string, bin int>>")
    return spark.createDataFrame(rows, "pair_id long, side int, case_id string, trace array<string>")


def result(pop, test, cost, n=9):
    if test.startswith("double_"):
        found = compare.run_double_test(pop, test.removeprefix("double_"), cost, n, 5)
    elif test.startswith("ks_"):
        found = compare.run_ks_test(pop, test.removeprefix("ks_"), cost, n, 5)
    else:
        null, found = compare.run_test(pop, test, cost, n, 5)
        assert null.count() == 3 * n
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found.collect())


# One line for each finding of the round.
FOUND = {
    "F4": ("double_split_variants", "levenshtein"),
    "F9": ("permutation", "weighted:3"),
    "F6": ("classic", "weighted"),
    "F1": ("ks_replacement", "weighted"),
}


@pytest.mark.parametrize(("test", "cost"), FOUND.values(), ids=FOUND)
@pytest.mark.parametrize("stretches", [1, 3])
def test_replicates_of_small_pairs_do_not_travel(spark, monkeypatch, test, cost, stretches):
    pop = pairs(spark, cost.startswith("weighted")).persist()
    with monkeypatch.context() as m:
        m.setattr(whole_pairs, "MOST_CASES", 0)
        expected = result(pop, test, cost)
    with monkeypatch.context() as m:
        m.setattr(whole_pairs, "MOST_CASES", 8)  # the first pair goes the other way
        assert result(pop, test, cost) == expected and len(expected) == 3

    def travels(*_, **__):
        raise AssertionError("replicates became rows")

    monkeypatch.setattr(resample, "replicates", travels)
    monkeypatch.setattr(whole_pairs, "parts", lambda *_: stretches)
    assert result(pop, test, cost) == expected


def test_digests_are_md5():
    numbers, tails = np.array([0, 9, 10, 100, 99_999]), [f":{p}:{c}" for p in (3, 44_444) for c in ("a", "order-12345", "ä", "x" * 44, "y" * 70)]
    high, low = digests("42:", numbers, tails)
    for i, n in enumerate(numbers):
        for j, t in enumerate(tails):
            assert hashlib.md5(f"42:{n}{t}".encode()).digest() == int(high[i, j]).to_bytes(8) + int(low[i, j]).to_bytes(8)


def test_groups_of_problems_are_solved_alike():
    rng = np.random.default_rng(3)
    groups = [(rng.integers(0, 3, (7, v)), rng.integers(0, 2, (7, v)), rng.integers(0, 9, (v, v)) / 8) for v in (2, 5, 3, 6)]
    expected = [transport.emd_many([(a, b, c) for a, b in zip(one, two)]) for one, two, c in groups]
    for cells in (1, 60, 10_000):
        assert all(np.array_equal(x, y) for x, y in zip(transport.emd_groups(groups, cells), expected))
