"""Replicates that bounds place above or below the logs' distance are not solved, and those that are solved are judged as before."""

import numpy as np
import pyarrow as pa
import pytest

from weftlog.operators import whole_pairs

N = 400
KINDS = "pair_id long, lo int, hi int, sides array<int>, ids array<string>, activities array<array<string>>, bins array<array<int>>"


class Rows:
    """Rows whose tasks run here."""

    def __init__(self, *batches):
        self.batches = batches

    def mapInArrow(self, judge, _):
        return pa.Table.from_batches(judge(iter(self.batches))).to_pylist()


def rows(binned):
    rng, pairs = np.random.default_rng(8), []
    for sizes in ((19, 22), (25, 16), (3, 3), (1, 2)):
        sides = np.repeat([1, 2], sizes).tolist()
        activities = [[f"{chr(97 + min(9, int(rng.exponential(3))))}" for _ in range(rng.integers(1, 9))] for _ in sides]
        pairs.append((len(pairs), 0, N, sides, [f"case-{k}" for k in range(len(sides))], activities, [rng.integers(0, 3, len(t)).tolist() for t in activities] if binned else None))
    types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.list_(pa.list_(pa.int32()))]
    return Rows(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pairs), types)], names=[f.split()[0] for f in KINDS.split(", ")]))


@pytest.mark.parametrize(("test", "cost"), [("permutation", "levenshtein"), ("permutation", "weighted:3"), ("classic", "weighted"), ("replacement", "levenshtein")])
def test_few_replicates_are_solved(monkeypatch, test, cost):
    table = rows(cost != "levenshtein")
    emds = {(r["pair_id"], r["rep"]): r["emd1"] for r in whole_pairs.judged(table, [test], cost, 5, None, "rows")}
    solved, emd_groups = [], whole_pairs.emd_groups

    def counting(groups, **more):
        solved.extend(len(one) for one, _, _ in groups)
        return emd_groups(groups, **more)

    monkeypatch.setattr(whole_pairs, "emd_groups", counting)
    for result in ("above", "reached"):
        solved.clear()
        found = whole_pairs.judged(table, [test], cost, 5, None, result)
        assert 4 <= sum(solved) < 0.2 * 4 * N
        assert [r["n"] for r in found] == [N] * 4
        for r in found:
            past = [emds[r["pair_id"], k] > r["logs_emd"] if result == "above" else emds[r["pair_id"], k] >= r["logs_emd"] for k in range(N)]
            assert r["beyond"] == sum(past)


def test_more_open_replicates_than_are_solved_at_once(monkeypatch):
    table = rows(False)
    expected = whole_pairs.judged(table, ["permutation"], "levenshtein", 5, None, "above")
    monkeypatch.setattr(whole_pairs, "OPEN", 100)
    monkeypatch.setattr(whole_pairs, "TEXTS", 1_000)
    assert whole_pairs.judged(table, ["permutation"], "levenshtein", 5, None, "above") == expected
