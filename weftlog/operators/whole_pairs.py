"""Tests on small pairs of logs, each pair's cases in one row: replicates are drawn, judged and forgotten inside a task.

The replicates and cost matrices of a population weigh many times its cases.
Here neither is written or shuffled: a row holds a pair's cases, from which a
task makes variants, costs, draws and distances, the same as
:mod:`~weftlog.operators.resample`, :mod:`~weftlog.operators.distance` and
:mod:`~weftlog.operators.transport` give them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlog.functions.checkpoints import stored
from weftlog.functions.columns import shuffle_partitions, spread
from weftlog.operators.bounds import beyond
from weftlog.operators.digests import digests
from weftlog.operators.distance import edit_tables
from weftlog.operators.transport import emd_groups

MOST_CASES = 500  # of a pair that is one row
MOST_STEPS = 100_000  # in the traces of such a pair
TOGETHER = 64  # pairs of a task at once; more make few problems wait for the last ones
TEXTS = 250_000  # digests of a task at once
OPEN = 1_000_000  # cells of replicates that bounds leave open, solved at once
TABLE = 100_000  # cells of edit tables' rows of a task at once
SHUFFLED = 3_000_000  # cases that are brought to their pairs at once
MOST_SHARES = 32  # times that a population is read for it
STORED_STEPS = 8_000  # of a pair that is read with 4,095 others from a stored table
ONE_VARIANT = "a log with one variant cannot be split"


def fits(pop: DataFrame, cost: str | Callable) -> bool:
    """Whether traces and cost are such that a task can judge replicates itself."""
    kind = pop.schema["trace"].dataType.elementType
    if cost in ("discrete", "levenshtein"):
        return isinstance(kind, T.StringType)
    binned = isinstance(kind, T.StructType) and [(f.name, f.dataType.typeName()) for f in kind.fields] == [("activity", "string"), ("bin", "integer")]
    return binned and isinstance(cost, str) and cost.startswith("weighted")


def sizes(pop: DataFrame, lone: bool = False) -> DataFrame:
    """Pairs, their cases and steps, and whether these are more than one row should hold: ``pair_id, cases, steps, large``; with ``lone`` only those that have both sides.

    No trace is shuffled for it.
    """
    counted = pop.groupBy("pair_id").agg(F.count(F.lit(1)).alias("cases"), F.sum(F.size("trace")).alias("steps"), F.min("side").alias("least"), F.max("side").alias("most"))
    return (counted.where("least < most") if lone else counted).select("pair_id", "cases", "steps", ((F.col("cases") > MOST_CASES) | (F.col("steps") > MOST_STEPS)).alias("large"))


def parts(session, n: int, pairs: int) -> int:
    """Stretches of replicates that few pairs are cut into, so that all cores have work; many pairs stay whole."""
    return max(1, min(-(-n // 64), -(-4 * shuffle_partitions(session) // max(1, pairs))))


def shares(cases: int, steps: int) -> int:
    """Shares of the pairs that are brought together one after another, for so many cases and so many steps of the longest pair."""
    return max(1, min(MOST_SHARES, -(-cases // SHUFFLED))) if steps <= STORED_STEPS else 1


def blocks(pop: DataFrame, n: int, parts: int, lone: bool = False, shares: int = 1) -> DataFrame:
    """``pair_id, lo, hi`` and the pair's cases in order: ``sides, ids, activities, bins``, one row for each of the stretches of replicates.

    With ``lone``, pairs that lack a side are left out, once their cases are together. Several ``shares`` of the
    pairs are brought together and stored one after another, so shuffle files hold a share of the traces at a
    time; that reads the population again for each.
    """
    if shares > 1:
        share = F.pmod(F.xxhash64("pair_id"), F.lit(shares))
        pairs = stored(*[_together(pop.where(share == i), lone) for i in range(shares)])
    else:
        pairs = _together(pop, lone)
    step = -(-n // parts)
    lo = F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(step))) if parts > 1 else F.lit(0)
    pairs = pairs.select("pair_id", lo.alias("lo"), "cases")
    if parts > 1:
        pairs = spread(pairs, "pair_id", "lo")
    traces = F.col("cases.trace")
    binned = isinstance(pop.schema["trace"].dataType.elementType, T.StructType)
    activities = F.transform(traces, lambda t: t["activity"]) if binned else traces
    bins = F.transform(traces, lambda t: t["bin"]) if binned else F.lit(None).cast("array<array<int>>")
    hi = F.least(F.col("lo") + step, F.lit(n)).cast("int")
    return pairs.select("pair_id", "lo", hi.alias("hi"), F.col("cases.side").alias("sides"), F.col("cases.case_id").alias("ids"), activities.alias("activities"), bins.alias("bins"))


def _together(pop: DataFrame, lone: bool) -> DataFrame:
    """``pair_id, cases``: a row for each pair, its cases in order."""
    cases = F.sort_array(F.collect_list(F.struct("side", F.col("case_id").cast("string").alias("case_id"), "trace")))
    pairs = spread(pop, "pair_id").groupBy("pair_id").agg(cases.alias("cases"))
    return pairs.where(F.col("cases")[0]["side"] < F.element_at("cases", -1)["side"]) if lone else pairs


class Pair:
    """Cases of one pair in order, their variants and the counts of both sides."""

    def __init__(self, pair_id: int, sides: np.ndarray, ids: list, steps: np.ndarray, ends: np.ndarray, turn: bool):
        if turn and (sides == 1).sum() < (sides == 2).sum():
            # The larger log comes first, in the order of its cases.
            order = np.argsort(3 - sides, kind="stable")
        else:
            order, turn = np.arange(len(sides)), False
        self.pair_id, self.sides = pair_id, (3 - sides if turn else sides)[order]
        self.ids = [ids[k] for k in order]
        begins = np.r_[0, ends[:-1]]
        seen: dict[bytes, int] = {}
        self.traces: list[np.ndarray] = []
        self.variant = np.empty(len(sides), np.int64)
        for k, c in enumerate(order):
            trace = steps[begins[c] : ends[c]]
            key = trace.tobytes()
            if key not in seen:
                seen[key] = len(self.traces)
                self.traces.append(trace)
            self.variant[k] = seen[key]
        v = len(self.traces)
        self.c1, self.c2 = (np.bincount(self.variant[self.sides == s], minlength=v) for s in (1, 2))
        self.n1, self.n2 = int(self.c1.sum()), int(self.c2.sum())
        self.cost: np.ndarray | None = None
        self.unit = 0  # costs are whole multiples of one part of so many


def _pairs(batch: pa.RecordBatch, turn: bool) -> list[Pair]:
    sides, ids, activities, bins = (batch.column(k) for k in range(3, 7))
    of_case = activities.flatten()
    names = of_case.flatten()
    codes = pc.fill_null(names.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = bins.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.int64) if bins.null_count == 0 else np.zeros(len(codes), np.int64)
    steps = np.stack([codes, numbers], axis=1)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(of_case), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
    upto = np.cumsum(pc.list_value_length(sides).to_numpy(zero_copy_only=False))
    all_sides, all_ids = sides.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ids.flatten().to_pylist()
    out = []
    for pair_id, lo, hi in zip(batch.column(0).to_pylist(), np.r_[0, upto[:-1]], upto):
        first = ends[lo - 1] if lo else 0
        out.append(Pair(pair_id, all_sides[lo:hi], all_ids[lo:hi], steps[first : ends[hi - 1]], ends[lo:hi] - first, turn))
    return out


def _costs(pairs: list[Pair], cost: str) -> None:
    """Dense cost matrices of the pairs; edit tables of all their variants are filled in step."""
    weighted = cost.startswith("weighted")
    bins = cost.partition(":")[2]
    scale, half = (float(max(int(bins) - 1, 1)), 2.0) if bins else (1.0, 1.0)
    shift, of, rows, columns, traces = 0, [], [], [], []
    for k, p in enumerate(pairs):
        v = len(p.traces)
        p.cost = np.zeros((v, v))
        i, j = np.triu_indices(v)
        of.append(np.full(len(i), k))
        rows.append(i + shift)
        columns.append(j + shift)
        traces += p.traces
        shift += v
    of, rows, columns = np.concatenate(of), np.concatenate(rows), np.concatenate(columns)
    sizes = np.array([len(t) for t in traces])
    starts = np.r_[0, np.cumsum(sizes)]
    steps = np.concatenate(traces)
    shifts = np.r_[0, np.cumsum([len(p.traces) for p in pairs])]
    order = np.lexsort((sizes[rows], sizes[columns]))

    def padded(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = sizes[which]
        width = max(1, int(own.max(initial=0)))
        inside = np.arange(width) < own[:, None]
        at = np.where(inside, starts[which][:, None] + np.arange(width), 0)
        both = steps[at] if len(steps) else np.zeros((*at.shape, 2), np.int64)
        return np.where(inside, both[..., 0], 0), np.where(inside, both[..., 1], 0) if weighted else np.zeros(at.shape, np.int64), own

    lo = 0
    while lo < len(order):
        hi = min(len(order), lo + max(1, TABLE // max(1, int(sizes[columns[order[lo]]]))))
        while hi - lo > 1 and (hi - lo) * max(1, int(max(sizes[columns[order[hi - 1]]], sizes[rows[order[lo:hi]]].max()))) > 2 * TABLE:
            hi = lo + (hi - lo) // 2
        part = order[lo:hi]
        (codes_a, bins_a, size_a), (codes_b, bins_b, size_b) = padded(rows[part]), padded(columns[part])
        found = edit_tables(codes_a, bins_a, size_a, codes_b, bins_b, size_b, scale) / np.maximum(np.maximum(size_a, size_b), 1) / half
        for k in np.unique(of[part]):
            own = of[part] == k
            i, j = rows[part][own] - shifts[k], columns[part][own] - shifts[k]
            pairs[k].cost[i, j] = pairs[k].cost[j, i] = found[own]
        lo = hi
    for p in pairs:
        unit = math.lcm(*{max(1, len(t)) for t in p.traces}) * round(scale * half)
        p.unit = unit if unit < 1 << 40 else 0


def _sizes(test: str, p: Pair, size: int | float | None) -> tuple[int, int]:
    """Draws of both sides; -1 is the side's whole language."""
    half = p.n1 // 2

    def given(default: int) -> int:
        if not size:
            return default
        return int(np.floor(p.n1 * size)) if isinstance(size, float) else size

    if test == "replacement":
        return given(p.n1), -1
    if test == "resample":
        return given(half), given(half)
    if test == "classic":
        return p.n1, p.n2
    if test == "between":
        return half, p.n2 // 2
    if test == "smaller":
        return given(p.n2), -1
    if test == "own":
        return p.n2, p.n2
    if test == "halves":
        return given(min(half, p.n2)), -1
    return given(min(half, p.n2)), given(min(half, p.n2))


def _texts(test: str, p: Pair, size: int | float | None) -> list[str]:
    """What follows a replicate's number in the texts that order and draw."""
    if test in ("permutation", "split"):
        kept = zip(p.sides.tolist(), p.ids) if test == "permutation" else ((1, i) for s, i in zip(p.sides, p.ids) if s == 1)
        return [f":{p.pair_id}:{s}" + (f":{i}" if i is not None else "") for s, i in kept]
    sizes, base = _sizes(test, p, size), 0
    out = []
    if test == "split_variants":
        if (p.c1 > 0).sum() < 2:
            raise ValueError(ONE_VARIANT)
        out, base = [f":{p.pair_id}:half:{v}" for v in np.flatnonzero(p.c1)], 1
    return out + [f":{p.pair_id}:{side}:{k + base}" for side in (1, 2) for k in range(max(0, sizes[side - 1]))]


def _counted(which: np.ndarray, v: int) -> np.ndarray:
    """How often each row has each number below ``v``."""
    n = len(which)
    return np.bincount((np.arange(n)[:, None] * v + which).ravel(), minlength=n * v).reshape(n, v)


def _first(high: np.ndarray, low: np.ndarray, size: int) -> np.ndarray:
    """Which columns of each row are among the ``size`` least digests."""
    if size <= 0 or size >= high.shape[1]:
        return np.full(high.shape, size > 0)
    first = high <= np.partition(high, size - 1, axis=1)[:, size - 1 : size]
    for r in np.flatnonzero(first.sum(axis=1) != size):
        first[r] = False
        first[r, np.lexsort((low[r], high[r]))[:size]] = True
    return first


def _draws(test: str, p: Pair, high: np.ndarray, low: np.ndarray, size: int | float | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every variant on both sides of each replicate."""
    n, v = len(high), len(p.traces)
    if test in ("permutation", "split"):
        variants = p.variant if test == "permutation" else p.variant[p.sides == 1]
        first = _first(high, low, p.n1 if test == "permutation" else p.n1 // 2)
        of_case = np.zeros((len(variants), v))
        of_case[np.arange(len(variants)), variants] = 1
        one = np.rint(first @ of_case).astype(np.int64)
        return one, np.bincount(variants, minlength=v)[None, :] - one
    sizes = _sizes(test, p, size)
    if test == "split_variants":
        own = np.flatnonzero(p.c1)
        half = len(own) // 2
        first = _first(high[:, : len(own)], low[:, : len(own)], half)
        halves = np.argsort(~first, axis=1, kind="stable")  # the first half's variants, then the other's, each in order
        numbers = (high[:, len(own) :] >> np.uint64(12)).astype(np.int64)
        places = (numbers[:, : sizes[0]] % half, half + numbers[:, sizes[0] :] % (len(own) - half))
        return tuple(_counted(own[np.take_along_axis(halves, x, axis=1)], v) for x in places)
    weights = (p.c1 + p.c2, p.c1 + p.c2) if test == "classic" else (p.c1, p.c1) if test in ("replacement", "resample", "own") else (p.c1, p.c2)
    out, begin = [], 0
    for w, s in zip(weights, sizes):
        if s < 0:
            out.append(np.broadcast_to(w, (n, v)))
            continue
        upto = np.cumsum(w)
        number = (high[:, begin : begin + s] >> np.uint64(12)) % np.uint64(upto[-1])  # the first 13 hexadecimal digits
        out.append(_counted(np.searchsorted(upto, number.astype(np.int64), side="right"), v))
        begin += s
    return tuple(out)


def _emds(problems: list[tuple[np.ndarray, np.ndarray, Pair]], cost: str) -> list[np.ndarray]:
    """Distances of the replicates of several pairs: counts of either side, and the pair."""
    if cost != "discrete":
        return emd_groups([(one, two, p.cost) for one, two, p in problems], units=[p.unit for *_, p in problems])
    out = []
    for one, two, _ in problems:
        m1, m2 = one.sum(axis=1), two.sum(axis=1)
        apart = np.abs(one * m2[:, None] - two * m1[:, None]).sum(axis=1)
        out.append(apart.astype(float) / np.maximum(2 * m1 * m2, 1).astype(float))
    return out


def judged(rows: DataFrame, tests: list[str], cost: str, seed: int, size: int | float | None, result: str, turn: bool = False) -> DataFrame:
    """Distances of every replicate of the tests, as ``result`` wants them.

    ``rows``: ``pair_id, rep, emd1`` and, for two tests, ``emd2``, null where a
    pair's log is too small to draw from. ``above`` and
    ``reached``: ``pair_id, logs_emd, beyond, n``, the number of replicates above
    (or at least at) the logs' distance. ``mean``: the same of the first test
    against the mean of the second. ``excess``: ``pair_id, h, n``, the greatest
    excess of the first test's distribution function over the second's. The
    last two take pairs that are not cut.
    """
    schema = {"rows": "pair_id long, rep int, " + ", ".join(f"emd{t} double" for t in range(1, len(tests) + 1)), "excess": "pair_id long, h long, n long"}.get(result, "pair_id long, logs_emd double, beyond long, n long")
    names = [f.split()[0] for f in schema.split(", ")]

    def drawn(test: str, p: Pair) -> bool:
        return test in ("permutation", "split", "split_variants") or 0 not in _sizes(test, p, size)

    def distances(group: list[Pair], stretch: tuple[int, int], logs: bool) -> list[list[np.ndarray]]:
        """Of each pair, the distances of each test; with ``logs`` that of the logs comes after those of the first test."""
        out: list[list[np.ndarray]] = [[] for _ in group]
        for test in tests:
            texts = [_texts(test, p, size) if drawn(test, p) else [] for p in group]
            upto = np.cumsum([len(t) for t in texts])
            flat = [t for own in texts for t in own]
            step, parts = max(1, TEXTS // max(1, len(flat))), [[] for _ in group]
            for lo in range(*stretch, step):
                numbers = np.arange(lo, min(lo + step, stretch[1]))
                high, low = digests(f"{seed}:", numbers, flat)
                able, problems = [k for k, p in enumerate(group) if drawn(test, p)], []
                for k in able:
                    own = slice(upto[k] - len(texts[k]), upto[k])
                    p = group[k]
                    one, two = _draws(test, p, high[:, own], low[:, own], size)
                    if logs and numbers[-1] + 1 == stretch[1]:
                        one, two = np.vstack([one, p.c1]), np.vstack([two, p.c2])
                    problems.append((one, two, p))
                found = dict(zip(able, _emds(problems, cost)))
                for k in range(len(group)):
                    parts[k].append(found.get(k, np.full(len(numbers), np.nan)))
            for k in range(len(group)):
                out[k].append(np.concatenate(parts[k]))
        return out

    def counted(group: list[Pair], stretch: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair the logs' distance and the number of replicates beyond it; only those that bounds leave open are solved."""
        actual = np.array([x[0] for x in _emds([(p.c1[None], p.c2[None], p) for p in group], cost)])
        many, texts, waiting = np.zeros(len(group), np.int64), [_texts(tests[0], p, size) for p in group], []

        def settle() -> None:
            # Each draw is solved once, and the logs beside it, so that equal distances are equal numbers.
            problems, times = [], []
            for k, draws in waiting:
                p, (rows, repeats) = group[k], np.unique(draws, axis=0, return_counts=True)
                one, two = np.split(np.vstack([rows, np.r_[p.c1, p.c2]]), 2, axis=1)
                problems.append((one, two, p))
                times.append(repeats)
            for (k, _), found, repeats in zip(waiting, _emds(problems, cost), times):
                past = found[:-1] > found[-1] if result == "above" else found[:-1] >= found[-1]
                many[k] += repeats[past].sum()
            waiting.clear()

        first = 0
        while first < len(group):
            last, flat = first + 1, len(texts[first])
            while last < len(group) and (flat + len(texts[last])) * (stretch[1] - stretch[0]) <= TEXTS:
                last, flat = last + 1, flat + len(texts[last])
            own = [t for k in range(first, last) for t in texts[k]]
            for lo in range(*stretch, max(1, TEXTS // max(1, flat))):
                numbers = np.arange(lo, min(lo + max(1, TEXTS // max(1, flat)), stretch[1]))
                high, low = digests(f"{seed}:", numbers, own)
                at = 0
                for k in range(first, last):
                    here = slice(at, at + len(texts[k]))
                    at += len(texts[k])
                    one, two = _draws(tests[0], group[k], high[:, here], low[:, here], size)
                    sides = beyond(group[k].cost, one, two, actual[k])
                    many[k] += (sides > 0).sum()
                    if (open_ := sides == 0).any():
                        waiting.append((k, np.hstack([one[open_], two[open_]])))
                if sum(draws.size for _, draws in waiting) > OPEN:
                    settle()
            first = last
        settle()
        return actual, many

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                stretches = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
                pairs = [(p, s) for p, s in zip(_pairs(batch, turn), stretches) if any(drawn(t, p) for t in tests)]
                if not pairs:
                    continue
                if cost != "discrete":
                    _costs([p for p, _ in pairs], cost)
                for stretch in dict.fromkeys(s for _, s in pairs):
                    group = [p for p, s in pairs if s == stretch]
                    logs = result in ("above", "reached")
                    ids, n = np.array([p.pair_id for p in group]), stretch[1] - stretch[0]
                    if logs and cost != "discrete":
                        columns = [ids, *counted(group, stretch), np.full(len(ids), n)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, from_pandas=True) for c in columns], names=names)
                        continue
                    found = distances(group, stretch, logs)
                    if result == "rows":
                        columns = [np.repeat(ids, n), np.tile(np.arange(*stretch, dtype=np.int32), len(ids)), *[np.concatenate([f[t] for f in found]) for t in range(len(tests))]]
                    elif result == "excess":
                        columns = [ids, *zip(*[_excess(*f) for f in found])]
                    else:
                        actual = [f[0][-1] if logs else np.cumsum(f[1])[-1] / n for f in found]
                        beyond = [int((f[0][:n] > x if result == "above" else f[0][:n] >= x).sum()) for f, x in zip(found, actual)]
                        columns = [ids, actual, beyond, np.full(len(ids), n)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, from_pandas=True) for c in columns], names=names)

    return rows.mapInArrow(judge, schema)


def _excess(reference: np.ndarray, logs: np.ndarray) -> tuple[int, int]:
    """The greatest excess of values of ``reference`` over those of ``logs`` up to any value, and their number."""
    reference, logs = (x[~np.isnan(x)] for x in (reference, logs))
    points = np.unique(np.concatenate([reference, logs]))
    ahead = np.searchsorted(np.sort(reference), points, side="right") - np.searchsorted(np.sort(logs), points, side="right")
    return max(0, int(ahead.max(initial=0))), len(reference)
