"""Earth mover's distance: exact transport for batches of problems, and closed forms in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions.columns import spread
from weftlog.functions.lists import flat
from weftlog.operators.integer_transport import MOST_COLUMNS, MOST_ROWS, fits, integer_transport
from weftlog.operators.resample import cells as cells_of
from weftlog.operators.resample import packed

EPSILON = 1e-11


def transport(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Least total cost of moving ``supply`` to ``demand``, for many problems in step.

    ``cost`` is (R, n, m) or (n, m), ``supply`` (R, n) and ``demand`` (R, m)
    integer masses of equal sums. What fits is first sent along pairs that are
    tight under row and column minima. Then each open problem grows a shortest
    path tree from a row with supply left, by one row or column in each step,
    under costs reduced by row and column prices, until it meets a column with
    demand left; mass is sent along that path and prices change so that every
    pair in use stays tight. So the end is optimal. Masses are whole numbers,
    so problems end exactly; common mass is not cancelled first, as costs need
    not be a metric.
    """
    r, n = supply.shape
    m = demand.shape[1]
    cost = np.broadcast_to(cost, (r, n, m))
    total = np.zeros(r)
    live = np.flatnonzero(supply.sum(axis=1) > 0)
    if len(live):
        trees = _Trees(np.ascontiguousarray(cost[live], dtype=float), supply[live].astype(np.int64), demand[live].astype(np.int64))
        total[live] = trees.solve()
    return total


class _Trees:
    """Open problems and the shortest path trees that they grow."""

    def __init__(self, c: np.ndarray, ex: np.ndarray, de: np.ndarray):
        self.c, self.ex, self.de = c, ex, de
        self.flow = np.zeros(c.shape, dtype=np.int64)
        self.closed = de == 0
        used = np.where((ex > 0)[:, :, None] & (de > 0)[:, None, :], c, np.inf)
        self.u = _finite(used.min(axis=2))
        used -= self.u[:, :, None]
        self.v = _finite(used.min(axis=1))
        self._send_tight(used - self.v[:, None, :] <= EPSILON)
        k, n, m = c.shape
        self.drow, self.dcol = np.full((k, n), np.inf), np.full((k, m), np.inf)
        self.expanded, self.scanned = np.zeros((k, n), dtype=bool), np.zeros((k, m), dtype=bool)
        self.pr, self.pc, self.source = np.zeros((k, m), dtype=np.int64), np.zeros((k, n), dtype=np.int64), np.zeros(k, dtype=np.int64)
        self.left = self.ex.sum(axis=1)

    def _send_tight(self, tight: np.ndarray) -> None:
        at = np.arange(len(tight))
        for _ in range(2):
            for i in range(tight.shape[1]):
                open_ = tight[:, i, :] & (self.de > 0)
                j = open_.argmax(axis=1)
                amount = np.where(open_[at, j], np.minimum(self.ex[:, i], self.de[at, j]), 0)
                self.ex[:, i] -= amount
                self.de[at, j] -= amount
                self.flow[at, i, j] += amount

    def solve(self) -> np.ndarray:
        total, place = np.zeros(len(self.left)), np.arange(len(self.left))
        self._plant(place)
        while True:
            done = self.left == 0
            if done.all() or 4 * done.sum() > len(done):
                total[place[done]] = (self.flow[done] * self.c[done]).sum(axis=(1, 2))
                if done.all():
                    return total
                place = place[~done]
                for name, value in vars(self).items():
                    setattr(self, name, value[~done])
            for _ in range(8):
                self._grow()

    def _plant(self, at: np.ndarray) -> None:
        """New trees, each from the row with most supply left; none where no supply is left."""
        self.drow[at], self.dcol[at], self.expanded[at], self.scanned[at] = np.inf, np.inf, False, False
        at = at[self.left[at] > 0]
        self.source[at] = self.ex[at].argmax(axis=1)
        self.drow[at, self.source[at]] = 0.0

    def _grow(self) -> None:
        """Expand the nearest row of each tree, or scan the nearest column where that is nearer."""
        every = np.arange(len(self.left))
        rows, columns = np.where(self.expanded, np.inf, self.drow), np.where(self.scanned, np.inf, self.dcol)
        # Of columns equally near, those with demand left come first, and before rows; costs have many ties.
        i, j = rows.argmin(axis=1), (columns - EPSILON * (self.de > 0)).argmin(axis=1)
        near, far = rows[every, i], columns[every, j]
        row_first = near < far + EPSILON * (self.de[every, j] == 0)
        g = np.flatnonzero(row_first & np.isfinite(near))
        if len(g):
            of = i[g]
            reduced = np.maximum(self.c[g, of] - self.u[g, of][:, None] - self.v[g], 0.0)
            new = np.where(self.closed[g] | self.scanned[g], np.inf, near[g][:, None] + reduced)
            better = new < self.dcol[g]
            self.dcol[g] = np.where(better, new, self.dcol[g])
            self.pr[g] = np.where(better, of[:, None], self.pr[g])
            self.expanded[g, of] = True
        h = np.flatnonzero(~row_first)
        if len(h):
            met = self.de[h, j[h]] > 0
            scan = h[~met]
            if len(scan):
                of = j[scan]
                self.scanned[scan, of] = True
                new = (self.flow[scan, :, of] > 0) & ~self.expanded[scan] & (far[scan][:, None] < self.drow[scan])
                self.drow[scan] = np.where(new, far[scan][:, None], self.drow[scan])
                self.pc[scan] = np.where(new, of[:, None], self.pc[scan])
            if met.any():
                self._send(h[met], j[h[met]], far[h[met]])

    def _send(self, at: np.ndarray, target: np.ndarray, distance: np.ndarray) -> None:
        """Send mass along the paths to the columns that were met; trees that are spent set prices and are planted anew."""
        source = self.source[at]
        amount = np.minimum(self.ex[at, source], self.de[at, target])
        there, back, open_, j = [], [], np.arange(len(at)), target.copy()
        while len(open_):
            i = self.pr[at[open_], j[open_]]
            there.append((open_, i, j[open_]))
            inner = i != source[open_]
            open_, i = open_[inner], i[inner]
            j[open_] = self.pc[at[open_], i]
            amount[open_] = np.minimum(amount[open_], self.flow[at[open_], i, j[open_]])
            back.append((open_, i, j[open_]))
        for of, i, column in there:
            self.flow[at[of], i, column] += amount[of]
        self.ex[at, source] -= amount
        self.de[at, target] -= amount
        self.left[at] -= amount
        spent = self.ex[at, source] == 0
        for of, i, column in back:
            self.flow[at[of], i, column] -= amount[of]
            spent[of] |= self.flow[at[of], i, column] == 0
        # A tree whose source has more to send and whose branches all hold grows on.
        at, distance = at[spent], distance[spent]
        self.u[at] += np.where(self.expanded[at], distance[:, None] - _finite(self.drow[at]), 0.0)
        self.v[at] -= np.where(self.scanned[at], distance[:, None] - _finite(self.dcol[at]), 0.0)
        self._plant(at)


def _finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, 0.0)


def emd(first: np.ndarray, second: np.ndarray, cost: np.ndarray) -> float:
    """Distance of two histograms of counts (or of frequencies, taken to 12 digits)."""
    a, b = (np.asarray(x) for x in (first, second))
    if not np.issubdtype(a.dtype, np.integer) or not np.issubdtype(b.dtype, np.integer):
        a, b = (np.rint(np.asarray(x, dtype=float) / np.sum(x) * 1e12).astype(np.int64) for x in (a, b))
        a[a.argmax()] += b.sum() - a.sum()
        scale = float(a.sum())
    else:
        n1, n2 = int(a.sum()), int(b.sum())
        a, b, scale = a * n2, b * n1, float(n1 * n2)
    return float(transport(np.asarray(cost, dtype=float), a[None, :], b[None, :])[0] / scale)


def emd_many(problems: list[tuple[np.ndarray, np.ndarray, np.ndarray]], most_cells: int = 1_000_000) -> np.ndarray:
    """Distances of many (counts, counts, cost matrix) problems; those of like size are solved together.

    Rows and columns without mass are dropped first.
    """
    small = []
    for a, b, c in problems:
        i, j = np.flatnonzero(a), np.flatnonzero(b)
        small.append((a[i] * int(b.sum()), b[j] * int(a.sum()), c[np.ix_(i, j)], float(a.sum()) * float(b.sum())))
    out = np.zeros(len(small))
    order = sorted(range(len(small)), key=lambda k: small[k][2].shape)
    lo = 0
    while lo < len(order):
        hi, n, m = lo, 0, 0
        while hi < len(order):
            rows, cols = small[order[hi]][2].shape
            if hi > lo and (max(n, rows) * max(m, cols) * (hi - lo + 1) > most_cells or hi - lo >= 4096):
                break
            n, m, hi = max(n, rows), max(m, cols), hi + 1
        part = order[lo:hi]
        cost, supply, demand = np.zeros((len(part), n, m)), np.zeros((len(part), n), np.int64), np.zeros((len(part), m), np.int64)
        for k, p in enumerate(part):
            a, b, c, _ = small[p]
            supply[k, : len(a)], demand[k, : len(b)], cost[k, : len(a), : len(b)] = a, b, c
        scale = np.array([small[p][3] or 1.0 for p in part])
        out[part] = np.round(transport(cost, supply, demand) / scale, 12)
        lo = hi
    return out


def emd_groups(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], most_cells: int = 1_000_000, units: list[int] | None = None) -> list[np.ndarray]:
    """Distances of groups of problems that share a cost matrix each: counts (R, V), counts (R, V) and costs (V, V).

    The same as :func:`emd_many`; groups of like size are solved together, and
    no problem is handled by itself. ``units``: what each group's costs are
    whole multiples of one part of, 0 if not known; where problems are small
    enough those are solved in whole numbers.
    """
    units = units or [0] * len(groups)
    out = [np.zeros(len(one)) for one, _, _ in groups]
    parts = []
    for g, (one, two, cost) in enumerate(groups):
        sides = []
        for side in (one, two):
            width = max(1, int((side > 0).sum(axis=1).max(initial=0)))
            kept = np.argsort(side == 0, axis=1, kind="stable")[:, :width]
            sides.append((kept, np.take_along_axis(side, kept, axis=1)))
        n, m = (kept.shape[1] for kept, _ in sides)
        step, whole = max(1, most_cells // (n * m)), units[g] > 0 and max(n - MOST_ROWS, m - MOST_COLUMNS) <= 0 and fits(MOST_ROWS, MOST_COLUMNS, round(float(cost.max(initial=0)) * units[g])) is not None
        parts += [(whole, n, m, g, sides, slice(lo, lo + step)) for lo in range(0, len(one), step)]
    parts.sort(key=lambda x: x[:4])
    lo = 0
    while lo < len(parts):
        hi, n, m, many = lo, 0, 0, 0
        while hi < len(parts):
            wide, high, more = max(n, parts[hi][1]), max(m, parts[hi][2]), many + len(out[parts[hi][3]][parts[hi][5]])
            if hi > lo and (wide * high * more > most_cells or parts[hi][0] != parts[lo][0]):
                break
            n, m, many, hi = wide, high, more, hi + 1
        whole = parts[lo][0]
        cost, supply, demand, scale, at = np.zeros((many, n, m), np.int64 if whole else float), np.zeros((many, n), np.int64), np.zeros((many, m), np.int64), np.ones(many), 0
        for _, rows, columns, g, ((i, a), (j, b)), own in parts[lo:hi]:
            a, b, i, j = a[own], b[own], i[own], j[own]
            sums, to = (a.sum(axis=1), b.sum(axis=1)), slice(at, at + len(a))
            costs = np.rint(groups[g][2] * units[g]).astype(np.int64) if whole else groups[g][2]
            cost[to, :rows, :columns] = costs[i[:, :, None], j[:, None, :]]
            supply[to, :rows], demand[to, :columns] = a * sums[1][:, None], b * sums[0][:, None]
            scale[to] = np.maximum(sums[0].astype(float) * sums[1].astype(float), 1.0) * (units[g] if whole else 1)
            at += len(a)
        found, at = np.round((integer_transport if whole else transport)(cost, supply, demand) / scale, 12), 0
        for *_, g, _, own in parts[lo:hi]:
            size = len(out[g][own])
            out[g][own] = found[at : at + size]
            at += size
        lo = hi
    return out


def _solver(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        problems, keys = [], []
        for pair, size, flat, replicates in batch[["pair_id", "size", "matrix", "replicates"]].itertuples(index=False):
            cost = np.asarray(flat, dtype=float).reshape(size, size)
            for one in replicates:
                a, b = np.zeros(size, np.int64), np.zeros(size, np.int64)
                a[np.asarray(one["v1"], dtype=np.int64)] = one["c1"]
                b[np.asarray(one["v2"], dtype=np.int64)] = one["c2"]
                problems.append((a, b, cost))
                keys.append((pair, one["rep"]))
        yield pd.DataFrame({"pair_id": [p for p, _ in keys], "rep": [r for _, r in keys], "emd": emd_many(problems)})


def _whole(matrix: DataFrame, mirrored: bool) -> DataFrame:
    if not mirrored:
        return matrix.select("pair_id", "i", "j", "cost")
    return matrix.select("pair_id", F.inline(F.when(F.col("i") < F.col("j"), F.array(F.struct("i", "j", "cost"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "cost"))).otherwise(F.array(F.struct("i", "j", "cost")))))


def solve_exact(draws: DataFrame, matrix: DataFrame, block: int = 64, mirrored: bool = True) -> DataFrame:
    """Distances of all replicates under a cost matrix: ``pair_id, rep, emd``.

    ``draws`` are :func:`~weftlog.operators.resample.replicates`; ``matrix`` has
    ``pair_id, i, j, cost``, for i <= j if ``mirrored``, else for all. Replicates
    travel in blocks, each with one dense matrix, so many replicates of one
    pair are spread over tasks. For comparisons of up to some thousand variants;
    more go through :func:`solve_rows`.
    """
    dense = _whole(matrix, mirrored).groupBy("pair_id").agg((F.max("i") + 1).alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "cost"))), lambda e: e["cost"]).alias("matrix"))

    one = packed(draws).select("pair_id", F.floor(F.col("rep") / block).alias("b"), F.struct("rep", "v1", "c1", "v2", "c2").alias("one"))
    blocks = one.groupBy("pair_id", "b").agg(F.collect_list("one").alias("replicates"))
    whole = spread(blocks.join(dense, "pair_id"), "pair_id", "b")
    return whole.select("pair_id", "size", "matrix", "replicates").mapInPandas(_solver, "pair_id long, rep long, emd double")


def _row_solver(key: tuple, cells: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The replicates of one block; rows and columns of the matrix without mass are left out."""
    firsts, seconds = (np.unique(cells.loc[cells["side"] == s, "variant_id"]) for s in (1, 2))
    rows = rows.set_index("i").loc[firsts]
    cost = np.stack([np.asarray(c, dtype=float)[seconds] for c in rows["costs"]])
    problems, reps = [], []
    for rep, own in cells.groupby("rep"):
        masses = []
        for side, places in ((1, firsts), (2, seconds)):
            mine, mass = own[own["side"] == side], np.zeros(len(places), np.int64)
            mass[np.searchsorted(places, mine["variant_id"])] = mine["cnt"]
            masses.append(mass)
        problems.append((*masses, cost))
        reps.append(rep)
    return pd.DataFrame({"pair_id": key[0], "rep": reps, "emd": emd_many(problems)})


def solve_rows(draws: DataFrame, matrix: DataFrame, block: int = 8, mirrored: bool = True) -> DataFrame:
    """The same as :func:`solve_exact` for comparisons of any number of variants.

    The matrix travels row by row, is never sorted or held whole in one row,
    and a task keeps only what has mass in its few replicates. What a task
    needs is the dense matrix of those variants, some six times over.
    """
    rows = _whole(matrix, mirrored).groupBy("pair_id", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "cost"))), lambda e: e["cost"]).alias("costs"))
    draws = cells_of(draws)
    cells = draws.select("pair_id", F.floor(F.col("rep") / block).alias("b"), "rep", "side", "variant_id", "cnt")
    needed = cells.where("side = 1").select("pair_id", "b", F.col("variant_id").alias("i")).distinct()
    copies = rows.join(needed, ["pair_id", "i"]).select(F.col("pair_id").alias("of_pair"), F.col("b").alias("of_block"), "i", "costs")
    return cells.groupBy("pair_id", "b").cogroup(copies.groupBy("of_pair", "of_block")).applyInPandas(_row_solver, "pair_id long, rep long, emd double")


def _masses(draws: DataFrame, place: str) -> DataFrame:
    """Counts of both sides at every place, and the sides' totals."""
    cells = draws.groupBy("pair_id", "rep", place).agg(F.sum(F.when(F.col("side") == 1, F.col("cnt")).otherwise(0)).alias("c1"), F.sum(F.when(F.col("side") == 2, F.col("cnt")).otherwise(0)).alias("c2"))
    whole = Window.partitionBy("pair_id", "rep")
    return cells.withColumns({"m1": F.sum("c1").over(whole), "m2": F.sum("c2").over(whole)})


def _discrete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The closed form for replicates that are one row each; 0 where a side is empty."""
    for batch in batches:
        n = batch.num_rows
        (v1, r1), (c1, _), (v2, r2), (c2, _) = (flat(batch.column(k)) for k in (2, 3, 4, 5))
        m1, m2, apart = (np.zeros(n, np.int64) for _ in range(3))
        np.add.at(m1, r1, c1)
        np.add.at(m2, r2, c2)
        span = max(int(v1.max(initial=0)), int(v2.max(initial=0))) + 1
        place, mass = np.concatenate([r1 * span + v1, r2 * span + v2]), np.concatenate([c1 * m2[r1], -c2 * m1[r2]])
        order = np.argsort(place, kind="stable")
        cut = np.flatnonzero(np.diff(place[order], prepend=-1))
        if len(cut):
            np.add.at(apart, place[order][cut] // span, np.abs(np.add.reduceat(mass[order], cut)))
        emd = apart.astype(float) / np.maximum(2 * m1 * m2, 1).astype(float)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(emd)], names=["pair_id", "rep", "emd"])


def solve_discrete(draws: DataFrame) -> DataFrame:
    """Closed form for 0/1 cost: half the sum of the differences of frequencies, from whole numbers."""
    if "v1" in draws.columns:
        return draws.select("pair_id", "rep", "v1", "c1", "v2", "c2").mapInArrow(_discrete, "pair_id long, rep int, emd double")
    cells = _masses(cells_of(draws), "variant_id")
    apart = F.sum(F.abs(F.col("c1") * F.col("m2") - F.col("c2") * F.col("m1")))
    return cells.groupBy("pair_id", "rep").agg((apart.cast("double") / (2 * F.first("m1") * F.first("m2")).cast("double")).alias("emd"))


def solve_line(draws: DataFrame, positions: DataFrame) -> DataFrame:
    """Closed form on a line: the area between the distribution functions, from whole numbers.

    ``positions`` gives ``pair_id, variant_id, position`` (whole numbers).
    """
    cells = _masses(cells_of(draws).join(positions, ["pair_id", "variant_id"]), "position")
    along = Window.partitionBy("pair_id", "rep").orderBy("position")
    summed = cells.withColumn("gap", F.abs(F.sum(F.col("c1") * F.col("m2") - F.col("c2") * F.col("m1")).over(along))).withColumn("step", F.lead("position").over(along) - F.col("position"))
    return summed.groupBy("pair_id", "rep").agg((F.coalesce(F.sum(F.col("gap") * F.col("step")), F.lit(0)).cast("double") / (F.first("m1") * F.first("m2")).cast("double")).alias("emd"))
