"""Exact transport for batches of small problems whose costs are whole numbers.

The same successive shortest paths as :mod:`~weftlog.operators.transport`, laid
out so that each step is a few passes over arrays whose last axis is the
problem: a column's distance, whether it lacks demand and its number are one
whole number, whose minimum is the nearest column, and the rows that have mass in
a column are the bits of one number.
"""

from __future__ import annotations

import numpy as np

MOST_ROWS, MOST_COLUMNS = 62, 64  # bits of a set of rows; numbers of columns in a key
_LOW = 128  # a key is 128 x distance + 64 where demand is spent + column
_SPENT = 64


def fits(rows: int, columns: int, most: int) -> type | None:
    """The type in which problems of that size and highest cost can be solved; None if in none."""
    if rows > MOST_ROWS or columns > MOST_COLUMNS:
        return None
    bound = 3 * (rows + columns) * max(1, most) * _LOW
    return np.int32 if bound < 1 << 29 else np.int64 if bound < 1 << 60 else None


def integer_transport(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Least total cost, whole, for costs (R, n, m), masses (R, n) and (R, m) of equal sums; rows and columns without mass take no part."""
    kind = fits(cost.shape[1], cost.shape[2], int(cost.max(initial=0)))
    total = np.zeros(len(cost), np.int64)
    live = np.flatnonzero(supply.sum(axis=1) > 0)
    if len(live):
        total[live] = _Batch(cost[live], supply[live], demand[live], kind).solve()
    return total


class _Batch:
    """Open problems, each with a tree of shortest paths from one row with supply left."""

    def __init__(self, cost: np.ndarray, supply: np.ndarray, demand: np.ndarray, kind: type):
        k, n, m = cost.shape
        self.kind, self.n, self.m = kind, n, m
        self.far = kind(1 << (29 if kind is np.int32 else 60))
        self.out = kind(2 * int(self.far))  # stays beyond reach when prices are taken off
        self.cost = np.multiply(cost, _LOW, dtype=kind).reshape(k * n, m)
        self.supply, self.demand = supply.T.astype(np.int64), demand.T.astype(np.int64)
        self.ex, self.de = self.supply.copy(), self.demand.copy()
        self.closed = self.demand == 0
        self.flow = np.zeros(k * n * m, np.int64)
        self.holds = np.zeros(k * m, np.int64)
        self._start(k)

    def _start(self, k: int) -> None:
        """Prices by row and column minima; what fits is sent along tight pairs."""
        n, m = self.n, self.m
        costs = self.cost.reshape(k, n, m).transpose(1, 2, 0).copy()
        off = np.where(self.closed, self.far, self.kind(0))
        self.u = np.empty((n, k), self.kind)
        for i in range(n):
            costs[i] = np.minimum(costs[i], self.far - 1) + off
            self.u[i] = costs[i].min(axis=0)
            costs[i] -= self.u[i]
        idle = np.where(self.supply == 0, self.far, self.kind(0))
        self.v = np.full((m, k), self.far, self.kind)
        for i in range(n):
            np.minimum(self.v, np.maximum(costs[i], idle[i]), out=self.v)
        self.v[self.closed] = 0
        at, columns = np.arange(k), np.arange(m, dtype=np.int8)[:, None]
        for _ in range(2):
            for i in range(n):
                open_ = (costs[i] == self.v) & (self.de > 0)
                j = np.where(open_, columns, np.int8(127)).min(axis=0)
                g = np.flatnonzero((j < 127) & (self.ex[i] > 0))
                j = j[g].astype(np.int64)
                amount = np.minimum(self.ex[i, g], self.de[j, g])
                self._move(g, np.full(len(g), i), j, amount)
                self.ex[i, g] -= amount
                self.de[j, g] -= amount
        self.left = self.ex.sum(axis=0)
        self.place = at
        self.key, self.weight = np.full((m, k), self.far, self.kind), np.zeros((m, k), self.kind)
        self.reached = np.full((m, k), self.far, self.kind)
        self.drow = np.full((n, k), self.far, self.kind)
        self.pr, self.pc = np.zeros((m, k), np.int8), np.zeros((n, k), np.int8)
        self.source, self.inside, self.pending = (np.zeros(k, np.int64) for _ in range(3))
        self.now, self.column = np.zeros(k, self.kind), np.zeros(k, np.int8)
        self._plant(at)

    def _move(self, at: np.ndarray, i: np.ndarray, j: np.ndarray, amount: np.ndarray) -> None:
        """Add (or take) mass on a pair of each problem in ``at``."""
        cell, column, bit = (at * self.m + j) * self.n + i, at * self.m + j, np.int64(1) << i
        held = self.flow[cell] + amount
        self.flow[cell] = held
        self.holds[column] = np.where(held > 0, self.holds[column] | bit, self.holds[column] & ~bit)

    def _plant(self, at: np.ndarray) -> None:
        at = at[self.left[at] > 0]
        if not len(at):
            return
        self.source[at] = source = (self.ex[:, at] * 64 + np.arange(self.n)[:, None]).max(axis=0) & 63
        self.key[:, at], self.reached[:, at], self.drow[:, at] = self.far, self.far, self.far
        low = np.arange(self.m, dtype=self.kind)[:, None] + np.where(self.de[:, at] == 0, self.kind(_SPENT), self.kind(0)) - self.v[:, at]
        self.weight[:, at] = np.where(self.closed[:, at], self.out, low)
        self.inside[at], self.pending[at], self.now[at] = 0, np.int64(1) << source, 0

    def solve(self) -> np.ndarray:
        total = np.zeros(len(self.left), np.int64)
        while True:
            done = self.left == 0
            if 8 * done.sum() >= len(done):
                if done.any():
                    total[self.place[done]] = self._prices(done)
                    if done.all():
                        return total
                    self._keep(~done)
            for _ in range(8):
                self._expand()
                self._nearest()

    def _prices(self, at: np.ndarray) -> np.ndarray:
        """Pairs in use are tight, so prices of all masses are the cost."""
        return ((self.u[:, at].astype(np.int64) * self.supply[:, at]).sum(axis=0) + (self.v[:, at].astype(np.int64) * self.demand[:, at]).sum(axis=0)) // _LOW

    def _keep(self, which: np.ndarray) -> None:
        k = len(which)
        kept = np.flatnonzero(which)
        for name in ("cost", "flow", "holds"):
            setattr(self, name, getattr(self, name).reshape(k, -1)[kept].reshape(-1, *getattr(self, name).shape[1:]))
        for name in ("supply", "demand", "ex", "de", "closed", "u", "v", "left", "place", "key", "weight", "reached", "drow", "pr", "pc", "source", "inside", "pending", "now", "column"):
            setattr(self, name, np.take(getattr(self, name), kept, axis=-1))

    def _expand(self) -> None:
        """Distances of columns by way of a row that was reached; of each tree one."""
        every = np.arange(len(self.left))
        waits = self.pending != 0
        bit = self.pending & -self.pending
        i = np.where(waits, np.bitwise_count(bit - waits).astype(np.int64), 0)
        self.inside |= bit
        self.pending ^= bit
        add = np.where(waits, self.now - self.u[i, every], self.kind(0))
        g = every if waits.all() else np.flatnonzero(waits)
        self.drow[i[g], g], self.pc[i[g], g] = self.now[g], self.column[g]
        new = np.ascontiguousarray(np.take(self.cost, every * self.n + i, axis=0).T)
        np.add(new, self.weight, out=new)
        np.add(new, add, out=new)
        better = new < self.key
        better &= waits
        np.copyto(self.key, new, where=better)
        np.copyto(self.pr, i.astype(np.int8)[None, :], where=better)

    def _nearest(self) -> None:
        """The nearest column of each tree without a waiting row: mass is sent there, or the rows that it holds mass of are reached."""
        best = self.key.min(axis=0)
        free = (self.pending == 0) & (self.left > 0)
        open_ = (best & _SPENT) == 0
        h = np.flatnonzero(free & ~open_)
        if len(h):
            j = best[h] & (_SPENT - 1)
            distance = best[h] & ~self.kind(_LOW - 1)
            self.key[j, h] = self.far
            self.weight[j, h] = self.out
            self.reached[j, h] = distance
            self.now[h], self.column[h] = distance, j
            self.pending[h] = self.holds[h * self.m + j] & ~self.inside[h]
        h = np.flatnonzero(free & open_)
        if len(h):
            self._send(h, (best[h] & (_SPENT - 1)).astype(np.int64), best[h] & ~self.kind(_LOW - 1))

    def _send(self, at: np.ndarray, target: np.ndarray, distance: np.ndarray) -> None:
        source = self.source[at]
        amount = np.minimum(self.ex[source, at], self.de[target, at])
        there, back, open_, j = [], [], np.arange(len(at)), target
        while len(open_):
            i = self.pr[j, at[open_]].astype(np.int64)
            there.append((open_, i, j))
            inner = i != source[open_]
            open_, i = open_[inner], i[inner]
            if not len(open_):
                break
            j = self.pc[i, at[open_]].astype(np.int64)
            held = self.flow[(at[open_] * self.m + j) * self.n + i]
            amount[open_] = np.minimum(amount[open_], held)
            back.append((open_, i, j, held))
        for of, i, column in there:
            self._move(at[of], i, column, amount[of])
        spent = (left := self.ex[source, at] - amount) == 0
        self.ex[source, at] = left
        self.de[target, at] -= amount
        self.left[at] -= amount
        for of, i, column, held in back:
            self._move(at[of], i, column, -amount[of])
            spent[of] |= held == amount[of]
        # A tree whose source has more to send and whose branches all hold grows on.
        on = np.flatnonzero(~spent)
        if len(on):
            full = on[self.de[target[on], at[on]] == 0]
            self.key[target[full], at[full]] += self.kind(_SPENT)
            self.weight[target[full], at[full]] += self.kind(_SPENT)
        at, distance = at[spent], distance[spent]
        self.u[:, at] += np.maximum(distance - self.drow[:, at], 0)
        self.v[:, at] -= np.maximum(distance - self.reached[:, at], 0)
        self._plant(at)
