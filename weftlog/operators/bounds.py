"""Whether distances lie above or below a value, decided by bounds where these suffice.

A p-value asks of each replicate only on which side of the logs' distance its own
lies. Entropic transport gives both a plan and prices by a few products of
matrices for all replicates of a pair: the plan, scaled until no mass is
exceeded and completed with what is left over, costs at least the distance; the
prices, lowered until no pair's cost is exceeded, are worth at most the distance.
What the bounds leave open is solved exactly, so nothing is estimated.
"""

from __future__ import annotations

import numpy as np

STAGES = ((0.05, 6, np.float32), (0.02, 10, np.float32), (0.01, 20, np.float64), (0.005, 40, np.float64), (0.0025, 80, np.float64))  # width of the smoothing, rounds, type
MARGIN = 2e-5  # of the highest cost, far beyond what rounding makes of a bound
CELLS = 120_000  # cells of replicates' masses at once: some arrays of them stay in a core's cache
_FAR = np.float32(1e3)


def beyond(cost: np.ndarray, one: np.ndarray, two: np.ndarray, value: float) -> np.ndarray:
    """1 where the distance of counts (R, V) and (R, V) under costs (V, V) is above ``value``, -1 where it is below, 0 where the bounds do not tell."""
    out = np.zeros(len(one), np.int8)
    top = float(cost.max(initial=0))
    if top <= 0 or not np.isfinite(value):
        return out
    costs = [(eps, rounds, kind, *(x.astype(kind) for x in (cost / top, np.exp(-cost / (top * eps))))) for eps, rounds, kind in STAGES]
    step = max(1, CELLS // cost.shape[1])
    for lo in range(0, len(one), step):
        own = slice(lo, lo + step)
        out[own] = _decided(costs, _shares(one[own]), _shares(two[own]), value / top)
    return out


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def _decided(costs: list, a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    out, open_ = np.zeros(len(a), np.int8), np.flatnonzero((a.sum(axis=1) > 0) & (b.sum(axis=1) > 0))
    g = np.zeros((len(open_), a.shape[1]))
    a, b = a[open_], b[open_]
    for eps, rounds, kind, c, kernel in costs:
        least = np.finfo(kind).tiny
        x, y = a.astype(kind), b.astype(kind)
        w = np.exp(g / eps).astype(kind)
        w[y == 0] = 0
        u = None
        for k in range(rounds):
            relaxed = 0 < k < rounds - 2
            u = _scaled(x, w @ kernel, u if relaxed else None)
            w = _scaled(y, u @ kernel, w if relaxed else None)
        low = _plan(c, kernel, x, y, u, w) < value - MARGIN
        out[open_[low]] = -1
        rest = np.flatnonzero(~low)
        f = np.log(np.maximum(u[rest], least), dtype=np.float64) * eps
        g = np.log(np.maximum(w[rest], least), dtype=np.float64) * eps
        a, b, open_ = a[rest], b[rest], open_[rest]
        high = _prices(c, a, b, f) > value + MARGIN
        out[open_[high]] = 1
        rest = np.flatnonzero(~high)
        a, b, g, open_ = a[rest], b[rest], g[rest], open_[rest]
        if not len(open_):
            break
    return out


def _scaled(mass: np.ndarray, reach: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """Factors that fit ``mass``; with those of ``before``, half as far again from them, which takes fewer rounds."""
    least = np.finfo(reach.dtype).tiny
    reach += least
    found = np.divide(mass, reach, out=reach)
    if before is not None:
        more = found / (before + least)
        found *= np.sqrt(more, out=more)
    return found


def _plan(c: np.ndarray, kernel: np.ndarray, a: np.ndarray, b: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Cost of the plan ``u kernel w``, scaled to exceed no mass; what is left is sent in proportion."""
    least = np.finfo(c.dtype).tiny
    u = u * np.minimum(a / np.maximum(u * (w @ kernel), least), 1)
    w = w * np.minimum(b / np.maximum(w * (u @ kernel), least), 1)
    left, wanted = np.maximum(a - u * (w @ kernel), 0), np.maximum(b - w * (u @ kernel), 0)
    sent = np.einsum("ij,ij->i", u, w @ (kernel * c))
    return sent + np.einsum("ij,ij->i", left @ c, wanted) / np.maximum(np.minimum(left.sum(axis=1), wanted.sum(axis=1)), 1e-12)


def _prices(c: np.ndarray, a: np.ndarray, b: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Worth of prices: the columns' as high as ``f`` allows, then the rows' as high as those allow."""
    c = c.astype(np.float32)
    supplied, wanted = (np.ascontiguousarray(x.T) > 0 for x in (a, b))
    rows = np.where(supplied, f.T, -_FAR).astype(np.float32)
    columns = np.where(wanted, _lowest(c.T, rows), -_FAR)
    rows = np.where(supplied, _lowest(c, columns), 0)
    return np.einsum("ij,ji->i", a, rows) + np.einsum("ij,ji->i", b, np.where(wanted, columns, 0))


def _lowest(c: np.ndarray, prices: np.ndarray) -> np.ndarray:
    """The least of cost less price over the last axis of ``c``, for prices (V, R)."""
    least, more = np.full(prices.shape, _FAR), np.empty_like(prices)
    for k in range(len(prices)):
        np.subtract(c[:, k][:, None], prices[k][None, :], out=more)
        np.minimum(least, more, out=least)
    return least
