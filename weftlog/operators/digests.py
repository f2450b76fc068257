"""MD5 of many short texts at once, bit for bit as the SQL function gives it."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np

# The algorithm's shifts, additive constants and start.
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_START = tuple(np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
_PLACES = ((1, 0), (5, 1), (3, 5), (7, 0))  # which word a step of each round takes: factor, offset

ONE_BLOCK = 55  # bytes of a text up to which one block holds it
CELLS = 131_072  # texts in step: their state is some 3 MB, and each of 600 passes outweighs its call


def _blocks(texts: Sequence[bytes]) -> np.ndarray:
    """Padded blocks of texts of at most ``ONE_BLOCK`` bytes, as (n, 16) words."""
    raw = np.frombuffer(b"".join(t + b"\x80" + bytes(55 - len(t)) + (8 * len(t)).to_bytes(8, "little") for t in texts), dtype="<u4")
    return raw.reshape(len(texts), 16).astype(np.uint32)


def _rounds(fixed: np.ndarray, moving: np.ndarray, words: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of (r, n) blocks that are the sum of a column's words and a row's; only ``words`` differ by row."""
    shape = (len(moving), len(fixed))
    block = {k: fixed[:, k][None, :] + (moving[:, k][:, None] if k in words else np.uint32(0)) for k in range(16)}
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    t, more = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for step in range(64):
        turn = step // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        a += t
        factor, offset = _PLACES[turn]
        a += block[(factor * step + offset) % 16] + _ADDED[step]
        shift = _SHIFTS[turn][step % 4]
        np.left_shift(a, np.uint32(shift), out=more)
        a >>= np.uint32(32 - shift)
        a |= more
        a += b
        a, b, c, d = d, a, b, c
    for x, start in zip((a, b, c, d), _START):
        x += start
    high, low = (x.byteswap().astype(np.uint64) << np.uint64(32) | y.byteswap() for x, y in ((a, b), (c, d)))
    return high, low


def _places(rows: np.ndarray, columns: np.ndarray) -> tuple:
    """Where rows and columns (growing) meet; as slices, which take no search, where neither skips a number."""
    if all(x[-1] - x[0] == len(x) - 1 for x in (rows, columns)):
        return tuple(slice(x[0], x[-1] + 1) for x in (rows, columns))
    return np.ix_(rows, columns)


def digests(head: str, numbers: np.ndarray, tails: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """MD5 of ``head + number + tail`` for every number (rows) and tail (columns), as two arrays of the first and last 64 bits.

    ``numbers`` are whole and not negative.
    """
    begin, ends = head.encode(), [t.encode() for t in tails]
    high, low = (np.empty((len(numbers), len(tails)), np.uint64) for _ in range(2))
    digits = np.array([len(str(x)) for x in numbers])
    for width in np.unique(digits):
        rows = np.flatnonzero(digits == width)
        short = np.array([len(begin) + width + len(e) <= ONE_BLOCK for e in ends], dtype=bool)
        for j in np.flatnonzero(~short):
            for i in rows:
                found = hashlib.md5(begin + str(numbers[i]).encode() + ends[j], usedforsecurity=False).digest()
                high[i, j], low[i, j] = int.from_bytes(found[:8]), int.from_bytes(found[8:])
        columns = np.flatnonzero(short)
        if not len(columns):
            continue
        fixed = _blocks([begin + bytes(width) + ends[j] for j in columns])
        moving = np.zeros((len(rows), 64), np.uint8)
        moving[:, len(begin) : len(begin) + width] = np.frombuffer("".join(str(numbers[i]) for i in rows).encode(), np.uint8).reshape(len(rows), width)
        moving = moving.view("<u4").astype(np.uint32)
        words = set(range(len(begin) // 4, (len(begin) + int(width) - 1) // 4 + 1))
        across = min(len(columns), 1024)
        down = max(1, CELLS // across)
        for x in range(0, len(columns), across):
            for y in range(0, len(rows), down):
                at = _places(rows[y : y + down], columns[x : x + across])
                high[at], low[at] = _rounds(fixed[x : x + across], moving[y : y + down], words)
    return high, low
