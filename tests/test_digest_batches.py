"""Digests are made in large steps and stay the same."""

import hashlib

import numpy as np

from weftlog.operators import digests


def test_many_texts_take_few_steps(monkeypatch):
    """F8: calls of NumPy cost more than its passes where a step has few texts."""
    numbers, tails = np.arange(9_950, 10_050), [f":3:1:{c}" for c in range(1000)]
    calls, rounds = [], digests._rounds

    def counted(fixed, moving, words):
        calls.append(len(fixed) * len(moving))
        return rounds(fixed, moving, words)

    monkeypatch.setattr(digests, "_rounds", counted)
    high, low = digests.digests("42:", numbers, tails)
    assert sum(calls) == 100_000 and len(calls) == 2  # one for numbers of four digits, one for those of five
    for i, j in ((0, 0), (49, 999), (50, 7), (99, 512)):
        assert hashlib.md5(f"42:{numbers[i]}{tails[j]}".encode()).digest() == int(high[i, j]).to_bytes(8) + int(low[i, j]).to_bytes(8)


def test_numbers_and_texts_in_any_order():
    numbers, tails = np.array([12, 7, 100, 8, 13]), [":a", "x" * 70, ":b", ":c"]
    high, low = digests.digests("1:", numbers, tails)
    for i, n in enumerate(numbers):
        for j, t in enumerate(tails):
            assert hashlib.md5(f"1:{n}{t}".encode()).digest() == int(high[i, j]).to_bytes(8) + int(low[i, j]).to_bytes(8)
