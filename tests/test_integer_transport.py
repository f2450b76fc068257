"""Transport in whole numbers gives what the solver for any costs gives."""

import numpy as np
import pytest

from weftlog.operators import transport
from weftlog.operators.distance import edit_tables
from weftlog.operators.integer_transport import fits, integer_transport


@pytest.mark.parametrize("most", [5, 1 << 25])
def test_same_totals(most):
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (2, 5), (6, 4), (9, 11), (30, 25)):
        cost = rng.integers(0, most, (40, n, m))
        a, b = rng.integers(0, 4, (40, n)), rng.integers(0, 3, (40, m))
        a[0], b[1] = 0, 0
        a, b = a * b.sum(axis=1)[:, None], b * a.sum(axis=1)[:, None]
        expected = np.rint(transport.transport(cost.astype(float), a, b))
        assert np.array_equal(integer_transport(cost, a, b), expected)
        assert [integer_transport(cost[k : k + 1], a[k : k + 1], b[k : k + 1])[0] for k in range(9)] == expected[:9].tolist()


def test_costs_in_parts_of_a_unit_take_whole_numbers(monkeypatch):
    """groups whose costs have a unit do not go through the solver for any costs, those without do."""
    rng = np.random.default_rng(3)
    groups = [(rng.integers(0, 3, (7, v)), rng.integers(0, 2, (7, v)), rng.integers(0, 9, (v, v)) / 12) for v in (2, 5, 3, 6)]
    expected = [transport.emd_many([(a, b, c) for a, b in zip(one, two)]) for one, two, c in groups]
    for cells in (1, 60, 10_000):
        assert all(np.array_equal(x, y) for x, y in zip(transport.emd_groups(groups, cells, [12, 0, 12, 12]), expected))
    monkeypatch.setattr(transport, "transport", None)
    assert all(np.array_equal(x, y) for x, y in zip(transport.emd_groups(groups, units=[12] * 4), expected))


def test_as_many_rows_as_a_set_holds_take_whole_numbers(monkeypatch):
    """logs of some forty variants a side."""
    rng = np.random.default_rng(4)
    group = [(rng.integers(1, 3, (3, 40)), rng.integers(1, 2, (3, 40)), rng.integers(0, 9, (40, 40)) / 12)]
    expected = transport.emd_groups(group)
    monkeypatch.setattr(transport, "transport", None)
    assert np.array_equal(transport.emd_groups(group, units=[12])[0], expected[0])


def test_sizes_beyond_whole_numbers_are_told():
    assert fits(20, 20, 420) is np.int32 and fits(20, 20, 1 << 30) is np.int64 and fits(63, 20, 1) is None and fits(20, 20, 1 << 60) is None


@pytest.mark.parametrize("scale", [1.0, 4.0, 2.5])
def test_edit_tables_are_filled_alike(scale):
    rng = np.random.default_rng(2)

    def one(a, x, b, y):
        row = np.cumsum([0.0, *(1 + y / scale)])
        for c, k in zip(a, x):
            new = [row[0] + 1 + k / scale]
            for j, (d, z) in enumerate(zip(b, y)):
                new.append(min(row[j + 1] + 1 + k / scale, new[-1] + 1 + z / scale, row[j] + (c != d) + abs(k - z) / scale))
            row = np.array(new)
        return row[-1]

    sa, sb = rng.integers(0, 6, 50), rng.integers(0, 7, 50)
    a, x, b, y = rng.integers(-1, 3, (50, 6)), rng.integers(0, 5, (50, 6)), rng.integers(-1, 3, (50, 7)), rng.integers(0, 5, (50, 7))
    expected = [one(a[k, : sa[k]], x[k, : sa[k]], b[k, : sb[k]], y[k, : sb[k]]) for k in range(50)]
    assert np.allclose(edit_tables(a, x, sa, b, y, sb, scale), expected, rtol=0, atol=1e-12)
