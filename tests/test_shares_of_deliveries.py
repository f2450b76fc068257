"""Large delivery tables are joined a share at a time."""

import pytest
from test_delivery_traces import folder  # noqa: F401

from weftlog.functions import checkpoints
from weftlog.operators import whole_pairs
from weftlog.plans import core_queries

# One line for each finding of the round: what its query bins.
FOUND = {"F5": "quantity"}


@pytest.mark.parametrize("value", FOUND.values(), ids=FOUND)
def test_orders_are_joined_a_share_at_a_time(spark, folder, monkeypatch, value):  # noqa: F811
    def rows():
        return sorted(core_queries.binned_delivery_traces(spark, folder, value).collect(), key=str)

    expected, seen, stored = rows(), [], core_queries.stored
    monkeypatch.setattr(core_queries, "JOINED_ROWS", 9, raising=False)
    monkeypatch.setattr(core_queries, "stored", lambda *parts: seen.extend(p.count() for p in parts) or stored(*parts))
    assert rows() == expected and len(expected) > 9
    assert len(seen) > 2 and max(seen) < sum(seen)


# One line for each finding: a query whose pairs are brought together a share at a time.
TOGETHER = {"F7": "double_bootstrap_timed"}


@pytest.mark.parametrize("name", TOGETHER.values(), ids=TOGETHER)
def test_pairs_are_brought_together_a_share_at_a_time(spark, folder, monkeypatch, name):  # noqa: F811
    expected = sorted(core_queries.QUERIES[name](spark, folder).collect())
    seen, stored = [], checkpoints.stored
    monkeypatch.setattr(whole_pairs, "SHUFFLED", 2, raising=False)
    monkeypatch.setattr(whole_pairs, "stored", lambda *parts: seen.extend(p.count() for p in parts) or stored(*parts), raising=False)
    assert sorted(core_queries.QUERIES[name](spark, folder).collect()) == expected and expected
    assert len(seen) > 1 and max(seen) < sum(seen)


# One line for each finding: what its query bins.
KEPT = {"F9": "duration"}


@pytest.mark.parametrize("value", KEPT.values(), ids=KEPT)
def test_stored_lines_are_activities_and_numbers(spark, folder, monkeypatch, value):  # noqa: F811
    seen, stored = [], core_queries.stored
    monkeypatch.setattr(core_queries, "stored", lambda *parts: seen.append(stored(*parts)) or seen[-1])
    core_queries.binned_delivery_traces(spark, folder, value)
    kinds = {f.name: f.dataType.simpleString() for f in seen[0].schema}
    assert kinds.pop("lines") == kinds.pop("untimed") == "array<struct<activity:string,number:double>>"
    assert sorted(kinds) == ["case_id", "logs"]
