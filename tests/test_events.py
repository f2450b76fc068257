"""Interval, timestamp and feature operators against brute force on small, dirty tables."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlog.functions import columns
from weftlog.functions.columns import sliced_lag
from weftlog.functions.ordered import before_parts, in_order, numbered
from weftlog.operators import features
from weftlog.operators.features import SlicedCounters, bitmap, both, either, entity_features, feature_cells, places_of
from weftlog.operators.intervals import busy_spans
from weftlog.operators.timestamps import estimate_zones, instant_at, normalise_timestamps, read_values

INTERVALS = "event_ord long, `case:concept:name` string, start_timestamp timestamp_ntz, `time:timestamp` timestamp_ntz, slice string, w int, case_id int"
ORIGIN = dt.datetime(2023, 1, 1)
ORIGIN_US = 1_672_531_200_000_000


def at(us):
    return None if us is None else ORIGIN + dt.timedelta(microseconds=us)


def spans_of(rows):
    by_case = defaultdict(list)
    for case, a, b in rows:
        if case is not None and a is not None and b is not None and a <= b:
            by_case[case].append((a, b))
    out = []
    for case, spans in by_case.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(case, "period", a, b) for a, b in merged] + [(case, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])]
    return sorted(out)


@pytest.mark.parametrize(("width", "large"), [(10, 1_000_000), (30 * 86_400_000_000, 1_000_000), (30 * 86_400_000_000, 3)])
def test_busy_spans(spark, monkeypatch, width, large):
    monkeypatch.setattr(columns, "LARGE", large)
    rng = random.Random(width)
    rows = [(rng.choice(["a", "b", "c", None, ""]), rng.choice([None, *range(60)]), rng.choice([None, *range(60)])) for _ in range(60)]
    rows += [("hot", x, x + rng.choice([0, 1, 2, 30])) for x in rng.sample(range(400), 60)] + [("touch", 0, 5), ("touch", 5, 7), ("touch", 8, 8), ("touch", 8, 8)]
    log = spark.createDataFrame([(i, c, at(a), at(b), "s", 1, 2) for i, (c, a, b) in enumerate(rows)], INTERVALS)
    got = sorted((r[0], r[1], r[2] - ORIGIN_US, r[3] - ORIGIN_US) for r in busy_spans(log, width_us=width).collect())
    assert got == spans_of(rows)
    assert busy_spans(log.limit(0)).count() == 0


SITES = [("S1", "Europe/Berlin", "DMY", "CET", "CEST"), ("S2", "America/New_York", "MDY", "EST", "EDT"), ("S3", "Australia/Lord_Howe", "DMY", None, None), ("S4", None, "DMY", None, None)]
# Value, site, instant in UTC (None: no case).
VALUES = [
    ("2023-06-01T12:00:00", "S1", "2023-06-01 10:00:00"),
    ("2023-06-01T12:00:00Z", None, "2023-06-01 12:00:00"),
    ("2023-06-01 12:00:00.123456789+05:30", "S1", "2023-06-01 06:30:00.123456"),
    ("2023-06-01 12:00:00,5", "S1", "2023-06-01 10:00:00.500000"),
    ("20230601120000", "S2", "2023-06-01 16:00:00"),
    ("20230601T120000Z", "S2", "2023-06-01 12:00:00"),
    ("1685620800", None, "2023-06-01 12:00:00"),
    ("1685620800123", None, "2023-06-01 12:00:00.123000"),
    ("1685620800123456", None, "2023-06-01 12:00:00.123456"),
    ("06/01/2023 12:00 AM", "S2", "2023-06-01 04:00:00"),
    ("06/01/2023 12:00:00", "S1", "2023-01-06 11:00:00"),
    ("06/01/2023 12:00:00", None, None),
    ("01.06.23, 14:30", "S1", "2023-06-01 12:30:00"),
    ("1 Jun 2023 08:00:00", "S2", "2023-06-01 12:00:00"),
    ("Thu, 01 Jun 2023 08:00:00 -0400", "S1", "2023-06-01 12:00:00"),
    ("June 1, 2023 8:00:00 pm", "S2", "2023-06-02 00:00:00"),
    ("2023-06-01 12:00:00 EST", "S1", "2023-06-01 17:00:00"),
    ("2023-06-01 12:00:00 XYZ", "S1", None),
    ("2023-06-01T12:00:00[Asia/Tokyo]", "S1", "2023-06-01 03:00:00"),
    ("2023-10-29T02:30:00+02:00[Europe/Berlin]", "S2", "2023-10-29 00:30:00"),
    ("2023-10-29T02:30:00[Europe/Berlin]", "S2", None),
    ("2023-03-26 02:30", "S1", None),
    ("2023-10-29 02:30", "S1", None),
    ("2023-04-02 01:45", "S3", None),
    ("2023-04-02 02:00", "S3", "2023-04-01 15:30:00"),
    ("2023-06-01T12:00:00", "S9", None),
    ("2023-06-01T12:00:00[No/Where]", "S1", None),
    ("2023-02-30 10:00", "S1", None),
    ("2023-06-01 24:00:00", "S1", None),
    ("2023-06-01 13:00 PM", "S1", None),
    ("12:40:07", "S1", None),
    ("n/a", "S1", None),
    ("", "S1", None),
    ("x" * 20_000, "S1", None),
    (None, "S1", None),
]


def test_timestamps(spark):
    schema = "event_ord long, `time:timestamp` string, start_timestamp string, site_id string, tz_name string, abbr int, value int, `case:concept:name` string"
    log = spark.createDataFrame([(i, v, None, s, "x", 1, 2, None) for i, (v, s, _) in enumerate(VALUES)], schema)
    sites = spark.createDataFrame(SITES[:3], "site_id string, tz_name string, date_order string, abbr_std string, abbr_dst string")
    got = {r["event_ord"]: r["utc_us"] for r in normalise_timestamps(log, sites).collect()}
    epoch = dt.datetime(1970, 1, 1)
    expected = {i: (dt.datetime.fromisoformat(u) - epoch) // dt.timedelta(microseconds=1) for i, (_, _, u) in enumerate(VALUES) if u}
    assert {k: (VALUES[k], v) for k, v in got.items()} == {k: (VALUES[k], v) for k, v in expected.items()}
    assert normalise_timestamps(log.limit(0), sites).count() == 0
    assert normalise_timestamps(log, sites.limit(0)).count() == 9  # what needs no site


def test_zone_estimate_from_arrival_order(spark):
    base, rows = 1_680_000_000, []
    for i in range(400):
        instant = base + i * 600
        if i % 2:
            rows.append((i, str(instant), None, "S1"))
        else:
            rows.append((i, (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=instant - 4 * 3600)).strftime("%Y-%m-%d %H:%M:%S"), None, "S4"))
    log = spark.createDataFrame(rows, "event_ord long, `time:timestamp` string, start_timestamp string, site_id string")
    sites = spark.createDataFrame(SITES, "site_id string, tz_name string, date_order string, abbr_std string, abbr_dst string")
    best = {r["site_id"]: r for r in estimate_zones(read_values(log, sites), sites).collect()}
    assert best["S4"]["tz_name"] == "America/New_York" and best["S4"]["n_values"] == 200
    assert normalise_timestamps(log, sites).where("event_ord = 0").first()["utc_us"] == base * 1_000_000


def test_instant_at_is_the_inverse_of_local_time(spark):
    df = spark.range(0, 24 * 366 * 2).select((F.lit(1_672_531_200_000_000) + F.col("id") * 1_800_000_000).alias("u"), F.lit("America/New_York").alias("z"))
    wall = df.withColumn("w", F.unix_micros(F.from_utc_timestamp(F.timestamp_micros("u"), F.col("z"))))
    wrong = wall.withColumn("back", instant_at(F.col("w"), F.col("z"))).where("back is null or back != u").count()
    assert wrong == 4  # the two hours that the autumn change shows twice, in half hours


def test_sliced_counters():
    rng = np.random.default_rng(2)
    counters, expected = SlicedCounters(), np.zeros(5000, dtype=np.int64)
    for _ in range(20):
        places = np.sort(rng.choice(5000, 50, replace=False))
        numbers = rng.integers(0, 1 << 40, 50)
        counters.add(places, numbers)
        expected[places] += numbers
    every = np.arange(5000)
    assert np.array_equal(SlicedCounters.unpack(counters.pack()).at(every), expected)
    counters.add_planes(SlicedCounters.unpack(counters.pack()).planes)
    assert np.array_equal(counters.at(every), 2 * expected)
    assert not SlicedCounters.unpack(SlicedCounters().pack()).at(every).any()


def test_compressed_bitmaps():
    rng = np.random.default_rng(3)
    for size in (0, 1, 40, 3000):
        a, b = (np.sort(rng.choice(4000, size, replace=False)) for _ in range(2))
        assert np.array_equal(places_of(bitmap(a)), a) and len(bitmap(a)[0]) <= size
        assert set(places_of(both(bitmap(a), bitmap(b)))) == set(a) & set(b)
        assert set(places_of(either(bitmap(a), bitmap(b)))) == set(a) ^ set(b)


EVENTS = "event_ord long, `case:concept:name` string, `concept:name` string, `lifecycle:transition` string, `time:timestamp` timestamp_ntz, case_id string, ordinal int"


def dirty_events(n=300, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "hot", "hot", None]), rng.choice(["x", "y", "z", None]), rng.choice(["complete"] * 5 + ["start", None]), rng.choice([None, *range(0, 90, 3)])) for _ in range(n)]
    rows += rng.choices(rows, k=40)
    return [(i, *r) for i, r in enumerate(rows)]


def sequences_of(rows):
    first = {}
    for o, c, a, k, t in rows:
        if k == "complete" and None not in (c, a, t):
            first[(c, a, t)] = min(o, first.get((c, a, t), o))
    out = defaultdict(list)
    for (c, a, t), o in first.items():
        out[c].append((t, o, a))
    return {c: sorted(v) for c, v in out.items()}


def features_of(sequences):
    expected, day_us = {}, 86_400_000_000
    for case, seq in sequences.items():
        for i, (t, _, a) in enumerate(seq):
            n, _, total = expected.get((case, a), (0, 0, 0))
            expected[(case, a)] = (n + 1, (seq[-1][0] - t) * day_us, total + (t - seq[i - 1][0]) * day_us * (i > 0))
    return expected


@pytest.mark.parametrize("slots", [1, 12, 1 << 19])
def test_features(spark, monkeypatch, slots):
    monkeypatch.setattr(features, "SLOTS", slots)
    rows = dirty_events()
    rows += [(1000 + i, f"c{i % 60}", "xyz"[i % 3], "complete", i // 7) for i in range(400)]
    log = spark.createDataFrame([(o, c, a, k, None if t is None else ORIGIN + dt.timedelta(days=t), "n", 7) for o, c, a, k, t in rows], EVENTS)
    expected = features_of(sequences_of(rows))
    assert {(r[0], r[1]): tuple(r)[2:] for r in feature_cells(log).collect()} == expected
    wide, types = entity_features(log)
    assert types == ["x", "y", "z"]
    assert {(r["case_id"], a): cell for r in wide.collect() for a, *cell in zip(types, r["n_events"], r["recency_us"], r["total_us"]) if cell[0]} == {k: list(v) for k, v in expected.items()}
    assert all((n == 0) == (since is None) for r in wide.collect() for n, since in zip(r["n_events"], r["recency_us"]))
    assert entity_features(log.limit(0))[0].count() == 0 and feature_cells(log.limit(0)).count() == 0


def test_one_case_with_all_rows_is_cut_by_rows(spark):
    events = spark.createDataFrame([("hot", 5, i) for i in range(4000)] + [(f"c{i}", i, i) for i in range(400)], "case_id string, ts_us long, ord long")
    ordered = in_order(events, "case_id", "ts_us", "ord")
    sizes = [r["count"] for r in ordered.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * sorted(sizes)[2]
    rows = [(r["case_id"], r["ts_us"], r["ord"]) for r in ordered.orderBy("row_no").collect()]
    assert rows == sorted(rows)
    before, n_cases = before_parts(ordered)
    assert n_cases == 401 and before[0] == (0, None, None) and before[3] == (401, "hot", 5)


@pytest.mark.parametrize("large", [1_000_000, 5])
def test_sliced_lag_numbers_every_event_once(spark, monkeypatch, large):
    monkeypatch.setattr(columns, "LARGE", large)
    rows = [("a", i * 7 % 50, i, f"v{i}") for i in range(80)] + [("b", 3, 100, "w")]
    events = spark.createDataFrame(rows, "case_id string, ts_us long, ord long, v string")
    got = {(r["case_id"], r["pos"]): (r["v"], r["prev_v"]) for r in sliced_lag(events, ["v"], width_us=9 if large > 5 else 1000).collect()}
    ordered = [v for _, t, o, v in sorted(rows[:80], key=lambda r: (r[1], r[2]))]
    assert got == {("a", i): (v, ordered[i - 1] if i else None) for i, v in enumerate(ordered)} | {("b", 0): ("w", None)}


def test_dense_slices_are_cut_by_rows(spark, monkeypatch):
    monkeypatch.setattr(columns, "LARGE", 100)
    rows = spark.range(6400).select(F.lit("hot").alias("case_id"), (F.col("id") % 640).alias("ts_us"), F.col("id").alias("ord")).unionByName(spark.range(50).select(F.lit("cold").alias("case_id"), F.col("id").alias("ts_us"), F.col("id").alias("ord")))
    sizes = columns.time_slices(rows, ["case_id"], "ts_us", 10_000).groupBy("case_id", "slice").count().collect()
    hot = [r["count"] for r in sizes if r["case_id"] == "hot"]
    assert len(hot) == 64 and max(hot) <= 2 * min(hot) and sum(hot) == 6400
    assert [r["count"] for r in sizes if r["case_id"] == "cold"] == [50]


def test_numbers_inside_keys(spark):
    rows = spark.createDataFrame([("hot", i * 7 % 3000) for i in range(3000)] + [(f"k{i % 50}", i) for i in range(300)], "key string, o long")
    got = [(r["key"], r["number"], r["o"]) for r in numbered(rows, "key", "o").collect()]
    expected = {k: sorted(o for key, o in map(tuple, rows.collect()) if key == k) for k in {g[0] for g in got}}
    assert len(got) == 3300 and all(expected[k][n] == o for k, n, o in got)
    assert numbered(rows.limit(0), "key", "o").count() == 0
