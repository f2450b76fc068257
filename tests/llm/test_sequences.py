"""Subsequences, runs and frequent items against brute force."""

import datetime as dt
import itertools
import math
import random
from collections import Counter, defaultdict

import pytest

from weftlog.llm.runs import collapse_runs, resolve_names
from weftlog.llm.subsequences import frequent_subsequences
from weftlog.llm.topitems import field_values, heavy_items, top_items

ORIGIN = dt.datetime(2023, 1, 1)


def occurs(pattern, seq):
    rest = iter(seq)
    return all(x in rest for x in pattern)


@pytest.mark.parametrize(("chunk", "block", "share"), [(4096, 100_000, 0.3), (3, 2, 0.3), (2, 1, 0.3)])
def test_subsequences(spark, chunk, block, share):
    rng = random.Random(4096)
    cases = {f"c{i}": [rng.choice("abcab") for _ in range(rng.randint(1, 7))] for i in range(14)} | {"hot": [rng.choice("abcd") for _ in range(30)]}
    events = [(c, a, i // 2, o, "x") for c, seq in cases.items() for i, (a, o) in enumerate(zip(seq, itertools.count(ord(c[0]) * 1000 + len(c) * 100)))]
    df = spark.createDataFrame(events, "case_id string, activity string, ts_us long, ord long, item string")
    least = max(5, math.ceil(len(cases) * share - 1e-9))
    expected = {}
    for n in (3, 4, 5):
        for pattern in itertools.product("abcd", repeat=n):
            hits = sum(occurs(pattern, seq) for seq in cases.values())
            if hits >= least:
                expected[">".join(pattern)] = hits
    got = {r[0]: r[1] for r in frequent_subsequences(df, share, 5, chunk=chunk, block=block).collect()}
    assert got == expected and expected
    if chunk == 4096:
        assert frequent_subsequences(df.limit(0)).count() == 0
        assert frequent_subsequences(df, 1.0, 1000).count() == 0


ACTIVITIES = ["Check form A", "Check form B", "Review stage 1", "Review stage 2", "Print label S", "Close claim"]
SPELLINGS = {
    "check_form_a": "Check form A",
    "CheckFormB": "Check form B",
    '"Check form B"': "Check form B",
    "Chekc form A": "Check form A",
    "REVIEW STAGE 1/1": "Review stage 1",
    "review stage 2 2": "Review stage 2",
    "Review stage 2": "Review stage 2",
    "Reviev-stage-1": "Review stage 1",
    "Review stage 1 #3": "Review stage 1",
    "Print  label S x2": "Print label S",
    "Сlоse claim (2)": "Close claim",
    " close.clam\t": "Close claim",
}


def activities(spark):
    return spark.createDataFrame([(i, a) for i, a in enumerate(ACTIVITIES)], "activity_id int, act_name string")


def test_spellings(spark):
    names = spark.createDataFrame([(n,) for n in SPELLINGS], "name string")
    assert {r[0]: r[1] for r in resolve_names(names, activities(spark)).collect()} == SPELLINGS
    assert {r[1] for r in resolve_names(names, activities(spark).limit(0)).collect()} == {None}


@pytest.fixture(params=[10_000, 7])
def batch_rows(request, spark):
    """Rows of an Arrow batch: events of one task in one batch, or in many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.set(name, before)


def test_runs(spark, batch_rows):
    rng = random.Random(4)
    spelled = list(SPELLINGS)[:4] + ["Close claim"]
    rows = [(i, rng.choice(["a", "hot", "hot", None]), rng.choice([*spelled, None]), rng.choice([None, *range(60)])) for i in range(200)]
    rows += [(200 + i, *r[1:]) for i, r in enumerate(rng.choices(rows, k=30))]
    # One run over several partitions, with a break near its end, and a case of single events.
    rows += [(1000 + i, "long", rng.choice(spelled[:1]) if i != 390 else spelled[2], 100 + i) for i in range(400)]
    rows += [(2000 + i, f"one{i}", spelled[0], i) for i in range(20)]
    log = spark.createDataFrame([(o, c, a, None if t is None else ORIGIN + dt.timedelta(seconds=t), "k", 3) for o, c, a, t in rows], "event_ord long, `case:concept:name` string, `concept:name` string, `time:timestamp` timestamp_ntz, name string, chunk int")
    first = {}
    for o, c, a, t in rows:
        if None not in (c, a, t):
            first[(c, a, t)] = min(o, first.get((c, a, t), o))
    cases = defaultdict(list)
    for (c, a, t), o in first.items():
        cases[c].append((t, o, SPELLINGS.get(a, a)))
    expected = set()
    for c, seq in cases.items():
        for name, group in itertools.groupby(sorted(seq), key=lambda e: e[2]):
            run = list(group)
            if len(run) > 1:
                expected.add((c, run[0][1], name, len(run), (run[-1][0] - run[0][0]) * 1_000_000))
    got = [tuple(r) for r in collapse_runs(log, activities(spark)).collect()]
    assert sorted(got) == sorted(expected) and expected
    assert collapse_runs(log.limit(0), activities(spark)).count() == 0


def test_frequent_items(spark):
    rng = random.Random(9)
    names = [rng.choice(["a"] * 30 + ["b"] * 5 + [f"r{i}" for i in range(300)] + [None] * 20) for _ in range(2000)]
    steps = spark.createDataFrame([("l", "c", i, n, "z") for i, n in enumerate(names)], "log_id string, `case:concept:name` string, step_no int, `concept:name` string, item_key string")
    variants = [[["a", "b"], ["c"]], None, [], [["a", "b"], None, ["a", None, "b"]], [["a", "b"]] * 9]
    languages = spark.createDataFrame([("l", v) for v in variants], "log_id string, variants array<array<string>>")
    counts = Counter(n for n in names if n is not None)
    expected = {("concept:name", k) for k, n in counts.items() if n * 200 > sum(counts.values()) and n >= 5} | {("variants", "a>b")}
    values = field_values(steps, languages)
    assert {tuple(r) for r in heavy_items(values).collect()} == expected
    top = [(r["item_key"], r["n"]) for r in top_items(values, 3).where("field_name = 'concept:name'").orderBy("n", ascending=False).collect()]
    assert [n for _, n in top] == [n for _, n in counts.most_common(3)]
    assert top_items(field_values(steps.limit(0), languages.limit(0))).count() == 0
