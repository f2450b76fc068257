import pytest
from conftest import LIFECYCLE_SCHEMA, day
from pyspark.sql import functions as F

from weftlog.functions.columns import CASE, INSTANCE, START, TIME, col
from weftlog.operators import prepare


def spans(df):
    rows = df.select(col(CASE).alias("c"), col("concept:name").alias("a"), col(START).alias("s"), col(TIME).alias("e")).collect()
    return sorted((r["c"], r["a"], (r["s"] - day(0)).days, (r["e"] - day(0)).days) for r in rows)


# Published intervals of the first case, in days.
FIRST = [("case1", "a", 1, 3), ("case1", "b", 2, 6), ("case1", "c", 4, 5), ("case1", "d", 7, 7)]


def test_fifo(lifecycle_log):
    got = spans(prepare.lifecycle_to_interval(lifecycle_log, instance=None))
    assert got == FIRST + [("case2", "a", 7, 11), ("case2", "a", 9, 12), ("case2", "b", 8, 10)]
    assert got == spans(prepare.lifecycle_to_interval(lifecycle_log.drop(INSTANCE), width_us=86_400_000_000))


def test_instances(lifecycle_log):
    assert spans(prepare.ensure_start(lifecycle_log)) == FIRST + [("case2", "a", 7, 12), ("case2", "a", 9, 11), ("case2", "b", 8, 10)]


def test_ambiguous_instances_raise(spark):
    # The public fixture with an instance that starts twice, and its message.
    activities = ["a", "b", "a", "b", "a", "a"]
    transitions = ["start", "start", "start", "complete", "complete", "complete"]
    days = [7, 8, 9, 10, 11, 12]
    instances = ["i1", "i2", "i1", "i2", "i1", "i1"]
    rows = [(o, "case", a, k, day(n), i) for o, (a, k, n, i) in enumerate(zip(activities, transitions, days, instances))]
    log = spark.createDataFrame(rows, LIFECYCLE_SCHEMA)
    message = "Multiple starting events found for single complete event of instance id i1"
    with pytest.raises(Exception, match=message):
        prepare.lifecycle_to_interval(log).collect()
    with pytest.raises(Exception, match=message):
        prepare.fold_instances(log).collect()
    assert prepare.lifecycle_to_interval(log, on_ambiguous="first").count() == 3


def test_strict(lifecycle_log):
    strict = prepare.ensure_start(lifecycle_log.drop(INSTANCE), strict=True)
    assert spans(strict) == FIRST + [("case2", "a", 7, 11), ("case2", "a", 9, 12), ("case2", "b", 8, 10)]
    ids = [r[0] for r in strict.where(col(CASE) == "case2").orderBy("event_ord").select(col(INSTANCE)).collect()]
    assert sorted(ids) == ["0", "0", "1"]
    # Published instances of the log without lifecycle.
    instances = ["0", "0", "1", "0", "1", "1", "0", "0", "0", "1", "1", "2", "3"]
    plain = prepare.ensure_start(lifecycle_log.drop(INSTANCE, "lifecycle:transition"), strict=True).orderBy("event_ord")
    assert [r[INSTANCE] for r in plain.collect()] == instances
    assert plain.where(col(START) != col(TIME)).count() == 0


def test_atomic(spark):
    log = spark.createDataFrame([(i, "case1", a, day(i)) for i, a in enumerate("abcd", 1)], "event_ord long, `case:concept:name` string, `concept:name` string, `time:timestamp` timestamp_ntz")
    assert [r[INSTANCE] for r in prepare.atomic_to_lifecycle(log).orderBy("event_ord").collect()] == [f"case1:{k}" for k in range(1, 5)]
    assert spans(prepare.ensure_start(log)) == [("case1", a, i, i) for i, a in enumerate("abcd", 1)]


def test_durations_and_waits(lifecycle_log):
    log = prepare.ensure_start(lifecycle_log)
    took = prepare.add_duration(log).select("event_ord", col(prepare.DURATION).alias("d"))
    assert {r[0]: r[1] / 86400 for r in took.collect()} == {3: 2.0, 5: 1.0, 6: 4.0, 7: 0.0, 11: 2.0, 12: 2.0, 13: 5.0}
    waits = {r["event_ord"]: r["w"] / 86400 for r in prepare.add_waiting_time(log).select("event_ord", col(prepare.WAITING).alias("w")).collect()}
    assert waits[3] == 0 and waits[5] == 1.0 and waits[6] == -3.0 and waits[7] == 1.0
    with pytest.raises(ValueError):
        prepare.add_duration(log.drop(START))


def test_sampling(spark, lifecycle_log):
    many = lifecycle_log.crossJoin(spark.range(100).withColumnRenamed("id", "rep")).select(
        (F.col("event_ord") + F.col("rep") * 100).alias("event_ord"), F.concat(col(CASE), F.lit("_"), F.col("rep")).alias(CASE), *[col(c) for c in lifecycle_log.columns[2:]]
    )
    assert prepare.log_len(many).first()[0] == 200
    for method in ("event_biased", "uniform"):
        a, b = prepare.split_cases(many, 0.5, 3, method)
        again = prepare.split_cases(many, 0.5, 3, method)[0]
        first, second = ({r[0] for r in x.select(col(CASE)).distinct().collect()} for x in (a, b))
        assert len(first) == 100 and len(second) == 100 and not first & second
        assert first == {r[0] for r in again.select(col(CASE)).distinct().collect()}
        assert first != {r[0] for r in prepare.split_cases(many, 0.5, 4, method)[0].select(col(CASE)).distinct().collect()}
        assert a.count() + b.count() == many.count()
    assert prepare.sample_cases(many, 1000).count() == many.count()
    assert prepare.sample_cases(many, 0).count() == 0


def test_nulls_empty_and_clashing_columns(spark, lifecycle_log):
    odd = spark.createDataFrame([(1, None, "a", "complete", day(1), "x"), (2, "c", None, "complete", day(1), "x"), (3, "c", "a", None, day(1), None), (4, "c", "a", "complete", None, "x"), (5, "c", "a", "complete", day(2), None)], LIFECYCLE_SCHEMA)
    odd = odd.withColumns({"ts_us": F.lit(1), "slice": F.lit("s"), "pos": F.lit(2), "case_id": F.lit("n"), "_rank": F.lit(0)})
    for f in (prepare.lifecycle_to_interval, prepare.infer_instances, prepare.fold_instances, prepare.add_instance_ids):
        assert set(odd.columns) <= set(f(odd).columns)
        f(odd).collect()
    got = prepare.lifecycle_to_interval(odd)
    assert sorted((r["event_ord"], r["slice"], r["pos"]) for r in got.collect()) == [(2, "s", 2), (5, "s", 2)]
    for f in (prepare.lifecycle_to_interval, prepare.infer_instances, prepare.fold_instances, prepare.add_instance_ids, prepare.atomic_to_lifecycle):
        assert f(lifecycle_log.limit(0)).count() == 0
