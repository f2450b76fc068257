import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftlog.functions.columns import CASE, INSTANCE, TIME, col
from weftlog.sources.xes import read_xes, write_xes
from weftlog.streaming.drift import drift, sessions, windowed_activity_counts


def test_xes_round_trip(spark, lifecycle_log, tmp_path):
    odd = lifecycle_log.withColumn("concept:name", F.when(col("event_ord") == 1, F.lit('a <&"> b')).otherwise(col("concept:name"))).withColumn(INSTANCE, F.when(col("event_ord") != 2, col(INSTANCE)))
    write_xes(odd, str(tmp_path / "log"))
    back = read_xes(spark, str(tmp_path / "log"))
    names = [CASE, "concept:name", "lifecycle:transition", TIME, INSTANCE]
    both = [sorted(tuple(str(r[n]) for n in names) for r in df.collect()) for df in (odd, back)]
    assert both[0] == both[1]
    order = [[r["concept:name"] for r in df.where(col(CASE) == "case1").orderBy("event_ord").collect()] for df in (odd, back)]
    assert order[0] == order[1]
    assert back.select("event_ord").distinct().count() == 13


def test_streams(spark, lifecycle_log, tmp_path):
    lifecycle_log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lifecycle_log.schema).parquet(str(tmp_path / "in"))
    for name, df in (("counted", windowed_activity_counts(stream)), ("sessioned", sessions(stream, "2 days"))):
        query = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "counted" else "append").start()
        query.processAllAvailable()
        query.stop()
    counts = spark.table("counted")
    assert counts.agg(F.sum("n")).first()[0] == 13
    reference = spark.createDataFrame([("a", 1.0)], "activity string, frequency double")
    first = drift(counts, reference).where(F.col("window_start") == F.lit(dt.datetime(2023, 1, 2))).first()
    assert first["drift"] == pytest.approx(0.0)
    other = drift(counts, reference).where(F.col("window_start") == F.lit(dt.datetime(2023, 1, 3))).first()
    assert other["drift"] == pytest.approx(1.0)
