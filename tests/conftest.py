"""One small Spark session for all tests."""

import datetime as dt
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from weftlog.functions.shipping import ship

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.adaptive.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftlog-test-"))
    ship(session)
    return session


def day(n):
    return dt.datetime(2023, 1, 1) + dt.timedelta(days=n)


LIFECYCLE_SCHEMA = "event_ord long, `case:concept:name` string, `concept:name` string, `lifecycle:transition` string, `time:timestamp` timestamp_ntz, `concept:instance` string"


@pytest.fixture(scope="session")
def lifecycle_log(spark):
    """Two cases with overlapping activities."""
    # The public fixture's activities, transitions, days and instances.
    activities_1 = ["a", "b", "a", "c", "c", "b", "d"]
    transitions_1 = ["start", "start", "complete", "start", "complete", "complete", "complete"]
    days_1 = [1, 2, 3, 4, 5, 6, 7]
    instances_1 = ["i1_1", "i1_2", "i1_1", "i1_3", "i1_3", "i1_2", "i1_4"]
    activities_2 = ["a", "b", "a", "b", "a", "a"]
    transitions_2 = ["start", "start", "start", "complete", "complete", "complete"]
    days_2 = [7, 8, 9, 10, 11, 12]
    instances_2 = ["i2_1", "i2_2", "i2_3", "i2_2", "i2_3", "i2_1"]
    rows = [("case1", a, k, day(n), i) for a, k, n, i in zip(activities_1, transitions_1, days_1, instances_1)]
    rows += [("case2", a, k, day(n), i) for a, k, n, i in zip(activities_2, transitions_2, days_2, instances_2)]
    return spark.createDataFrame([(o, *r) for o, r in enumerate(rows, 1)], LIFECYCLE_SCHEMA)
