"""Binned delivery traces come from rows that are joined and stored once."""

import datetime as dt

import pytest

from weftlog.functions.columns import ACTIVITY, START, TIME, col
from weftlog.operators import binning, extract, prepare
from weftlog.plans import core_queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("deliveries")
    day = dt.datetime(2001, 1, 1)
    orders = [(k, k % 4 if k else None, day + dt.timedelta(days=k)) for k in range(12)] + [(3, 1, day), (99, 2, day)]
    lines = [(k % 12, j, "RAN"[(k + j) % 3], "OF"[k % 2], day + dt.timedelta(days=(7 * k + j) % 31) if (k + j) % 5 else None, float(j * k % 9)) for k in range(14) for j in range(k % 4 + 1)] + [(5, 1, "R", "O", None, 1.0), (77, 1, "R", "O", day, 1.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz, l_quantity double").write.parquet(f"{at}/lineitem.parquet")
    return str(at)


# One line for each finding: what its query bins, and how.
FOUND = {
    "F3": ("duration", lambda v: binning.fit_kmeans_seeds(v, 3, 42)),
    "F5": ("quantity", binning.fit_iqr),
    "F9": ("duration", binning.fit_iqr),
}


@pytest.mark.parametrize(("value", "fit"), FOUND.values(), ids=FOUND)
def test_large_tables_are_joined_once(spark, folder, value, fit):
    found = core_queries.binned_delivery_traces(spark, folder, value, fit)
    assert not [f for f in found.inputFiles() if "lineitem.parquet" in f or "orders.parquet" in f]
    log = core_queries.deliveries(spark, folder)
    log = log.withColumn("_number", prepare.seconds_between(log, START, TIME) if value == "duration" else col(value).cast("double"))
    model = fit(log.select(col(ACTIVITY).alias("label"), col("_number").alias("value")))
    expected = core_queries._with_log(extract.extract_binned_traces(log, "_number", model), spark, folder)
    rows = [sorted(((r["case_id"], r["trace"], r["log_number"]) for r in df.collect()), key=str) for df in (found, expected)]
    assert rows[0] == rows[1] and len(rows[0]) > 9
    assert found.schema["trace"].dataType.simpleString() == expected.schema["trace"].dataType.simpleString()


# One line for each finding: queries on the default bins.
TIMED = {"F6": "classic_bootstrap_timed", "F7": "double_bootstrap_timed"}


@pytest.mark.parametrize("name", TIMED.values(), ids=TIMED)
def test_large_tables_are_not_read_by_tests(spark, folder, name):
    found = core_queries.QUERIES[name](spark, folder)
    assert found.inputFiles() and not [f for f in found.inputFiles() if "lineitem.parquet" in f or "orders.parquet" in f]
