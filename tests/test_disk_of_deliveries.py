"""Tests on deliveries leave no shuffle files of the large tables behind and shuffle traces once."""

from pathlib import Path

import pytest
from test_delivery_traces import folder  # noqa: F401

from weftlog.functions.checkpoints import stored
from weftlog.operators import compare
from weftlog.operators.language import paired_population
from weftlog.plans import core_queries

WEIGHTED = {"F9": "weighted:3", "F5": "weighted", "F6": "weighted", "F7": "weighted"}
# One line for each finding of the round.
FOUND = {
    "F9": "permutation_test_timed",
    "F5": "permutation_test_numeric",
    "F6": "classic_bootstrap_timed",
    "F7": "double_bootstrap_timed",
}


@pytest.fixture(scope="module")
def lone(spark, folder, tmp_path_factory):  # noqa: F811
    """The same with a log whose pair lacks the other side, and an order that is there twice."""
    at = tmp_path_factory.mktemp("lone")
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        more = rows.where(f"{key} = 2").withColumn(key, (rows[key] + 198).cast("long"))
        more = more.replace(2, 8, subset=["o_custkey"]).unionByName(rows.where(f"{key} = 7")) if name == "orders" else more
        rows.unionByName(more).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f.name for d in dirs for f in Path(d).rglob("shuffle_*")}


@pytest.fixture
def adaptive(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "false")


def test_shuffle_files_go_when_a_table_is_stored(spark, adaptive):
    setting, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffle_files(spark)
    was = spark.conf.get(setting, None)
    df = spark.range(999).repartition(3).selectExpr("id % 7 as k").groupBy("k").count()
    rows = stored(df)
    assert not shuffle_files(spark) - before
    assert rows.count() == 7 and spark.conf.get(setting, None) == was
    assert df.count() == 7


@pytest.mark.parametrize(("name", "cost"), [(FOUND[f], WEIGHTED[f]) for f in FOUND], ids=FOUND)
def test_traces_are_shuffled_once(spark, adaptive, lone, monkeypatch, name, cost):
    value = "quantity" if "numeric" in name else "duration"
    traces = core_queries.binned_delivery_traces(spark, lone, value) if name.startswith("permutation") else core_queries.timed_traces(spark, lone)
    pop, n, seed = paired_population(traces), core_queries.TIMED_REPLICATES, core_queries.SEED
    expected = compare.run_double_test(pop, "smaller", cost, n, seed) if name.startswith("double") else compare.run_test(pop, name.partition("_")[0], cost, n, seed)[1]
    expected = sorted(core_queries._rounded(expected).collect())
    assert expected and 4 not in [r["pair_id"] for r in expected]

    def shuffles(*_):
        raise AssertionError("traces were shuffled to find pairs that lack a side")

    monkeypatch.setattr(core_queries, "paired_population", shuffles)
    monkeypatch.setattr(compare, "both_sides", shuffles, raising=False)
    assert sorted(core_queries.QUERIES[name](spark, lone).collect()) == expected
