"""Registered tests that stand for a public default judge as many replicates as it has."""

import pyarrow as pa
import pyarrow.parquet as pq

from weftlog.plans import core_queries


def test_timed_default_judges_the_default_number_of_replicates(spark, tmp_path):
    keys, lines = range(12), [(o, k) for o in range(12) for k in range(2)]
    day = 86_400_000_000
    pq.write_table(pa.table({"o_orderkey": [*keys], "o_custkey": [o % 4 for o in keys], "o_orderdate": pa.array([o * day for o in keys], pa.timestamp("us"))}), tmp_path / "orders.parquet")
    columns = {
        "l_orderkey": [o for o, _ in lines],
        "l_linenumber": [k for _, k in lines],
        "l_returnflag": ["ANR"[o % 3] for o, _ in lines],
        "l_linestatus": ["OF"[k] for _, k in lines],
        "l_shipdate": pa.array([(o + o * k + 1) * day for o, k in lines], pa.timestamp("us")),
        "l_quantity": [float(o) for o, _ in lines],
    }
    pq.write_table(pa.table(columns), tmp_path / "lineitem.parquet")
    found = core_queries.QUERIES["permutation_test_timed_default"](spark, str(tmp_path)).collect()
    assert [r["n_replicates"] for r in found] == [10_000] * 2
