"""k-means++ seeding over all values of large and small labels."""

import numpy as np
from pyspark.sql import functions as F

from weftlog.operators import binning


def test_seeding_sees_all_values_of_large_labels(spark):
    n = 120_000
    day = F.when(F.col("id") % 1000 == 0, 90.0).otherwise((F.col("id") % 4).cast("double"))
    large = spark.range(n).select(F.lit("large").alias("label"), day.alias("value"), "id")
    small = spark.createDataFrame([("one", 5.0, 1), ("same", 2.0, 1), ("same", 2.0, 2), ("same", 2.0, 3), ("same", 2.0, 4), ("two", 1.0, 7), ("two", 8.0, 3), ("null", None, 1)], "label string, value double, id long")
    rows = large.unionByName(small)
    ids = np.arange(n)
    by_id = {"large": np.where(ids % 1000 == 0, 90.0, ids % 4), "one": [5.0], "same": [2.0] * 4, "two": [8.0, 1.0]}
    for order, values in (("id", by_id), (None, {a: np.sort(v) for a, v in by_id.items()})):
        for seed in (7,):
            got = {r["label"]: (r["edges"], r["num_bins"]) for r in binning.fit_kmeans_seeds(rows, 3, seed, order=order).collect()}
            wanted = {a: binning.greedy_centres(np.array(v, dtype=float), 3, seed).tolist() for a, v in values.items()}
            assert got == {a: (c, len(c)) for a, c in wanted.items()}
