"""Draws of the moving-block bootstrap stay in the tasks, however many they are."""

import numpy as np
from pyspark.sql import functions as F

from strandline.operators import stats


def test_draws_are_not_sent_by_the_driver(spark):
    rows = spark.range(6000).select((F.col("id") % 2).alias("k"), F.expr("id div 2").alias("i"), F.sin("id").alias("v"))
    plans = {}
    for most in ("16k", "10m"):  # block sums are too many to be sent, or few enough
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            out = stats.moving_block_ci(rows, ["k"], "v", "i", 2, 40)
            found = {r["k"]: r for r in out.collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        plans[most] = [line for line in plan.splitlines() if "Join [_g" in line and "_s#" in line]
        assert plans[most] and not any("BuildLeft" in line for line in plans[most])
        for k in (0, 1):
            v = np.sin(np.arange(k, 6000, 2))
            assert found[k]["n"] == 3000 and abs(found[k]["mean"] - v.mean()) < 1e-12 and found[k]["ci_low"] < v.mean() < found[k]["ci_high"]
    assert any("BuildRight" in line for line in plans["10m"]) and not any("Broadcast" in line for line in plans["16k"])
