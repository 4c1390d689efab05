"""Schedules of attempts, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import retries


@pytest.mark.parametrize("policy, outcomes, want", [
    (retries.QUERY, ["ok"], (1, 0.0, "ok")), (retries.QUERY, ["transient", "ok"], (2, 3.0, "ok")), (retries.QUERY, ["transient", "transient", "ok"], (2, 3.0, "transient")),
    (retries.QUERY, ["rate_limited", "ok"], (1, 0.0, "rate_limited")), (retries.INGESTION, ["rate_limited"] * 3 + ["transient", "ok"], (5, 80.0, "ok")),
    (retries.INGESTION, ["rate_limited"] * 5, (4, 75.0, "rate_limited")), (retries.CLASSIFY, ["transient"] * 5, (5, 2.0 + 4 + 8 + 16, "transient")), (retries.CLASSIFY, ["rate_limited", "ok"], (2, 60.0, "ok")),
    (retries.QUERY, ["transient"], (1, 3.0, "pending")), (retries.QUERY, [], (0, 0.0, "pending")), (retries.QUERY, [None, "ok"], (1, 0.0, "failed")),
])
def test_schedules(spark, policy, outcomes, want):
    row = spark.createDataFrame([(outcomes,)], "o array<string>").select(retries.schedule(F.col("o"), policy).alias("s")).first().s
    assert tuple(row) == want
