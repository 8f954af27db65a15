import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators.ordering import with_position


@pytest.fixture()
def many_partitions(spark):
    """Adaptive execution would join partitions as small as these."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def test_positions_with_many_partitions(spark, many_partitions):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, *range(40)]), rnd.random()) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, k int, x double").repartition(13)
    out = with_position(df, ["k", F.desc("x"), "id"])
    assert out.rdd.getNumPartitions() > 1
    got = out.collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, -r[2], r[0]))
    assert [(r["position"], r["id"]) for r in got] == [(n, r[0]) for n, r in enumerate(want, 1)]


def test_hot_key_and_clashing_names(spark, many_partitions):
    """A third of the rows under one key spread over partitions by the later order columns."""
    rows = [(1 if i % 3 else i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "_before long, n long")
    out = with_position(df, ["_before", "n"], "place")
    assert out.columns == ["place", "_before", "n"]
    sizes = [r["c"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("c")).collect()]
    assert max(sizes) < 1500
    assert [(r["place"], r["n"]) for r in out.orderBy("place").collect()] == [(n, r[1]) for n, r in enumerate(sorted(rows), 1)]


def test_empty(spark):
    assert with_position(spark.createDataFrame([], "k int"), ["k"]).collect() == []
