"""Distinct counts by bitmaps give the same figures as grouping by the key, and move far fewer bytes."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlens import Audit, appointment_view
from cohortlens.operators.bitmaps import (
    BitmapPass, bitmap_integrity, count_bitmaps, dense_integer_key, distinct_bitmaps, merge_bitmaps,
)
from cohortlens.operators.quality import KeyPass, duplicate_keys, integrity_check
from cohortlens.sources.fixtures import clinic_view, line_keys, shipment_view

SF = "/root/testdata/sf0.001"


def check(df, key):
    want = integrity_check(df, key).first().asDict()
    assert BitmapPass(df, key).integrity().first().asDict() == want
    lazy = bitmap_integrity(df, key).first().asDict()
    assert lazy == {k: v for k, v in want.items() if k != "duplicated_keys"}
    twice = sorted(map(tuple, duplicate_keys(df, key).collect()))
    assert sorted(map(tuple, BitmapPass(df, key).duplicates().collect())) == twice
    return want


@pytest.mark.parametrize("view, key", [(appointment_view, "AppointmentID"), (appointment_view, "PatientId"), (shipment_view, "AppointmentID"),
                                       (line_keys, ["l_orderkey", "l_linenumber"]), (clinic_view, ["PatientId", "Age"])])
def test_fixtures(spark, view, key):
    check(view(spark, SF), key)


def test_negative_hot_and_null_keys(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 0, -1, 1, 32768, 32769, -32768, -32769, 2**62, -2**62, 7, 7, 7, 7]), rnd.choice([None, 1, 2])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k long, j int")
    assert check(df, "k")["distinct_keys"] == 10
    check(df, ["k", "j"])
    check(df, ["j", "k"])
    check(df.limit(0), "k")
    unique = spark.range(-5000, 5000).withColumnRenamed("id", "k")
    assert check(unique, "k")["is_unique"]


def test_no_second_scan_without_duplicates(spark):
    once = BitmapPass(appointment_view(spark, SF), "AppointmentID")
    assert once.repeated_buckets == 0
    assert "FileScan" not in once.integrity()._jdf.queryExecution().executedPlan().toString()


def test_more_repeated_buckets_than_are_broadcast(spark, monkeypatch):
    import cohortlens.operators.bitmaps as B
    monkeypatch.setattr(B, "BROADCAST_BUCKETS", 0)
    df = line_keys(spark, SF)
    got = BitmapPass(df, ["l_orderkey", "l_linenumber"]).duplicates()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, duplicate_keys(df, ["l_orderkey", "l_linenumber"]).collect()))


def test_only_dense_integer_keys_use_bitmaps(spark):
    assert dense_integer_key(spark.range(100_000), "id")
    sparse = spark.range(1000).select((F.col("id") * 10**9).alias("k"), F.col("id").cast("string").alias("t"))
    assert not dense_integer_key(sparse, "k") and not dense_integer_key(sparse, "t") and not dense_integer_key(sparse.limit(0), "k")
    with pytest.raises(ValueError, match="integer key"):
        bitmap_integrity(sparse, "t")
    text = appointment_view(spark, SF).withColumn("AppointmentID", F.col("AppointmentID").cast("string"))
    assert isinstance(Audit(text).key_pass(), KeyPass)
    assert isinstance(Audit(appointment_view(spark, SF)).key_pass(), BitmapPass)


def test_bitmaps_merge_over_days(spark):
    df = appointment_view(spark, SF)
    days = [distinct_bitmaps(df.where(F.dayofweek("ScheduledDay") == d), ["Gender", "Scholarship"], "PatientId") for d in range(1, 8)]
    got = count_bitmaps(merge_bitmaps(days, ["Gender", "Scholarship"]), ["Gender"])
    want = df.groupBy("Gender").agg(F.countDistinct("PatientId").alias("distinct_keys"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
