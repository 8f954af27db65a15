"""Events stored by lead day: the same audits, and a window of days reads only its files."""

import pytest
from pyspark.sql import functions as F

from cohortlens import Audit, appointment_view
from cohortlens.config import CSV_COLUMNS, WAREHOUSE_COLUMNS
from cohortlens.operators.quality import sample_rows
from cohortlens.sources.fixtures import clinic_view
from cohortlens.sources.layout import LayoutAudit, read_layout, write_layout

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def scanned(spark, df):
    """(files, rows) that the scan of ``df`` read, from its own metrics."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return tuple(leaf.metrics().apply(m).value() for m in ("numFiles", "numOutputRows"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture(scope="module")
def stored(spark):
    import tempfile
    path = tempfile.mkdtemp(prefix="cl-layout-", dir="/tmp") + "/events"
    write_layout(clinic_view(spark, SF), path, CSV_COLUMNS, files=12)
    return path


def test_same_rows_and_audits(spark, stored):
    events = clinic_view(spark, SF)
    assert rows(read_layout(spark, stored)) == rows(events)
    plain, laid = Audit(events, CSV_COLUMNS), LayoutAudit(spark, stored, CSV_COLUMNS)
    for name in ("scope_report", "wall_by_payer", "wall_by_payer_prod", "exposure_summary", "lead_day_curve", "scorecard", "integrity"):
        assert rows(laid.run(name)) == rows(plain.run(name)), name


def test_windows(spark, stored):
    events = Audit(clinic_view(spark, SF), CSV_COLUMNS).base("raw")
    for low, high in ((0, None), (None, -1), (-2, 5), (10, 19), (13, 31), (200, None), (5, 2)):
        want = events.where(" AND ".join(["lead_time IS NOT NULL"] + [f"lead_time >= {low}"] * (low is not None) + [f"lead_time <= {high}"] * (high is not None)))
        assert sorted(r[0] for r in read_layout(spark, stored, low, high).select("AppointmentID").collect()) == \
            sorted(r[0] for r in want.select("AppointmentID").collect()), (low, high)


def test_fewer_files_and_rows_are_read(spark, stored):
    every = scanned(spark, read_layout(spark, stored))
    window = scanned(spark, read_layout(spark, stored, 20, 29))
    assert window[0] <= every[0] / 4 and 0 < window[1] <= every[1] / 8
    valid = LayoutAudit(spark, stored, CSV_COLUMNS).base("valid")
    assert scanned(spark, valid)[0] < every[0]
    plan = read_layout(spark, stored, 13, 31)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stored_lead_part" in plan and "GreaterThanOrEqual(stored_lead_day,13)" in plan


def test_a_hot_day_spreads_over_files(spark, tmpdir_path):
    events = appointment_view(spark, SF).withColumn("AppointmentDay", F.col("ScheduledDay"))
    path = f"{tmpdir_path}/events"
    write_layout(events, path, WAREHOUSE_COLUMNS, files=6)
    assert len(read_layout(spark, path, 0, 0).inputFiles()) >= 4


def test_refusals(spark, stored, tmpdir_path):
    with pytest.raises(FileNotFoundError):
        read_layout(spark, tmpdir_path)
    with pytest.raises(ValueError, match="lead day comes from"):
        LayoutAudit(spark, stored, CSV_COLUMNS.with_(due_at="Age"))
    with pytest.raises(ValueError, match="already"):
        write_layout(clinic_view(spark, SF).withColumn("stored_lead_day", F.lit(1)), f"{tmpdir_path}/x", CSV_COLUMNS)


def test_seeded_sample(spark):
    events = clinic_view(spark, SF)
    first = rows(sample_rows(events, 20, "AppointmentID", 1))
    assert len(first) == 20 and first == rows(sample_rows(events.repartition(7), 20, "AppointmentID", 1))
    assert first != rows(sample_rows(events, 20, "AppointmentID", 2))
    assert set(first) <= set(rows(events))
    assert sample_rows(events, 10**6, "AppointmentID").count() == events.count() and sample_rows(events.limit(0), 3, "Age").count() == 0
