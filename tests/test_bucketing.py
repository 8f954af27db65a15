"""Events stored bucketed by their key: the integrity check runs without a shuffle."""

from cohortlens import appointment_view, integrity_check
from cohortlens.sinks import save_table
from tests.conftest import SF01


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_events_need_no_key_shuffle(spark):
    events = appointment_view(spark, SF01)
    save_table(events, "events_by_key", bucket_by=["AppointmentID"], buckets=8)
    table = spark.table("events_by_key")
    bucketed = integrity_check(table, "AppointmentID")
    assert "Exchange hashpartitioning(AppointmentID" not in _plan(bucketed)
    assert "Exchange hashpartitioning(AppointmentID" in _plan(integrity_check(events, "AppointmentID"))
    assert bucketed.collect() == integrity_check(events, "AppointmentID").collect()
