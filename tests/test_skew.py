"""A key or cohort holding a third of all rows: exact results, map-side collapse in the plan."""

from pyspark.sql import functions as F

from cohortlens import Audit, appointment_view, duplicate_keys, integrity_check
from cohortlens.plans.audit import FULL_AUDIT_SPECS, cube_audit
from tests.conftest import SF01


def hot(spark):
    v = appointment_view(spark, SF01)
    # every third appointment collapses onto key 0 and onto one patient / one cohort
    third = F.col("AppointmentID") % 3 == 0
    return v.withColumns({
        "AppointmentID": F.when(third, F.lit(0)).otherwise(F.col("AppointmentID")),
        "PatientId": F.when(third, F.lit(42)).otherwise(F.col("PatientId")),
        "Gender": F.when(third, F.lit("M")).otherwise(F.col("Gender")),
    })


def test_hot_key_integrity(spark):
    r = integrity_check(hot(spark), "AppointmentID").first()
    assert (r.total_records, r.distinct_keys, r.duplicated_keys, r.duplicate_records) == (15000, 10001, 1, 4999)
    d = duplicate_keys(hot(spark), "AppointmentID").collect()
    assert [(x.AppointmentID, x.occurrences) for x in d] == [(0, 5000)]


def test_hot_key_is_collapsed_before_the_shuffle(spark):
    p = integrity_check(hot(spark), "AppointmentID")._jdf.queryExecution().executedPlan().toString()
    # printed top-down: the key exchange sits directly above the map-side partial count per key
    exchange = p.index("Exchange hashpartitioning(AppointmentID")
    partial = p.index("HashAggregate(keys=[AppointmentID", exchange)
    assert "partial_count(1)" in p[partial:partial + 200]


def test_hot_cohort_cube_equals_direct(spark):
    a = Audit(hot(spark))
    cube = a.cube()
    for name in ("gender_payer", "wall_by_payer_prod", "exposure_summary", "lead_day_curve"):
        assert cube_audit(cube, name).collect() == a.run(name).collect()
    total = sum(r.total_patient_volume for r in cube.full_audit(FULL_AUDIT_SPECS).collect()
                if r.audit == "lead_by_outcome")
    assert total == a.scope_report().first().valid_lead_rows
