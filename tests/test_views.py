"""Spark SQL over the registered audit views gives the DataFrame audits' rows."""

from cohortlens import Audit, appointment_view
from cohortlens.plans import register_audit_views
from tests.conftest import SF01


def test_sql_over_views(spark):
    events = appointment_view(spark, SF01)
    names = register_audit_views(spark, events)
    a = Audit(events)
    combos = spark.sql(f"""
        SELECT has_diabetes, has_hypertension, has_alcoholism,
               round(avg(lead_time), 1) AS avg_lead_time_no_show, count(*) AS total_no_shows
        FROM {names['enriched']} WHERE missed_appointment = 1
        GROUP BY has_diabetes, has_hypertension, has_alcoholism""")
    assert sorted(combos.collect()) == sorted(a.run("condition_combinations").collect())
    rate = spark.sql(f"""
        SELECT sms_received, round(avg(CAST(missed_appointment AS DOUBLE)) * 100, 1) AS no_show_rate,
               count(*) AS total_appointments
        FROM {names['enriched']} GROUP BY sms_received""")
    assert sorted(rate.collect()) == sorted(a.run("reminder_rate").collect())
    seg = spark.sql(f"SELECT count(*) AS n FROM {names['segmented']}").first().n
    assert seg == a.scope_report().first().production_rows
    raw = spark.sql(f"SELECT count(*) AS n FROM {names['raw']}").first().n
    assert raw == 15000


def test_sql_ordinals_over_views(spark):
    events = appointment_view(spark, SF01)
    names = register_audit_views(spark, events, names={"segmented": "seg_p_ordinals"})
    by_ordinal = spark.sql(f"""
        SELECT Scholarship, trust_wall_status, no_show_status, count(*) AS total_patient_volume,
               round(avg(lead_time), 1) AS avg_lead_time
        FROM {names['segmented']} GROUP BY 1, 2, 3 ORDER BY 1, 2, 3""")
    assert by_ordinal.collect() == Audit(events).run("wall_by_payer_prod").collect()
