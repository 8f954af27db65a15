"""Generic API paths: custom rules, other source formats, rate cards."""

import os

import pytest
from pyspark.sql import functions as F

from cohortlens import (
    Audit, AuditParams, Segment, WAREHOUSE_COLUMNS, appointment_view, exposure_summary, prepare,
    read_events, reconcile, segment,
)
from cohortlens.plans.audit import SPEC_BY_NAME

SF = "/root/testdata/sf0.001"


def test_custom_rules_sql_and_column_forms_agree(spark):
    base = prepare(appointment_view(spark, SF))
    text = {"lead_band": Segment.of([("lead_time = 0", "same day"), ("lead_time < 7", "week"),
                                     ("lead_time < 30", "month")], "later")}
    cols = {"lead_band": Segment.of([(F.col("lead_time") == 0, "same day"), (F.col("lead_time") < 7, "week"),
                                     (F.col("lead_time") < 30, "month")], "later")}
    a = segment(base, text).groupBy("lead_band").count().orderBy("lead_band").collect()
    b = segment(base, cols).groupBy("lead_band").count().orderBy("lead_band").collect()
    assert a == b and {r.lead_band for r in a} == {"same day", "week", "month", "later"}
    assert sum(r["count"] for r in a) == base.count()


@pytest.mark.parametrize("fmt", ["orc", "json"])
def test_other_source_formats(spark, tmpdir_path, fmt):
    events = appointment_view(spark, SF)
    path = f"{tmpdir_path}/events.{fmt}"
    events.write.format(fmt).save(path)
    back = read_events(spark, path, fmt, schema=events.schema)
    spec = SPEC_BY_NAME["wall_by_payer"]
    assert Audit(back).grouped(spec).collect() == Audit(events).grouped(spec).collect()


def test_json_needs_a_schema(spark, tmpdir_path):
    with pytest.raises(ValueError, match="schema"):
        read_events(spark, tmpdir_path, "json")


def test_rate_card_table_and_custom_card(spark):
    card = spark.createDataFrame([(1, 100), (0, 50)], "payer INT, rate INT")
    base = Audit(appointment_view(spark, SF)).base("production")
    exp = exposure_summary(base, rate_card=(card, "payer", "rate")).collect()
    pairs = exposure_summary(base, rate_card=((1, 100), (0, 50))).collect()
    assert exp == pairs
    assert all(r.modeled_revenue_impact == r.total_patient_volume * {1: 100, 0: 50}[r.Scholarship] for r in exp)
    only = spark.createDataFrame([(1, 100), (None, 5), (None, 6)], "payer INT, rate INT")
    rest = exposure_summary(base, params=AuditParams(default_rate=7), rate_card=(only, "payer", "rate")).collect()
    assert all(r.modeled_revenue_impact == r.total_patient_volume * {1: 100, 0: 7}[r.Scholarship] for r in rest)
    dup = spark.createDataFrame([(1, 100), (1, 90)], "payer INT, rate INT")
    with pytest.raises(Exception, match="duplicate key"):
        exposure_summary(base, rate_card=(dup, "payer", "rate")).collect()


def test_csv_by_name_and_cast_report(spark, tmpdir_path):
    from pyspark.sql import types as T

    from cohortlens.sources import csv_cast_report, read_csv_text
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("age", T.IntegerType()), T.StructField("name", T.StringType())])
    os.makedirs(f"{tmpdir_path}/csv")
    with open(f"{tmpdir_path}/csv/a.csv", "w") as f:
        f.write("name,extra,age,id\nx,1,41,7\ny,2,abc,8\nz,3,,9.5e\n")
    got = read_events(spark, f"{tmpdir_path}/csv", "csv", schema).collect()
    assert [tuple(r) for r in got] == [(7, 41, "x"), (8, None, "y"), (None, None, "z")]
    report = {r["name"]: (r["rows"], r["nulls"], r["cast_failures"]) for r in
              csv_cast_report(read_csv_text(spark, f"{tmpdir_path}/csv", schema), schema).collect()}
    assert report == {"id": (3, 0, 1), "age": (3, 1, 1), "name": (3, 0, 0)}
    with pytest.raises(ValueError, match="lacks"):
        read_events(spark, f"{tmpdir_path}/csv", "csv", schema.add("gone", "string"))


def test_unmapped_attributes_are_refused_early(spark):
    events = appointment_view(spark, SF)
    with pytest.raises(ValueError, match="does not list"):
        Audit(events, WAREHOUSE_COLUMNS.with_(attributes=("Gender", "Age"))).run("baseline_volume")
    with pytest.raises(ValueError, match="not in the input"):
        prepare(events, WAREHOUSE_COLUMNS.with_(attributes=("Gender", "Absent")))


def test_duplicate_checkpoint_labels_in_a_table_fail(spark):
    expected = spark.createDataFrame([("a", 1.0, 0.0), ("a", 2.0, 0.0)], "label string, expected double, tol double")
    actuals = spark.createDataFrame([("a", 1.0)], "label string, actual double")
    with pytest.raises(Exception, match="duplicate checkpoint label"):
        reconcile(actuals, expected).collect()


RENAMES = {"PatientId": "member_id", "AppointmentID": "visit_id", "Gender": "sex", "ScheduledDay": "booked_on",
           "AppointmentDay": "due_on", "Age": "age_years", "Scholarship": "plan", "Hipertension": "htn",
           "Diabetes": "dm", "Alcoholism": "aud", "Handcap": "mobility", "SMS_received": "reminded",
           "No-show": "missed"}


def test_another_datasets_column_names_give_the_same_audits(spark):
    from cohortlens import ColumnMap
    from cohortlens.plans.audit import CUBE_SERVED, cube_audit
    view = appointment_view(spark, SF)
    renamed = view.withColumnsRenamed(RENAMES)
    cmap = ColumnMap(key="visit_id", entity="member_id", booked_at="booked_on", due_at="due_on",
                     outcome="missed", attributes=("sex", "age_years", "plan", "htn", "dm", "aud",
                                                   "mobility", "reminded"))
    params = AuditParams(payer="plan", gender="sex", age="age_years", level="mobility", sms="reminded",
                         conditions=("htn", "dm", "aud"))
    ours, ref = Audit(renamed, cmap, params), Audit(view)
    cube = ours.cube()
    for name in list(CUBE_SERVED) + ["integrity", "scorecard"]:
        want = [tuple(r) for r in ref.run(name).collect()]
        assert [tuple(r) for r in ours.run(name).collect()] == want, name
        if name in CUBE_SERVED and name != "wall_contrast":
            assert [tuple(r) for r in cube_audit(cube, name).collect()] == want, name
    assert sorted(map(tuple, ours.full_audit().collect())) == sorted(map(tuple, ref.full_audit().collect()))


def test_missing_columns_are_named(spark):
    view = appointment_view(spark, SF).drop("Handcap")
    with pytest.raises(ValueError, match="Handcap"):
        Audit(view).run("baseline_volume")


def test_one_key_pass_serves_integrity_duplicates_and_scorecard(spark):
    from pyspark.sql import functions as F

    events = appointment_view(spark, SF)
    odd = events.union(events.where("AppointmentID % 10 = 0")).union(
        events.where("AppointmentID % 50 = 1").withColumn("AppointmentID", F.lit(None).cast("long")))
    for df in (events, odd, events.where("false")):
        audit = Audit(df)
        keys = audit.key_pass()
        assert keys.integrity().collect() == audit.integrity().collect()
        assert sorted(keys.duplicates().collect()) == sorted(audit.duplicates().collect())
        assert audit.scorecard(cube=audit.cube(), keys=keys).collect() == audit.scorecard().collect()
