"""Semantic traps T1-T15 and the hand-built edge rows of fixture F4."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DateType, IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)

from cohortlens import (
    AuditParams, Audit, CSV_COLUMNS, WAREHOUSE_COLUMNS, cohort_summary, exposure_summary, integrity_check,
    outcome_report, prepare, rate_by, rate_curve, reconcile, scorecard_summary, segment, threshold_contrast,
    validate_rate_card,
)
from cohortlens.operators.cohorts import cohort_metric

SCHEMA = StructType([
    StructField("PatientId", LongType()), StructField("AppointmentID", LongType()),
    StructField("Gender", StringType()), StructField("ScheduledDay", DateType()),
    StructField("AppointmentDay", DateType()), StructField("Age", IntegerType()),
    StructField("Scholarship", IntegerType()), StructField("Hipertension", IntegerType()),
    StructField("Diabetes", IntegerType()), StructField("Alcoholism", IntegerType()),
    StructField("Handcap", IntegerType()), StructField("SMS_received", IntegerType()),
    StructField("No-show", BooleanType()),
])
D0 = dt.date(2016, 4, 1)


def row(i, lead=0, miss=False, pid=1, gender="F", age=30, sch=0, h=0, d=0, a=0, hc=0, sms=0):
    due = None if lead is None else D0 + dt.timedelta(days=lead)
    return (pid, i, gender, D0, due, age, sch, h, d, a, hc, sms, miss)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_t1_utc_midnight_gives_lead_zero(spark):
    schema = StructType([StructField("AppointmentID", LongType()), StructField("ScheduledDay", StringType()),
                         StructField("AppointmentDay", StringType()), StructField("No-show", StringType())])
    df = spark.createDataFrame([(1, "2016-04-29T18:38:08Z", "2016-04-29T00:00:00Z", "No")], schema)
    cmap = CSV_COLUMNS.with_(entity=None, attributes=())
    assert prepare(df, cmap, "raw").first().lead_time == 0


def test_t1_non_utc_session_is_refused_for_zoned_timestamps(spark):
    schema = StructType([StructField("AppointmentID", LongType()), StructField("ScheduledDay", TimestampType()),
                         StructField("AppointmentDay", TimestampType()), StructField("No-show", BooleanType())])
    df = spark.createDataFrame([(1, dt.datetime(2016, 4, 29, 18, 38), dt.datetime(2016, 4, 29), False)], schema)
    cmap = WAREHOUSE_COLUMNS.with_(entity=None, attributes=())
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        with pytest.raises(ValueError, match="time zone"):
            prepare(df, cmap, "raw")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert prepare(df, cmap, "raw").first().lead_time == 0


def test_t1_non_utc_session_is_refused_for_iso_text(spark):
    schema = StructType([StructField("AppointmentID", LongType()), StructField("ScheduledDay", StringType()),
                         StructField("AppointmentDay", StringType()), StructField("No-show", StringType())])
    df = spark.createDataFrame([(1, "2016-04-29T18:38:08Z", "2016-04-29T00:00:00Z", "No")], schema)
    cmap = CSV_COLUMNS.with_(entity=None, attributes=())
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        with pytest.raises(ValueError, match="time zone"):
            prepare(df, cmap, "raw")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_t2_rounding_tie_half_up(spark):
    df = prepare(frame(spark, [row(1, 1), row(2, 2), row(3, 3), row(4, 3)]))
    assert cohort_summary(df, ["Gender"]).first().avg_lead_time == 2.3  # 9 / 4 = 2.25


def test_t3_double_not_decimal_rate(spark):
    rows = [row(i, 1, miss=i < 169) for i in range(1186)]
    r = rate_by(prepare(frame(spark, rows)), ["SMS_received"]).first()
    assert r.no_show_rate == 14.2 and r.total_appointments == 1186


def test_t5_null_group_key_is_its_own_cohort(spark):
    df = prepare(frame(spark, [row(1, 2, gender=None), row(2, 4, gender="M")]))
    got = {r.Gender: r.total_patient_volume for r in cohort_summary(df, ["Gender"]).collect()}
    assert got == {None: 1, "M": 1}


def test_t6_null_and_unmapped_outcome(spark):
    schema = StructType([StructField("AppointmentID", LongType()), StructField("ScheduledDay", DateType()),
                         StructField("AppointmentDay", DateType()), StructField("No-show", StringType())])
    rows = [(1, D0, D0, "Yes"), (2, D0, D0, "No"), (3, D0, D0, None), (4, D0, D0, "maybe")]
    df = spark.createDataFrame(rows, schema)
    cmap = CSV_COLUMNS.with_(entity=None, attributes=())
    rep = outcome_report(df, cmap).first()
    assert (rep.rows, rep.null_outcomes, rep.unmapped_outcomes) == (4, 1, 1)
    c = rate_curve(prepare(df, cmap)).first()
    assert (c.total_appointments, c.total_noshows, c.total_shows) == (4, 1, 1)
    assert c.noshowrate_pct == 25.0


def test_t7_nulls_fall_to_else(spark):
    rows = [row(1, 1, age=None, hc=None, sch=None), row(2, 1, age=-3)]
    seg = segment(prepare(frame(spark, rows)))
    got = {r.AppointmentID: r for r in seg.collect()}
    assert got[1].advocacy_type == "Self-Advocate (Adult)" and got[1].is_disabled == 0
    assert got[2].advocacy_type == "Guardian-Advocate (Minor)"  # no lower bound on age
    exp = exposure_summary(segment(prepare(frame(spark, rows), scope="production")))
    impact = {r.Scholarship: r.modeled_revenue_impact for r in exp.collect()}
    assert impact[None] == 210


def test_t9_t10_empty_cohort_null_metric_and_failed_check(spark):
    df = prepare(frame(spark, [row(1, 3)]))
    m = cohort_metric(df, "Gender = 'X'").first()
    assert m.cohort_total == 0 and m.cohort_rate is None
    actual = df.agg(F.avg(F.when(F.col("Gender") == "X", F.col("lead_time"))).alias("actual")) \
        .select(F.lit("empty").alias("label"), "actual")
    chk = reconcile(actual, [("empty", 1.0, 10.0), ("absent", 1.0, 1.0)]).collect()
    assert [c.ok for c in chk] == [False, False]
    assert scorecard_summary(reconcile(actual, [("empty", 1.0, 10.0)])).first().all_ok is False


def test_duplicate_rate_card_refused():
    with pytest.raises(ValueError, match="duplicate"):
        validate_rate_card([(1, 120), (1, 130)])


def test_t13_unweighted_wall_means(spark):
    # day 1: 1 of 1 missed (100%); day 2: 0 of 3 (0%) -> unweighted 50, weighted 25
    rows = [row(1, 1, miss=True), row(2, 2), row(3, 2), row(4, 2)]
    curve = rate_curve(prepare(frame(spark, rows)), order=False)
    p = AuditParams(pre=(1, 2))
    assert threshold_contrast(curve, p).first().pre_wall_rate == 50.0
    assert threshold_contrast(curve, p, weighted=True).first().pre_wall_rate == 25.0
    # day 0 belongs to neither window
    assert threshold_contrast(curve, AuditParams(pre=(1, 9))).first().post_wall_rate is None


def test_t15_null_keys_reported_apart_from_duplicates(spark):
    df = frame(spark, [row(1), row(1), row(None), row(2)])
    r = integrity_check(df, "AppointmentID").first()
    assert (r.total_records, r.distinct_keys, r.null_key_records, r.duplicated_keys, r.duplicate_records) \
        == (4, 2, 1, 1, 1)
    assert r.is_unique is False


def test_negative_lead_and_null_entity_scopes(spark):
    rows = [row(1, -1), row(2, 0, pid=None), row(3, 5), row(4, None)]
    a = Audit(frame(spark, rows))
    r = a.scope_report().first()
    assert (r.raw_rows, r.valid_lead_rows, r.production_rows, r.negative_lead_rows, r.null_lead_rows) \
        == (4, 2, 1, 1, 1)
    assert a.cube().scope_report().first() == r


def test_csv_source_with_explicit_schema(spark, tmpdir_path):
    from cohortlens.sources import REFERENCE_CSV_SCHEMA, normalise_reference_csv, read_events
    path = f"{tmpdir_path}/appts.csv"
    with open(path, "w") as f:
        f.write("PatientId,AppointmentID,Gender,ScheduledDay,AppointmentDay,Age,Neighbourhood,Scholarship,"
                "Hipertension,Diabetes,Alcoholism,Handcap,SMS_received,No-show\n")
        f.write("29872499824296.0,5642903,F,2016-04-29T18:38:08Z,2016-04-29T00:00:00Z,62,JARDIM,0,1,0,0,0,0,No\n")
        f.write("558997776694438.0,5642503,M,2016-04-27T08:36:51Z,2016-05-09T00:00:00Z,56,JARDIM,0,0,0,0,0,1,Yes\n")
    df = normalise_reference_csv(read_events(spark, path, "csv", REFERENCE_CSV_SCHEMA))
    got = prepare(df, CSV_COLUMNS, "production").orderBy("AppointmentID").collect()
    assert [(r.PatientId, r.lead_time, r.no_show_status) for r in got] == \
        [(558997776694438, 12, True), (29872499824296, 0, False)]


def test_feed_sink_roundtrip(spark, tmpdir_path):
    from cohortlens.sinks import write_feed
    from cohortlens import appointment_view
    exp = Audit(appointment_view(spark, "/root/testdata/sf0.001")).exposure()
    write_feed(exp, f"{tmpdir_path}/feed")
    back = spark.read.parquet(f"{tmpdir_path}/feed")
    assert back.count() == exp.count() and back.columns == exp.columns


def test_t4_order_of_float_operations(spark):
    from cohortlens.functions.measures import pct, share_pct
    r = spark.range(1).select(pct(F.lit(1), F.lit(3)).alias("rate"),
                              share_pct(F.lit(1), F.lit(3)).alias("share")).first()
    assert r.rate == 1 / 3 * 100 and r.share == 100.0 * 1 / 3 and r.rate != r.share


def test_t8_nulls_sort_first_ascending(spark):
    df = prepare(frame(spark, [row(1, 2, gender="M"), row(2, 4, gender=None), row(3, 1, gender="F")]))
    assert [r.Gender for r in cohort_summary(df, ["Gender"]).collect()] == [None, "F", "M"]


def test_t11_impact_for_every_cohort_leak_for_missed_only(spark):
    rows = [row(1, 1, miss=True, sch=1), row(2, 1, miss=False, sch=1), row(3, 1, miss=True, sch=0)]
    a = Audit(frame(spark, rows))
    exp = a.exposure().collect()
    assert all(r.modeled_revenue_impact > 0 for r in exp)
    assert sum(r.modeled_revenue_impact for r in exp) == 120 + 120 + 210
    leak = {r.Scholarship: (r.missed_volume, r.fiscal_leak) for r in a.fiscal_leak().collect()}
    assert leak == {0: (1, 210), 1: (1, 120)}
    assert a.fiscal_leak_total().first().fiscal_leak == 330


def test_t12_count_star_counts_rows_with_null_key(spark):
    df = prepare(frame(spark, [row(None, 1), row(5, 1)]))
    assert cohort_summary(df, ["Gender"]).first().total_patient_volume == 2


def test_t14_output_types(spark):
    a = Audit(frame(spark, [row(1, 1, miss=True), row(2, 12)]))
    types = dict(a.run("lead_day_curve").dtypes)
    assert types == {"lead_time_day": "int", "total_appointments": "bigint", "total_noshows": "bigint",
                     "total_shows": "bigint", "noshowrate_pct": "double", "show_rate_pct": "double"}
    t = dict(a.exposure().dtypes)
    assert t["total_patient_volume"] == "bigint" and t["modeled_revenue_impact"] == "bigint"
    assert t["avg_lead_time"] == "double" and t["pct_of_total_volume"] == "double"


def test_pick_reads_one_cell_or_sums(spark):
    from cohortlens import pick
    a = Audit(frame(spark, [row(1, 1, miss=True, gender="M", sch=1), row(2, 3, miss=True, gender="M", sch=1),
                            row(3, 2, gender="F")]))
    t = a.run("gender_payer")
    one = pick(t, {"Gender": "M", "Scholarship": 1, "no_show_status": True}, "avg_lead_time").first()[0]
    assert one == 2.0
    assert pick(t, {"Gender": "X"}, "avg_lead_time").first()[0] is None
    assert pick(t, "Gender = 'X'", "total_patient_volume", how="sum").first()[0] == 0
    assert a.cohort_volume().first().total_patient_volume == 2


def test_load_profile(spark):
    from cohortlens import load_profile
    r = load_profile(frame(spark, [row(1), row(2)])).first()
    assert (r.rows, r.columns) == (2, 13)


def test_scale_conf_sizes_the_key_shuffle():
    from cohortlens.session import scale_conf
    c = scale_conf(rows=10 ** 12)  # ~100 TB of events
    assert int(c["spark.sql.shuffle.partitions"]) == -(-(10 ** 12) * 32 // (256 << 20))
    assert scale_conf(rows=1000)["spark.sql.shuffle.partitions"] == "1"


def test_agg9_shows_by_subtraction_counts_null_outcome_as_shown(spark):
    schema = StructType([StructField("AppointmentID", LongType()), StructField("ScheduledDay", DateType()),
                         StructField("AppointmentDay", DateType()), StructField("No-show", BooleanType())])
    df = spark.createDataFrame([(1, D0, D0, True), (2, D0, D0, None), (3, D0, D0, False)], schema)
    base = prepare(df, WAREHOUSE_COLUMNS.with_(entity=None, attributes=()))
    assert rate_curve(base).first().total_shows == 1
    assert rate_curve(base, shows="complement").first().total_shows == 2


def test_agg14_drop_null_keys_and_agg4_count_of_column(spark):
    df = prepare(frame(spark, [row(1, 2, gender=None), row(None, 4, gender="M"), row(3, 4, gender="M")]))
    got = {r.Gender: r.total_patient_volume for r in cohort_summary(df, ["Gender"], drop_null_keys=True).collect()}
    assert got == {"M": 2}
    got = {r.Gender: r.total_patient_volume
           for r in cohort_summary(df, ["Gender"], count_of="AppointmentID").collect()}
    assert got == {None: 1, "M": 1}


def test_d3_leak_beyond_wall_only(spark):
    rows = [row(1, 12, miss=True, sch=1), row(2, 3, miss=True, sch=1), row(3, 15, miss=True, sch=0),
            row(4, 15, miss=False, sch=0)]
    a = Audit(frame(spark, rows))
    every = {r.Scholarship: r.fiscal_leak for r in a.fiscal_leak().collect()}
    beyond = {r.Scholarship: r.fiscal_leak for r in a.fiscal_leak(beyond_wall_only=True).collect()}
    assert every == {0: 210, 1: 240} and beyond == {0: 210, 1: 120}
