"""Registered queries: every audit over the fixture views of a test-data folder.

Each entry takes (spark, sf_dir) and returns a lazy DataFrame over the
whole tables of that folder.  F1 = ``appointment_view`` (orders), F2 =
``shipment_view`` (lineitem joined to orders), F3 = ``line_keys``.
"""

from __future__ import annotations

import uuid
from typing import Callable, Dict

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import AuditParams, CSV_COLUMNS, WAREHOUSE_COLUMNS
from ..operators.metrics import Metric, metrics_long
from ..operators.quality import column_profile, duplicate_keys, integrity_check, load_profile
from ..sources.csv_load import CsvLoad, load_csv
from ..sources.events import REFERENCE_CSV_TYPES
from ..sources.layout import LayoutAudit, write_layout
from ..sources.fixtures import appointment_view, clinic_view, line_keys, nation_rates, shipment_view
from ..operators.bitmaps import bitmap_integrity, count_bitmaps, distinct_bitmaps
from ..operators.ordering import in_position
from ..operators.cohorts import Order, cohort_gaps, cohort_summary, reference_gaps
from ..operators.cube import CohortCube
from ..session import require_checkpoint_dir
from ..sinks.cube_store import CubeStore
from ..sinks.feed import write_feed
from ..sinks.publish import Published
from .audit import FULL_AUDIT_SPECS, GROUPED_AUDITS, Audit, cube_audit, publish_cube
from .views import register_audit_views

Query = Callable[[SparkSession, str], DataFrame]

# Unrounded figures that are sums of floats (means of rates, differences)
# are compared at 4 dp; float summation order is not part of the result.
COMPARE_DIGITS = 4


def _f1(spark: SparkSession, sf_dir: str, order: Order = True) -> Audit:
    return Audit(appointment_view(spark, sf_dir), WAREHOUSE_COLUMNS, AuditParams(), order=order)


def _f2(spark: SparkSession, sf_dir: str, order: Order = True) -> Audit:
    return Audit(shipment_view(spark, sf_dir), WAREHOUSE_COLUMNS, AuditParams(), order=order)


def _f5(spark: SparkSession, sf_dir: str, order: Order = True) -> Audit:
    return Audit(clinic_view(spark, sf_dir), CSV_COLUMNS, AuditParams(), order=order)


def _with(audit: Audit, **params) -> Audit:
    return Audit(audit.events, audit.cmap, audit.params.with_(**params))


# Figures that need lead days far beyond the wall, read from the cube's cells.
FAR_METRICS = (
    Metric("rows, lead >= 70", "count", "lead_time >= 70"),
    Metric("rows, lead = 80", "count", "lead_time = 80"),
    Metric("rows, lead = 61", "count", "lead_time = 61"),
    Metric("rows, lead 61 to 200", "count", "lead_time BETWEEN 61 AND 200"),
    Metric("missed rate, lead >= 70", "rate", "lead_time >= 70", 4),
    Metric("mean lead, lead >= 70", "mean_lead", "lead_time >= 70", 4),
)

# The fixture's own anchors at any scale: (label, expected, tolerance).  F1 plants a missed rate of 5 % on days up to
# 0, 25 % on days 1 to 9 and 33 % from day 10; its lead days are spread evenly over -2..60.
ANCHORS = (
    ("Day 10 no-show rate (%)", 33.0, 15.0),
    ("SMS=1 no-show rate (%)", 32.0, 6.0),
    ("SMS=0 no-show rate (%)", 31.0, 6.0),
    ("SMS no-show avg lead time (d)", 32.0, 6.0),
    ("Adults no-show rate (%)", 31.0, 6.0),
)


def _text_keys(df: DataFrame) -> DataFrame:
    """Integer and boolean cohort keys as text: they hold NULLs on F5, and a NULL integer has no one form outside Spark."""
    measures = {"total_patient_volume", "modeled_revenue_impact", "total_no_shows"}
    return df.selectExpr(*[f"CAST(`{c}` AS STRING) AS `{c}`" if t in ("int", "bigint", "boolean") and c not in measures else f"`{c}`"
                           for c, t in df.dtypes])


def _cube_gaps(audit: Audit) -> DataFrame:
    cube = audit.cube()
    return cohort_gaps(cube.scoped("valid"), reference_gaps(audit.params), COMPARE_DIGITS,
                       audit.params, cells=True)


def _cube_scorecard(audit: Audit) -> DataFrame:
    return audit.scorecard(digits=COMPARE_DIGITS, cube=audit.cube())


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder of the session's shared checkpoint folder."""
    return f"{require_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stored_cube(spark: SparkSession, sf_dir: str) -> CohortCube:
    """F1 as a store of daily batches that came out of order, one of them twice and one first with wrong outcomes."""
    audit = _f1(spark, sf_dir)
    store = CubeStore(spark, _scratch(spark, "cube-store"), audit.cmap, audit.params)

    def batch(i: int, flip: bool = False) -> CohortCube:
        rows = audit.events.where(f"dayofmonth(ScheduledDay) % 4 = {i}")
        return Audit(rows.withColumn("No-show", ~F.col("`No-show`")) if flip else rows, audit.cmap, audit.params).cube()

    store.add("batch 2", batch(2))
    store.add("batch 1", batch(1, flip=True))
    store.add("batch 2", batch(2))
    store.compact()
    store.add("batch 3", batch(3))
    store.replace("batch 1", "batch 1, corrected", batch(1))
    store.add("batch 0", batch(0))
    return store.cube()


def _published(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = _scratch(spark, "published")
    publish_cube(_f1(spark, sf_dir).cube().materialize(), path)
    return Published(spark, path).table(name)


def _clinic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 as the text of an extract, with faults: every 97th age, 101st patient and 103rd booking is no number or day."""
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    k = "AppointmentID"
    return clinic_view(spark, sf_dir).selectExpr(
        f"CASE WHEN {k} % 101 = 3 THEN 'abc' ELSE concat(PatientId, '.0') END AS PatientId", f"CAST({k} AS STRING) AS {k}", "Gender",
        f"CASE WHEN {k} % 103 = 4 THEN 'some day' ELSE date_format(ScheduledDay, \"{iso}\") END AS ScheduledDay",
        f"date_format(AppointmentDay, \"{iso}\") AS AppointmentDay",
        f"CASE WHEN {k} % 97 = 5 THEN 'abc' ELSE CAST(Age AS STRING) END AS Age", "'CENTRO' AS Neighbourhood",
        "Scholarship", "Hipertension", "Diabetes", "Alcoholism", "Handcap", "SMS_received", "`No-show`")


def _clinic_csv(spark: SparkSession, sf_dir: str) -> CsvLoad:
    source = _scratch(spark, "clinic-csv")
    _clinic_text(spark, sf_dir).write.option("header", "true").csv(source)
    return load_csv(spark, source, REFERENCE_CSV_TYPES, _scratch(spark, "clinic-staged"), "AppointmentID", max_reject_share=0.05)


def _clinic_iso(spark: SparkSession, sf_dir: str) -> Audit:
    """F5 with its days as ISO text, some of which is none."""
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    booked = F.when(F.expr("AppointmentID % 103 = 4"), F.lit("some day")).otherwise(F.date_format("ScheduledDay", iso))
    rows = clinic_view(spark, sf_dir).withColumns({"ScheduledDay": booked, "AppointmentDay": F.date_format("AppointmentDay", iso)})
    return Audit(rows, CSV_COLUMNS, AuditParams())


def _laid_out(spark: SparkSession, sf_dir: str, **window) -> LayoutAudit:
    path = _scratch(spark, "layout")
    write_layout(clinic_view(spark, sf_dir), path, CSV_COLUMNS)
    return LayoutAudit(spark, path, CSV_COLUMNS, **window)


def _by_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline audit as SQL over the temp views, grouped and ordered by position, with the 0/1 outcome."""
    register_audit_views(spark, appointment_view(spark, sf_dir))
    return spark.sql("""SELECT Scholarship, missed_appointment AS no_show, COUNT(*) AS total_patient_volume,
        ROUND(AVG(lead_time), 1) AS avg_lead_time FROM appointments_enriched_v2 GROUP BY 1, 2 ORDER BY 1, 2""")


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard feed as it is read back from the sink."""
    path = _scratch(spark, "feed")
    write_feed(_f1(spark, sf_dir).exposure(), path, partition_by=["Scholarship"])
    return spark.read.parquet(path)


def _named(name: str) -> Query:
    return lambda spark, sf_dir: _f1(spark, sf_dir).run(name)


def build_queries() -> Dict[str, Query]:
    q: Dict[str, Query] = {
        "integrity_orders": lambda s, d: _f1(s, d).integrity(),
        "integrity_lineitem": lambda s, d: integrity_check(line_keys(s, d), ["l_orderkey", "l_linenumber"]),
        "duplicate_keys_lineitem": lambda s, d: duplicate_keys(line_keys(s, d), ["l_orderkey", "l_linenumber"]),
        "scope_report": _named("scope_report"),
        "outcome_report": _named("outcome_report"),
        "load_profile": lambda s, d: load_profile(appointment_view(s, d)),
    }
    for spec in GROUPED_AUDITS:
        q[spec.name] = _named(spec.name)
    q.update({
        "reminder_rate": _named("reminder_rate"),
        "lead_day_curve": _named("lead_day_curve"),
        "lead_day_curve_complement": lambda s, d: _f1(s, d).lead_day_curve(shows="complement"),
        "wall_contrast": lambda s, d: _f1(s, d).wall_contrast(digits=COMPARE_DIGITS),
        "wall_contrast_weighted": lambda s, d: _f1(s, d).wall_contrast(digits=COMPARE_DIGITS, weighted=True),
        "beyond_wall": _named("beyond_wall"),
        "cohort_volume": _named("cohort_volume"),
        "cohort_gaps": lambda s, d: _f1(s, d).cohort_gaps(digits=COMPARE_DIGITS),
        "disabled_share": _named("disabled_share"),
        "exposure_summary": _named("exposure_summary"),
        "fiscal_leak": _named("fiscal_leak"),
        "scorecard": lambda s, d: _f1(s, d).scorecard(digits=COMPARE_DIGITS),
        "scorecard_summary": _named("scorecard_summary"),
        "full_audit_cube": lambda s, d: _f1(s, d).cube().full_audit(FULL_AUDIT_SPECS),
        # the same figures served by the cohort cube (one scan of the events)
        "cube_exposure_summary": lambda s, d: cube_audit(_f1(s, d).cube(), "exposure_summary"),
        "cube_cohort_gaps": lambda s, d: _cube_gaps(_f1(s, d)),
        "cube_scorecard": lambda s, d: _cube_scorecard(_f1(s, d)),
        # the volume fixture (a real join, thousands of lead days)
        "shipment_lead_day_curve": lambda s, d: _f2(s, d).lead_day_curve(),
        "shipment_exposure_summary": lambda s, d: _f2(s, d).exposure(),
        "shipment_cube_scorecard": lambda s, d: _cube_scorecard(_f2(s, d)),
        "shipment_cube_cohort_gaps": lambda s, d: _cube_gaps(_f2(s, d)),
        "shipment_cube_wall_365": lambda s, d: cube_audit(_with(_f2(s, d), wall=365).cube(), "wall_by_payer"),
        "shipment_cube_far_metrics": lambda s, d: metrics_long(_f2(s, d).cube().scoped("valid"), FAR_METRICS, cells=True),
        "cube_adult_age_40": lambda s, d: cube_audit(_with(_f1(s, d), adult_age=40).cube(), "age_class_outcome"),
        # figures that no other query shows
        "fiscal_leak_total": lambda s, d: _f1(s, d).fiscal_leak_total(),
        "fiscal_leak_beyond_wall": lambda s, d: _f1(s, d).fiscal_leak(beyond_wall_only=True),
        "exposure_rate_table": lambda s, d: _f1(s, d).exposure((nation_rates(s, d), "payer", "rate")),
        "lead_day_curve_0_25": lambda s, d: _f1(s, d).lead_day_curve().where("lead_time_day <= 25"),
        "column_profile": lambda s, d: column_profile(appointment_view(s, d)),
        "scorecard_anchors": lambda s, d: _f1(s, d).scorecard(ANCHORS, digits=COMPARE_DIGITS),
        "wall_by_payer_ordered": lambda s, d: in_position(_f1(s, d, order="global").run("wall_by_payer")),
        "lead_day_curve_ordered": lambda s, d: in_position(_f1(s, d, order="global").lead_day_curve()),
        "exposure_summary_ordered": lambda s, d: in_position(_f1(s, d, order="global").exposure()),
        # the distinct count as bitmaps: alone, beside the checkpoints, and merged over cohorts
        "integrity_orders_bitmap": lambda s, d: _f1(s, d).bitmap_integrity(),
        "shipment_integrity_bitmap": lambda s, d: _f2(s, d).bitmap_integrity(),
        "integrity_lineitem_bitmap": lambda s, d: bitmap_integrity(line_keys(s, d), ["l_orderkey", "l_linenumber"]),
        "shipment_scorecard_one_pass": lambda s, d: _f2(s, d).scorecard_one_pass(digits=COMPARE_DIGITS),
        "clinic_scorecard_one_pass": lambda s, d: _f5(s, d).scorecard_one_pass(digits=COMPARE_DIGITS),
        "distinct_patients_by_payer": lambda s, d: count_bitmaps(
            distinct_bitmaps(_f1(s, d).base("valid"), ["Scholarship", "trust_wall_status", "no_show_status"], "PatientId"),
            ["Scholarship"], "distinct_patients"),
        # the grouped audits with their own key types, from grouping sets over the cube
        "grouped_audits_typed": lambda s, d: _f1(s, d).cube().grouped_sets(FULL_AUDIT_SPECS),
        "clinic_grouped_audits_typed": lambda s, d: _f5(s, d).cube().grouped_sets(FULL_AUDIT_SPECS),
        # a cube of batches added, corrected and compacted; all audits by one job; reports counted while the cube is written
        "cube_store_full_audit": lambda s, d: _stored_cube(s, d).full_audit(FULL_AUDIT_SPECS),
        "published_condition_combinations": lambda s, d: _published(s, d, "condition_combinations"),
        "published_fiscal_leak": lambda s, d: _published(s, d, "fiscal_leak"),
        "observed_scope_report": lambda s, d: _f1(s, d).observed_cube()[1]["scope_report"],
        "clinic_observed_outcome_report": lambda s, d: _f5(s, d).observed_cube()[1]["outcome_report"],
        # a CSV with faults, loaded in one pass; days as text
        "csv_rejects": lambda s, d: _clinic_csv(s, d).report(),
        "csv_age_class_outcome": lambda s, d: _text_keys(Audit(_clinic_csv(s, d).rows, CSV_COLUMNS).run("age_class_outcome")),
        "csv_lead_day_curve": lambda s, d: Audit(_clinic_csv(s, d).rows, CSV_COLUMNS).lead_day_curve(),
        "text_timestamp_scope_report": lambda s, d: _clinic_iso(s, d).scope_report(),
        "text_timestamp_lead_day_curve": lambda s, d: _clinic_iso(s, d).lead_day_curve(),
        # events stored by lead day; a seeded sample; the feed read back; SQL over the views with ordinals
        "layout_lead_day_curve_0_25": lambda s, d: _laid_out(s, d, low=0, high=25).lead_day_curve(),
        "layout_wall_by_payer_prod": lambda s, d: _text_keys(_laid_out(s, d).run("wall_by_payer_prod")),
        "layout_scope_report": lambda s, d: _laid_out(s, d).scope_report(),
        "feed_exposure_summary": lambda s, d: _feed(s, d),
        "baseline_by_ordinal": lambda s, d: _by_ordinal(s, d),
        # independent conditions, NULLs in every attribute, text outcome, zoned timestamps
        "clinic_lead_day_curve": lambda s, d: _f5(s, d).lead_day_curve(),
        "clinic_lead_day_curve_complement": lambda s, d: _f5(s, d).lead_day_curve(shows="complement"),
        "clinic_outcome_report": lambda s, d: _f5(s, d).outcome_report(),
        "clinic_scope_report": lambda s, d: _f5(s, d).scope_report(),
        "clinic_exposure_summary": lambda s, d: _text_keys(_f5(s, d).exposure()),
        "clinic_full_audit_cube": lambda s, d: _f5(s, d).cube().full_audit(FULL_AUDIT_SPECS),
        "clinic_nonnull_counts": lambda s, d: cohort_summary(
            _f5(s, d).base("valid"), ["Scholarship"], order=False, drop_null_keys=True, count_of="Age"),
        "shipment_full_audit_cube": lambda s, d: _f2(s, d).cube().full_audit(FULL_AUDIT_SPECS),
    })
    for spec in GROUPED_AUDITS:
        q[f"clinic_{spec.name}"] = lambda s, d, name=spec.name: _text_keys(_f5(s, d).run(name))
    return q
