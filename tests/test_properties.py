"""Invariants and brute-force checks on random small event tables (hypothesis)."""

import datetime as dt
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings, strategies as st

from cohortlens import Audit
from cohortlens.plans.audit import FULL_AUDIT_SPECS, GROUPED_AUDITS, cube_audit
from tests.test_traps import SCHEMA

D0 = dt.date(2016, 1, 1)


def half_up(x, digits=1):
    if x is None:
        return None
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


event = st.tuples(
    st.one_of(st.none(), st.integers(-3, 40)),              # lead (None = missing due date)
    st.one_of(st.none(), st.booleans()),                     # outcome
    st.sampled_from(["M", "F", None]),                       # gender
    st.integers(0, 1), st.integers(0, 1), st.integers(0, 1), st.integers(0, 1),  # sch, h, d, a
    st.sampled_from([0, 1, 2, None]),                        # handcap
    st.integers(0, 1),                                       # sms
    st.one_of(st.none(), st.integers(-2, 90)),               # age
    st.booleans(),                                           # entity present
)


def to_rows(events):
    rows = []
    for i, (lead, miss, g, sch, h, d, a, hc, sms, age, ent) in enumerate(events):
        due = None if lead is None else D0 + dt.timedelta(days=lead)
        rows.append((i if ent else None, i, g, D0, due, age, sch, h, d, a, hc, sms, miss))
    return rows


def brute_summary(events, key_fn, scope="valid"):
    groups = defaultdict(list)
    for e in events:
        lead, ent = e[0], e[10]
        if lead is None or lead < 0 or (scope == "production" and not ent):
            continue
        groups[key_fn(e)].append(lead)
    return {k: (len(v), half_up(sum(v) / len(v))) for k, v in groups.items()}


settings.register_profile("spark", max_examples=5, deadline=None, derandomize=True,
                          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
settings.load_profile("spark")


@given(st.lists(event, min_size=1, max_size=40))
def test_summaries_match_brute_force(spark, events):
    a = Audit(spark.createDataFrame(to_rows(events), SCHEMA))
    got = {(r.Gender, r.Scholarship, r.no_show_status): (r.total_patient_volume, r.avg_lead_time)
           for r in a.run("gender_payer").collect()}
    assert got == brute_summary(events, lambda e: (e[2], e[3], e[1]))
    band = {(r.Scholarship, r.trust_wall_status, r.no_show_status): (r.total_patient_volume, r.avg_lead_time)
            for r in a.run("wall_by_payer_prod").collect()}
    want = brute_summary(events, lambda e: (e[3], "Beyond Trust Wall" if e[0] >= 10 else "Operational Safe Zone",
                                            e[1]), scope="production")
    assert band == want


@given(st.lists(event, min_size=1, max_size=40))
def test_invariants_and_cube(spark, events):
    a = Audit(spark.createDataFrame(to_rows(events), SCHEMA))
    scope = a.scope_report().first()
    valid = [e for e in events if e[0] is not None and e[0] >= 0]
    assert scope.valid_lead_rows == len(valid) and scope.raw_rows == len(events)
    # every grouped audit partitions its scope
    for spec in GROUPED_AUDITS:
        rows = a.grouped(spec).collect()
        vol = spec.volume or "total_patient_volume"
        n = sum(r[vol] for r in rows)
        if spec.missed_only:
            assert n == sum(1 for e in valid if e[1])
        else:
            assert n == (scope.production_rows if spec.scope == "production" else scope.valid_lead_rows)
    # curve: missed + shown = total when no outcome is NULL; day windows exclude day 0
    for r in a.run("lead_day_curve").collect():
        nulls = sum(1 for e in valid if e[0] == r.lead_time_day and e[1] is None)
        assert r.total_noshows + r.total_shows + nulls == r.total_appointments
    # shares sum to 100 within rounding
    shares = [r.pct_of_total_volume for r in a.run("exposure_summary").collect()]
    if shares:
        assert abs(sum(shares) - 100.0) <= 0.005 * len(shares) + 1e-9
    # the cube gives the direct answers
    cube = a.cube()
    for name in ("gender_payer", "condition_combinations", "age_class_band", "lead_day_curve",
                 "reminder_rate", "scope_report", "exposure_summary", "fiscal_leak", "cohort_gaps",
                 "beyond_wall", "disabled_share"):
        assert cube_audit(cube, name).collect() == a.run(name).collect(), name
    assert a.scorecard(cube=cube).collect() == a.scorecard().collect()


def test_empty_input_gives_empty_or_null_not_errors(spark):
    a = Audit(spark.createDataFrame([], SCHEMA))
    i = a.integrity().first()
    assert (i.total_records, i.distinct_keys, i.is_unique) == (0, 0, True)
    assert a.run("baseline_volume").collect() == []
    assert a.run("exposure_summary").collect() == []
    w = a.wall_contrast().first()
    assert w.pre_wall_rate is None and w.wall_day_rate is None
    sc = a.scorecard().collect()
    assert len(sc) == 13 and not any(r.ok for r in sc)
    actual = {r.label: r.actual for r in sc}
    assert actual["Total records (raw)"] == 0.0 and actual["Distinct AppointmentIDs"] == 0.0
    assert actual["Day 10 no-show rate (%)"] is None
    assert a.cube().full_audit(FULL_AUDIT_SPECS).collect() == []


@given(st.lists(event, min_size=1, max_size=40))
def test_rates_match_brute_force(spark, events):
    a = Audit(spark.createDataFrame(to_rows(events), SCHEMA))
    valid = [e for e in events if e[0] is not None and e[0] >= 0]
    days = defaultdict(list)
    for e in valid:
        days[e[0]].append(e[1])
    want = {}
    for d, outs in days.items():
        k, s, n = sum(1 for o in outs if o is True), sum(1 for o in outs if o is False), len(outs)
        want[d] = (n, k, s, half_up(k / n * 100), half_up(s / n * 100))
    got = {r.lead_time_day: (r.total_appointments, r.total_noshows, r.total_shows, r.noshowrate_pct,
                             r.show_rate_pct) for r in a.run("lead_day_curve").collect()}
    assert got == want
    sms = defaultdict(list)
    for e in valid:
        sms[e[8]].append(e[1])
    want = {s: (half_up(sum(1 for o in outs if o is True) / len(outs) * 100), len(outs))
            for s, outs in sms.items()}
    got = {r.sms_received: (r.no_show_rate, r.total_appointments) for r in a.run("reminder_rate").collect()}
    assert got == want
