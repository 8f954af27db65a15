"""Planted-truth anchors of fixture F1 (FIXTURES.md) at sf0.001 and sf0.01."""

import pytest

from cohortlens import Audit, appointment_view, line_keys, integrity_check

ANCHORS = {
    "/root/testdata/sf0.001": dict(raw=1500, v=1452, p=1450, beyond=(1214, 400), day10=20.8,
                                   pre=25.0556, post=33.0238, sms=(30.8, 32.7), adult_minor=(31.03, 32.71),
                                   dis=(31.6, 30.9), cond=(31.6, 26.3), leak=(82950, 7320),
                                   dup=(4599, 6000)),
    "/root/testdata/sf0.01": dict(raw=15000, v=14523, p=14509, beyond=(12142, 4009), day10=34.5,
                                  pre=24.9222, post=33.0524, sms=(31.0, 32.1), adult_minor=(31.14, 32.33),
                                  dis=(31.4, 29.6), cond=(31.2, 31.6), leak=(865200, 52200),
                                  dup=(45832, 60000)),
}


@pytest.fixture(scope="module", params=sorted(ANCHORS))
def case(request, spark):
    sf = request.param
    return sf, ANCHORS[sf], Audit(appointment_view(spark, sf))


def test_scopes(case):
    sf, a, audit = case
    r = audit.scope_report().first()
    assert (r.raw_rows, r.valid_lead_rows, r.production_rows) == (a["raw"], a["v"], a["p"])
    i = audit.integrity().first()
    assert i.total_records == i.distinct_keys == a["raw"] and i.is_unique


def test_beyond_wall(case):
    _, a, audit = case
    r = audit.beyond_wall().first()
    assert (r.beyond_total, r.beyond_noshows) == a["beyond"]


def test_wall_contrast(case):
    _, a, audit = case
    r = audit.wall_contrast(digits=4).first()
    assert r.pre_wall_rate == a["pre"] and r.post_wall_rate == a["post"]
    assert r.wall_day_rate == a["day10"]


def test_reminder_and_age_rates(case):
    _, a, audit = case
    rates = {r.sms_received: r.no_show_rate for r in audit.reminder_rate().collect()}
    assert (rates[0], rates[1]) == a["sms"]
    g = {r.label: r for r in audit.cohort_gaps().collect()}
    adv = g["advocacy_gap"]
    assert (round(adv.b, 2), round(adv.a, 2)) == a["adult_minor"]
    dis = g["disability_compression"]
    assert (dis.a, dis.b) == a["dis"]
    cond = g["condition_compression"]
    assert (cond.a, cond.b) == a["cond"]


def test_fiscal_leak(case):
    _, a, audit = case
    leak = {r.Scholarship: r.fiscal_leak for r in audit.fiscal_leak().collect()}
    assert (leak[0], leak[1]) == a["leak"]


def test_duplicate_fixture(spark, case):
    sf, a, _ = case
    r = integrity_check(line_keys(spark, sf), ["l_orderkey", "l_linenumber"]).first()
    assert (r.distinct_keys, r.total_records) == a["dup"]
    assert not r.is_unique and r.duplicate_records == a["dup"][1] - a["dup"][0]
