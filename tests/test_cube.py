"""Cube roll-ups equal the direct audits exactly (F1 and F2 at sf0.01)."""

import pytest

from cohortlens import Audit, AuditParams, appointment_view, shipment_view
from cohortlens.plans.audit import FULL_AUDIT_SPECS, GROUPED_AUDITS, cube_audit
from tests.conftest import SF01

from cohortlens.operators.cube import CohortCube
from cohortlens.plans.audit import CUBE_SERVED


@pytest.fixture(scope="module", params=["F1", "F2"])
def pair(request, spark):
    view = appointment_view if request.param == "F1" else shipment_view
    audit = Audit(view(spark, SF01))
    cube = audit.cube().materialize()
    return audit, cube


@pytest.mark.parametrize("name", CUBE_SERVED)
def test_cube_equals_direct(pair, name):
    audit, cube = pair
    direct = audit.run(name)
    rolled = cube_audit(cube, name)
    assert direct.columns == rolled.columns
    assert [f.dataType for f in direct.schema] == [f.dataType for f in rolled.schema]
    if name == "wall_contrast":  # means of floats: summation order may move the last bit
        a, b = direct.first(), rolled.first()
        assert all(x == pytest.approx(y, abs=1e-9) for x, y in zip(a, b))
        return
    assert direct.collect() == rolled.collect()  # both ordered the same way


def test_full_audit_long_form_matches_each_audit(pair):
    audit, cube = pair
    long = {(r.audit, r.key_1, r.key_2, r.key_3): r for r in cube.full_audit(FULL_AUDIT_SPECS).collect()}
    for spec in GROUPED_AUDITS:
        rows = audit.grouped(spec).collect()
        assert rows, spec.name
        vol = spec.volume or "total_patient_volume"
        avg = spec.avg or "avg_lead_time"
        for r in rows:
            keys = [None if r[d] is None else str(r[d]).lower() if isinstance(r[d], bool) else str(r[d])
                    for d in spec.dims]
            keys += [None] * (3 - len(keys))
            got = long[(spec.name, *keys)]
            assert got.total_patient_volume == r[vol] and got.avg_lead_time == r[avg]


def test_cube_size_is_bounded_by_keys_not_rows(pair):
    audit, cube = pair
    cells = cube.cells.count()
    rows = audit.events.count()
    assert cells < rows
    total = cube.scope_report().first().raw_rows
    assert total == rows


def test_cube_wall_can_move_after_build(spark):
    audit = Audit(appointment_view(spark, SF01))
    params = audit.params.with_(wall=5)
    moved = Audit(audit.events, params=params)
    cube = moved.cube()
    assert cube_audit(cube, "wall_by_payer").collect() == moved.run("wall_by_payer").collect()


@pytest.mark.parametrize("wall", [0, 61, 365, 5000])
def test_any_wall_and_window(spark, wall):
    audit = Audit(shipment_view(spark, SF01), params=AuditParams(wall=wall, pre=(50, 90), post=(61, 400)))
    cube = audit.cube()
    assert cube_audit(cube, "wall_by_payer").collect() == audit.run("wall_by_payer").collect()
    assert audit.scorecard(cube=cube).collect() == audit.scorecard().collect()
    a, b = cube_audit(cube, "wall_contrast").first(), audit.run("wall_contrast").first()
    assert all(x == y or x == pytest.approx(y, abs=1e-9) for x, y in zip(a, b))


def test_other_build_parameters_are_refused(spark, tmpdir_path):
    audit = Audit(appointment_view(spark, SF01))
    cube = audit.cube()
    labels = {**audit.params.labels, "minor": "under age"}
    for other in (audit.params.with_(adult_age=40), audit.params.with_(labels=labels)):
        with pytest.raises(ValueError, match="other parameters"):
            cube.with_params(other)
    cube.with_params(audit.params.with_(wall=99, labels={**audit.params.labels, "beyond": "late"}))  # no keys: honoured
    cube.save(f"{tmpdir_path}/mixed")
    old = Audit(audit.events, params=audit.params.with_(adult_age=40))
    old.cube().save(f"{tmpdir_path}/old")
    with pytest.raises(ValueError, match="other parameters"):
        CohortCube.load(spark, f"{tmpdir_path}/old")
    old.cube().save(f"{tmpdir_path}/mixed", mode="append")
    with pytest.raises(ValueError, match="mixes"):
        CohortCube.load(spark, f"{tmpdir_path}/mixed")
    assert cube_audit(old.cube(), "age_class_outcome").collect() == old.run("age_class_outcome").collect()


def test_scorecard_from_cube_equals_direct(pair):
    audit, cube = pair
    assert audit.scorecard(cube=cube).collect() == audit.scorecard().collect()


def test_saved_cube_serves_the_same_audits(spark, tmpdir_path):
    audit = Audit(appointment_view(spark, SF01))
    audit.cube().save(f"{tmpdir_path}/cube")
    loaded = CohortCube.load(spark, f"{tmpdir_path}/cube")
    assert loaded.tag == audit.cube().tag
    for name in ("exposure_summary", "lead_day_curve", "cohort_gaps", "wall_by_payer_prod"):
        assert cube_audit(loaded, name).collect() == audit.run(name).collect(), name
    assert audit.scorecard(cube=loaded).collect() == audit.scorecard().collect()
