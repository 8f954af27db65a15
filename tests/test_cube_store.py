"""A cube of added, repeated, corrected and compacted batches equals one built over the right events at once."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlens import Audit, AuditParams, appointment_view
from cohortlens.operators.cube import CohortCube
from cohortlens.plans.audit import FULL_AUDIT_SPECS
from cohortlens.sinks.atomic import list_names, read_text, replace_text, write_once
from cohortlens.sinks.cube_store import CubeStore

SF = "/root/testdata/sf0.001"


def cells(cube):
    return sorted((tuple(r) for r in cube.cells.collect()), key=repr)


def days(events, n=5):
    return {f"day {i}": events.where(f"AppointmentID % {n} = {i}") for i in range(n)}


def test_any_order_equals_one_build(spark, tmpdir_path):
    events = appointment_view(spark, SF)
    whole = cells(Audit(events).cube())
    names = list(days(events))
    for seed in range(2):
        random.Random(seed).shuffle(names)
        store = CubeStore(spark, f"{tmpdir_path}/{seed}")
        assert [store.add(d, Audit(days(events)[d]).cube()) for d in names] == [True] * 5
        assert not store.add(names[0], Audit(days(events)[names[0]]).cube())
        assert cells(store.cube()) == whole and store.entries() == sorted(names)


def test_corrections_and_compaction(spark, tmpdir_path):
    events = appointment_view(spark, SF)
    parts = days(events)
    wrong = parts["day 1"].withColumn("No-show", ~F.col("`No-show`")).withColumn("Gender", F.lit("X"))
    store = CubeStore(spark, tmpdir_path)
    for d in ("day 0", "day 2", "day 3"):
        store.add(d, Audit(parts[d]).cube())
    store.add("day 1", Audit(wrong).cube())
    store.compact()
    assert store.replace("day 1", "day 1 again", Audit(parts["day 1"]).cube())
    assert not store.replace("day 1", "day 1 again", Audit(parts["day 1"]).cube())
    assert not store.take_back("day 1")
    store.add("day 4", Audit(parts["day 4"]).cube())
    for _ in range(2):
        assert cells(store.cube()) == cells(Audit(events).cube())
        store.compact()
    assert store.take_back("day 4")
    rest = Audit(events.where("AppointmentID % 5 <> 4")).cube()
    assert cells(store.cube()) == cells(rest)
    got = sorted((tuple(r) for r in store.cube().full_audit(FULL_AUDIT_SPECS).collect()), key=repr)
    assert got == sorted((tuple(r) for r in rest.full_audit(FULL_AUDIT_SPECS).collect()), key=repr)
    # taking back the taking back counts the day again
    assert store.take_back("day 4 taken back") and cells(store.cube()) == cells(Audit(events).cube())


def test_refusals(spark, tmpdir_path):
    store = CubeStore(spark, tmpdir_path)
    with pytest.raises(FileNotFoundError):
        store.cube()
    with pytest.raises(KeyError):
        store.take_back("day 9")
    other = Audit(appointment_view(spark, SF), params=AuditParams(adult_age=40)).cube()
    with pytest.raises(ValueError, match="other parameters"):
        store.add("day 1", other)


def test_a_delta_without_an_entry_is_not_read(spark, tmpdir_path):
    events = appointment_view(spark, SF)
    store = CubeStore(spark, tmpdir_path)
    store.add("a/b day", Audit(events).cube())
    store._write(Audit(events).cube().cells)
    assert cells(store.cube()) == cells(Audit(events).cube()) and store.entries() == ["a/b day"]


def test_merge_and_signs(spark):
    events = appointment_view(spark, SF)
    cubes = [Audit(d).cube() for d in days(events).values()]
    assert cells(CohortCube.merge(cubes)) == cells(Audit(events).cube())
    assert cells(CohortCube.merge([cubes[0], cubes[0].times(-1)])) == []


def test_atomic_files(spark, tmpdir_path):
    path = f"{tmpdir_path}/a/pointer"
    assert read_text(spark, path) is None and list_names(spark, f"{tmpdir_path}/a") == []
    assert write_once(spark, path, "one é") and not write_once(spark, path, "two")
    assert read_text(spark, path) == "one é"
    replace_text(spark, path, "three")
    assert read_text(spark, path) == "three" and list_names(spark, f"{tmpdir_path}/a") == ["pointer"]
