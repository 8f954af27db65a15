"""All audits of the cube from one write job, published together."""

import os

import pytest
from pyspark.sql import DataFrameWriter

from cohortlens import Audit, appointment_view
from cohortlens.__main__ import ALL_AUDITS, main
from cohortlens.plans.audit import CUBE_SERVED, cube_audit, publish_cube
from cohortlens.sinks.publish import Published, publish
from cohortlens.sources.fixtures import clinic_view
from cohortlens.config import CSV_COLUMNS

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("view, cmap", [(appointment_view, None), (clinic_view, CSV_COLUMNS)])
def test_every_table_as_by_itself(spark, tmpdir_path, view, cmap):
    audit = Audit(view(spark, SF), cmap) if cmap else Audit(view(spark, SF))
    cube = audit.cube().materialize()
    publish_cube(cube, tmpdir_path, {"outcome_report": audit.outcome_report()})
    out = Published(spark, tmpdir_path)
    assert out.names() == sorted([*CUBE_SERVED, "outcome_report"])
    for name in CUBE_SERVED:
        want = cube_audit(cube, name, order=False)
        got = out.table(name)
        assert got.dtypes == want.dtypes, name
        if name not in ("wall_contrast", "cohort_gaps"):  # float means: summation order may move the last bit
            assert rows(got) == rows(want), name
        else:
            assert got.count() == want.count()
    assert rows(out.table("outcome_report")) == rows(audit.outcome_report())


def test_one_write(spark, tmpdir_path):
    """However many audits there are, one query writes them, into one run folder."""
    writes = []
    real = DataFrameWriter.parquet

    def counted(self, path, *args, **kw):
        writes.append(path)
        return real(self, path, *args, **kw)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", counted)
        publish_cube(Audit(appointment_view(spark, SF)).cube().materialize(), tmpdir_path)
    assert len(writes) == 1 and os.listdir(f"{tmpdir_path}/runs") == [writes[0].rsplit("/", 1)[1]]


def test_readers_keep_their_run(spark, tmpdir_path):
    one, two = spark.range(3), spark.range(5)
    publish(spark, {"a": one, "b": one.selectExpr("cast(id as string) as id", "id as n")}, tmpdir_path)
    old = Published(spark, tmpdir_path)
    publish(spark, {"a": two, "b": two.where("id < 0").selectExpr("cast(id as string) as id", "id as n")}, tmpdir_path)
    new = Published(spark, tmpdir_path)
    assert old.table("a").count() == 3 and new.table("a").count() == 5
    # columns of one name and two types, and a table without rows
    assert old.table("b").dtypes == [("id", "string"), ("n", "bigint")] and rows(old.table("b")) == [("0", 0), ("1", 1), ("2", 2)]
    assert new.table("b").dtypes == old.table("b").dtypes and new.table("b").count() == 0
    with pytest.raises(FileNotFoundError):
        Published(spark, f"{tmpdir_path}/none")


def test_command_line(spark, tmpdir_path):
    src = f"{tmpdir_path}/events"
    appointment_view(spark, SF).write.parquet(src)
    main(["--events", src, "--out", f"{tmpdir_path}/each"], spark=spark)
    main(["--events", src, "--out", f"{tmpdir_path}/once", "--one-job"], spark=spark)
    once = Published(spark, f"{tmpdir_path}/once")
    assert once.names() == sorted(ALL_AUDITS)
    for name in ALL_AUDITS:
        if name not in ("wall_contrast", "cohort_gaps"):
            assert rows(once.table(name)) == rows(spark.read.parquet(f"{tmpdir_path}/each/{name}")), name


def test_reports_of_the_writing_pass(spark):
    audit = Audit(clinic_view(spark, SF), CSV_COLUMNS)
    cube, reports = audit.observed_cube()
    assert rows(reports["scope_report"]) == rows(audit.scope_report()) == rows(cube.scope_report())
    assert rows(reports["outcome_report"]) == rows(audit.outcome_report())
    for df in reports.values():
        assert "Scan parquet" not in df._jdf.queryExecution().executedPlan().toString()
    empty = Audit(clinic_view(spark, SF).limit(0), CSV_COLUMNS)
    assert rows(empty.observed_cube()[1]["scope_report"]) == [(0,) * 6]
