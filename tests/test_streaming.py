"""The streamed cube equals the batch cube, also after a second batch of files."""

from cohortlens import Audit, appointment_view
from cohortlens.plans.audit import FULL_AUDIT_SPECS
from cohortlens.streaming import cube_stream, read_cube_snapshot
from tests.conftest import SF01


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_incremental_cube_matches_batch(spark, tmpdir_path):
    events = appointment_view(spark, SF01)
    src, snap = f"{tmpdir_path}/src", f"{tmpdir_path}/snap"
    # stream state goes under the session's checkpoint folder (spark.checkpoint.dir)
    from cohortlens.session import checkpoint_dir
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/cube-stream-{tmpdir_path.rsplit('-', 1)[-1]}"
    part1 = events.where("AppointmentID % 2 = 0")
    part2 = events.where("AppointmentID % 2 = 1")

    part1.write.mode("append").parquet(src)
    cube_stream(spark, src, events.schema, snap, checkpoint_location=ckpt).awaitTermination(300)
    cube = read_cube_snapshot(spark, snap)
    assert _rows(cube.full_audit(FULL_AUDIT_SPECS)) == _rows(Audit(part1).cube().full_audit(FULL_AUDIT_SPECS))

    # new files arrive; the restarted query picks up only those, on top of its state
    part2.write.mode("append").parquet(src)
    cube_stream(spark, src, events.schema, snap, checkpoint_location=ckpt).awaitTermination(300)
    cube = read_cube_snapshot(spark, snap)
    assert _rows(cube.full_audit(FULL_AUDIT_SPECS)) == _rows(Audit(events).cube().full_audit(FULL_AUDIT_SPECS))
    assert cube.scope_report().first().raw_rows == 15000
    # each micro-batch left its own complete snapshot; the reader took the newest
    from cohortlens.streaming import latest_snapshot
    assert latest_snapshot(spark, snap).rsplit("batch=", 1)[1].startswith("1-")
    # a reader with other build parameters is refused, and such a stream would keep its own state
    import pytest

    from cohortlens import AuditParams, WAREHOUSE_COLUMNS
    from cohortlens.operators.cube import build_tag
    from cohortlens.streaming.cube_stream import default_stream_checkpoint
    older = AuditParams(adult_age=40)
    with pytest.raises(ValueError, match="other parameters"):
        read_cube_snapshot(spark, snap, params=older)
    folders = {default_stream_checkpoint(spark, src, snap, build_tag(WAREHOUSE_COLUMNS, p)) for p in (AuditParams(), older)}
    assert len(folders) == 2
