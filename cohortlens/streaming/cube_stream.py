"""Keep the cohort cube current over an append-only folder of event files.

The batch chain is reused unchanged: ``prepare`` and ``segment`` are
stateless projections, and the cube is a streaming ``groupBy().count()``
whose state is the cell table — bounded by the key domains, not by the
number of events.  Each micro-batch writes the complete cell table as a
versioned snapshot ``<snapshot_path>/batch=<id>-<attempt>`` (``foreachBatch``);
replaying a batch after a failure writes the same cells to a folder of its own,
so a folder that readers may have open is never touched.  The pointer file
``_LATEST`` is then replaced (written aside and renamed), so that
``read_cube_snapshot`` opens the newest complete snapshot without listing the
others and never meets half a pointer.  Every snapshot stores the cube's build tag.  Old snapshots
are small and kept; prune them with the storage's own lifecycle rules.

Progress and state live under ``checkpoint_location``; on a cluster it must
be a shared folder (by default a stable sub-folder of the configured
``spark.checkpoint.dir``, named from the source and snapshot paths, so a
restarted application resumes where it stopped).
"""

from __future__ import annotations

import hashlib
import uuid
from typing import Optional

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..config import AuditParams, ColumnMap, WAREHOUSE_COLUMNS
from ..operators.cube import TAG, CohortCube, build_tag
from ..session import require_checkpoint_dir
from ..sinks.atomic import read_text, replace_text


def cube_stream(
    spark: SparkSession,
    source_dir: str,
    schema: StructType,
    snapshot_path: str,
    cmap: ColumnMap = WAREHOUSE_COLUMNS,
    params: AuditParams = AuditParams(),
    fmt: str = "parquet",
    checkpoint_location: Optional[str] = None,
    available_now: bool = True,
    max_files_per_trigger: Optional[int] = None,
) -> StreamingQuery:
    """Start the incremental cube; returns the running query.

    ``available_now=True`` processes everything present and stops (a
    scheduled catch-up run); ``False`` keeps running as new files arrive.
    """
    from ..plans.audit import Audit

    ckpt = checkpoint_location or default_stream_checkpoint(spark, source_dir, snapshot_path, build_tag(cmap, params))
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    events = reader.load(source_dir)
    cube = Audit(events, cmap, params).cube()
    cells = cube.cells.withColumn(TAG, F.lit(cube.tag))

    def write_snapshot(batch: DataFrame, batch_id: int) -> None:
        # complete mode: every batch carries the whole cell table
        folder = f"batch={batch_id}-{uuid.uuid4().hex}"
        batch.write.parquet(f"{snapshot_path.rstrip('/')}/{folder}")
        replace_text(spark, f"{snapshot_path.rstrip('/')}/_LATEST", folder)

    w = (cells.writeStream.outputMode("complete")
         .option("checkpointLocation", ckpt)
         .foreachBatch(write_snapshot))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def default_stream_checkpoint(spark: SparkSession, source_dir: str, snapshot_path: str, tag: str = "") -> str:
    """A stable state folder under the configured ``spark.checkpoint.dir`` (not the
    per-application sub-folder), so a restarted application resumes the same stream; ``tag`` (the cube's build tag)
    keeps a stream with other parameters from adding to this one's state."""
    base = spark.conf.get("spark.checkpoint.dir", None) or require_checkpoint_dir(spark)
    name = hashlib.sha1(f"{source_dir}|{snapshot_path}|{tag}".encode()).hexdigest()[:12]
    return f"{base.rstrip('/')}/cohort-cube-stream/{name}"


def latest_snapshot(spark: SparkSession, snapshot_path: str) -> str:
    """Path of the newest complete snapshot, from the pointer file."""
    folder = read_text(spark, f"{snapshot_path.rstrip('/')}/_LATEST")
    if folder is None:
        raise FileNotFoundError(f"no complete cube snapshot under {snapshot_path}")
    return f"{snapshot_path.rstrip('/')}/{folder}"


def read_cube_snapshot(
    spark: SparkSession,
    snapshot_path: str,
    cmap: ColumnMap = WAREHOUSE_COLUMNS,
    params: AuditParams = AuditParams(),
) -> CohortCube:
    """The newest complete cube snapshot as a ``CohortCube`` (batch), ready for roll-ups."""
    return CohortCube.from_table(spark.read.parquet(latest_snapshot(spark, snapshot_path)), cmap, params)
