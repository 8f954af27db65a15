"""Session settings the audits rely on, and where lineage may be cut.

On a cluster the session is given: we only *read* ``spark.checkpoint.dir``
(a shared folder the cluster names).  Local tests and the bench build their
own session and may set a scratch checkpoint folder because none is set.
"""

from __future__ import annotations

import os
import tempfile
from typing import Optional

from pyspark.sql import SparkSession

# Settings every audit session should carry.  The time zone matters for
# correctness (timestamp -> date casts), the rest for plan quality.
AUDIT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def local_session(
    master: Optional[str] = None,
    shuffle_partitions: int = 8,
    app_name: str = "cohortlens",
    extra: Optional[dict] = None,
) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    if master and not master.startswith("local"):
        raise ValueError(f"local_session is for local masters, not {master!r}")
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(AUDIT_CONF)
    conf.update({
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    })
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Read the checkpoint folder from the session; only a local run with none
    # configured gets a scratch folder of its own.
    if not checkpoint_dir(spark) and spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlens-ckpt-", dir="/tmp"))
    return spark


def checkpoint_dir(spark: SparkSession) -> Optional[str]:
    """The shared checkpoint folder named by the session, if any."""
    d = spark.sparkContext._jsc.sc().getCheckpointDir()
    if d.isDefined():
        return d.get()
    return spark.conf.get("spark.checkpoint.dir", None)


def require_checkpoint_dir(spark: SparkSession) -> str:
    d = checkpoint_dir(spark)
    if not d:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; set it to a shared folder (HDFS/S3/...) "
            "so materialised audit tables survive executor loss")
    # setCheckpointDir is idempotent; make sure DataFrame.checkpoint() sees it.
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(d)
    return d


def check_utc(spark: SparkSession) -> None:
    tz = spark.conf.get("spark.sql.session.timeZone")
    if tz not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(
            f"session time zone is {tz!r}; timestamp columns must be cast to dates in UTC "
            "(set spark.sql.session.timeZone=UTC), otherwise same-day bookings can get lead -1")


def scale_conf(rows: int, key_bytes: int = 8, target_partition_bytes: int = 256 << 20,
               scan_partition_bytes: int = 256 << 20) -> dict:
    """Shuffle and scan sizing for an audit over ``rows`` events.

    The largest shuffle of a full audit is the key-only integrity shuffle
    (every other audit shuffles pre-aggregated cohort rows), so the partition
    count is sized from it: rows x (key + count + row overhead) / target size.
    AQE coalesces the tiny cohort shuffles back down at run time.  Every
    map task emits at most one partial row per group (per cube cell), so
    larger scan splits (``scan_partition_bytes``, e.g. 1 GB) mean fewer partial
    rows in each audit shuffle.
    """
    per_row = key_bytes + 8 + 16
    partitions = max(1, -(-rows * per_row // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(scan_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
