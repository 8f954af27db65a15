"""Sinks for audit results.

Catalogue outputs arrive in one partition already (ordered audits are
sorted in a single partition; global aggregates are one row), so they land
as one file without help.  ``files=n`` asks for n files through
``repartition(n)`` — a shuffle of the output rows only.  ``coalesce`` is
never used: it is narrow and would pull the upstream final aggregate (or an
unbounded result such as the duplicate-key list) into n tasks.
``materialize`` cuts lineage through the shared checkpoint folder the
session names, never through executor-local storage.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import DataFrame

from ..session import require_checkpoint_dir


def write_feed(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: Optional[Sequence[str]] = None,
    files: Optional[int] = None,
    **options,
) -> None:
    out = df.repartition(files) if files else df
    w = out.write.mode(mode).format(fmt).options(**options)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def save_table(
    df: DataFrame,
    name: str,
    mode: str = "overwrite",
    files: Optional[int] = None,
    bucket_by: Optional[Sequence[str]] = None,
    buckets: int = 0,
) -> None:
    """Save as a catalog table.  With ``bucket_by``/``buckets`` (an events table
    keyed by its id), later group-bys and joins on that key read co-located
    buckets and need no shuffle — e.g. the integrity check.

    A bucket is read by one task, so a key that holds a large share of the
    rows makes that task large; for such data read the table with
    ``spark.sql.sources.bucketing.enabled=false`` and let the map-side partial
    aggregate spread the hot key over every scan task instead."""
    if bucket_by:
        if buckets <= 0:
            raise ValueError("bucket_by needs a positive bucket count")
        (df.write.mode(mode).bucketBy(buckets, *bucket_by).sortBy(*bucket_by).saveAsTable(name))
        return
    (df.repartition(files) if files else df).write.mode(mode).saveAsTable(name)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into ``spark.checkpoint.dir`` (survives executor loss)."""
    require_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
