"""Run audits over an events extract and write each result as a table.

    python -m cohortlens --events /data/appointments.csv --format csv \\
        --out /data/audit/ --audits all
    spark-submit --py-files cohortlens.zip run_audit.py --events s3://bucket/events/ --out s3://bucket/audit/

``--format csv`` reads the extract with its explicit types (outcome as Yes/No
text) in one pass; rows with a value that cannot be read go to ``<out>/rejects``
and count in no audit, and more than ``--max-rejects`` of them end the run; parquet / orc / table inputs use the warehouse layout
(boolean ``No-show``).  The cohort cube is built once (one scan), materialised
into ``spark.checkpoint.dir``, and serves every audit it can; ``--direct``
scans the events for each audit instead.  The audits that need the key column
(integrity, duplicates, the scorecard's distinct count) share one pass of key
counts, of which only the totals and the repeated keys are written.  Each audit
goes to ``<out>/<name>``; the scorecard is also printed.

``--one-job`` writes all audits in one job instead, as one table split by audit
under ``<out>/runs/``, and publishes them together by the pointer
``<out>/_LATEST`` (read them with ``sinks.publish.Published``).  The scope and
outcome reports are counted on the pass that writes the cube.

``--rows N`` sizes the shuffle partitions and scan splits for about N events.
"""

from __future__ import annotations

import argparse
import uuid
from typing import List, Optional

from pyspark.sql import DataFrame, SparkSession

from .config import CSV_COLUMNS, WAREHOUSE_COLUMNS, AuditParams
from .session import require_checkpoint_dir, scale_conf
from .plans.audit import CUBE_SERVED, SPEC_BY_NAME, Audit, cube_audit, publish_cube
from .sinks.feed import write_feed
from .sinks.publish import Published
from .sources.csv_load import load_csv
from .sources.events import REFERENCE_CSV_TYPES, read_events

ALL_AUDITS = ("integrity", "duplicates", "outcome_report") + tuple(SPEC_BY_NAME) + (
    "reminder_rate", "lead_day_curve", "wall_contrast", "scope_report", "exposure_summary",
    "fiscal_leak", "beyond_wall", "disabled_share", "cohort_gaps", "cohort_volume", "scorecard")


def parse(argv: Optional[List[str]] = None) -> argparse.Namespace:
    ap = argparse.ArgumentParser(prog="cohortlens", description=__doc__.split("\n\n")[0])
    ap.add_argument("--events", required=True, help="path (or table name with --format table)")
    ap.add_argument("--format", default="parquet", choices=["parquet", "orc", "csv", "table"])
    ap.add_argument("--out", required=True, help="folder for one table per audit")
    ap.add_argument("--audits", default="all", help="comma-separated names, or 'all'")
    ap.add_argument("--cube", action="store_true", help="serve audits from one materialised cube (the default)")
    ap.add_argument("--direct", action="store_true", help="scan the events for each audit instead")
    ap.add_argument("--rows", type=int, default=0, help="expected number of events, to size shuffles and scans")
    ap.add_argument("--save-cube", default=None, help="also keep the cube cells as a table here")
    ap.add_argument("--feed-format", default="parquet", choices=["parquet", "csv", "orc"])
    ap.add_argument("--one-job", action="store_true",
                    help="write all audits of the cube in one job, split by audit, and publish them by one pointer")
    ap.add_argument("--max-rejects", type=float, default=0.01, help="share of CSV rows that may be rejected before the run fails")
    ap.add_argument("--wall", type=int, default=AuditParams().wall)
    return ap.parse_args(argv)


def main(argv: Optional[List[str]] = None, spark: Optional[SparkSession] = None) -> List[str]:
    args = parse(argv)
    spark = spark or SparkSession.builder.appName("cohortlens").getOrCreate()
    # dates of zoned timestamps are taken in UTC; prepare() refuses any other zone
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for key, value in (scale_conf(args.rows) if args.rows else {}).items():
        spark.conf.set(key, value)
    if args.format == "csv":
        staged = f"{require_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
        loaded = load_csv(spark, args.events, REFERENCE_CSV_TYPES, staged, CSV_COLUMNS.key, max_reject_share=args.max_rejects)
        write_feed(loaded.rejects, f"{args.out.rstrip('/')}/rejects", args.feed_format)
        print(f"{loaded.rejected_rows} of {loaded.total_rows} rows rejected")
        events, cmap = loaded.rows, CSV_COLUMNS
    else:
        events = read_events(spark, args.events, args.format)
        cmap = WAREHOUSE_COLUMNS
    params = AuditParams(wall=args.wall)
    audit = Audit(events, cmap, params)
    names = list(ALL_AUDITS) if args.audits == "all" else [a.strip() for a in args.audits.split(",")]
    unknown = sorted(set(names) - set(ALL_AUDITS))
    if unknown:
        raise SystemExit(f"unknown audits {unknown}; known: {', '.join(ALL_AUDITS)}")
    cube, reports = audit.observed_cube() if (args.save_cube or not args.direct) else (None, {})
    if args.save_cube:
        cube.save(args.save_cube)
    out = args.out.rstrip("/")
    keys = audit.key_pass() if {"integrity", "duplicates", "scorecard"} & set(names) and not args.direct else None
    def table(name: str) -> DataFrame:
        if keys is not None and name in ("integrity", "duplicates"):
            return keys.integrity() if name == "integrity" else keys.duplicates()
        if name in reports and not args.direct:
            return reports[name]
        if cube is not None and not args.direct and name in CUBE_SERVED:
            return cube_audit(cube, name)
        return audit.scorecard(cube=None if args.direct else cube, keys=keys) if name == "scorecard" else audit.run(name)

    if args.one_job:
        if args.direct or args.feed_format != "parquet":
            raise SystemExit("--one-job writes the cube's audits as parquet")
        publish_cube(cube, out, {name: table(name) for name in names if name not in CUBE_SERVED or name in reports})
        scorecard = Published(spark, out).table("scorecard") if "scorecard" in names else None
    else:
        for name in names:
            write_feed(table(name), f"{out}/{name}", args.feed_format)
        scorecard = (spark.read.format(args.feed_format).option("header", "true").load(f"{out}/scorecard")
                     if "scorecard" in names else None)
    if scorecard is not None:
        scorecard.show(scorecard.count(), truncate=False)
    return names


if __name__ == "__main__":
    main()
