"""SRC-1 / FLT-1 pruning: events stored by lead day, so that a window of days reads only its files.

The lead day is computed from two columns, so ``lead_time >= 0`` can never reach
a plain scan.  Stored once as a column, clustered by it and split into parts of
some days each, it can: the parts are partitions (pruned before any file is
opened) and inside them the rows are sorted, so Parquet's statistics skip row
groups.  A day that holds a third of all rows spreads over files by a hash of
the key.
"""

from __future__ import annotations

import json
from typing import Optional

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import AuditParams, ColumnMap, WAREHOUSE_COLUMNS
from ..functions.rules import ident
from ..operators.prepare import prepare, qcol
from ..plans.audit import Audit
from ..sinks.atomic import read_text, write_once

LEAD, PART = "stored_lead_day", "stored_lead_part"


def write_layout(events: DataFrame, path: str, cmap: ColumnMap = WAREHOUSE_COLUMNS, params: AuditParams = AuditParams(),
                 days: int = 10, files: Optional[int] = None) -> None:
    """Store the events by lead day, ``days`` to a part (negative leads together, rows without a lead too).

    ``files``: about how many files in all (default: the session's shuffle partitions)."""
    clash = {LEAD, PART} & set(events.columns)
    if clash:
        raise ValueError(f"the events have columns named {sorted(clash)} already")
    row = F.struct(*[qcol(c) for c in events.columns]).alias("_row")
    n = params.names
    # prepare() gives the very lead that the audits compute later, zone checks included.
    lead = prepare(events.select("*", row), cmap.with_(attributes=(*cmap.attributes, "_row")), "raw", params)
    part = F.when(qcol(n.lead) < 0, -1).otherwise(F.floor(qcol(n.lead) / days)).cast("int")
    rows = lead.select("_row.*", qcol(n.lead).alias(LEAD), part.alias(PART))
    keys = [PART, LEAD, F.xxhash64(qcol(cmap.key))]
    spread = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    spread.sortWithinPartitions(PART, LEAD).write.partitionBy(PART).parquet(path)
    write_once(events.sparkSession, f"{path.rstrip('/')}/_LAYOUT",
               json.dumps({"days": days, "booked_at": cmap.booked_at, "due_at": cmap.due_at, "schema": json.loads(rows.schema.json())}))


def _layout(spark: SparkSession, path: str) -> dict:
    text = read_text(spark, f"{path.rstrip('/')}/_LAYOUT")
    if text is None:
        raise FileNotFoundError(f"{path} is no complete layout")
    return json.loads(text)


def read_layout(spark: SparkSession, path: str, low: Optional[int] = None, high: Optional[int] = None) -> DataFrame:
    """The stored events with a lead day from ``low`` to ``high`` (inclusive; rows without a lead only if neither is given)."""
    from pyspark.sql.types import StructType
    layout = _layout(spark, path)
    rows = spark.read.schema(StructType.fromJson(layout["schema"])).parquet(path)
    for bound, sign in ((low, ">="), (high, "<=")):
        if bound is not None:
            part = -1 if bound < 0 else bound // layout["days"]
            rows = rows.where(f"{ident(PART)} {sign} {part} AND {ident(LEAD)} {sign} {int(bound)}")
    return rows.drop(LEAD, PART)


class LayoutAudit(Audit):
    """The audits over a stored layout: those of valid leads skip the others' files.

    ``low`` / ``high``: a window of lead days for all audits."""

    def __init__(self, spark: SparkSession, path: str, cmap: ColumnMap = WAREHOUSE_COLUMNS, params: AuditParams = AuditParams(),
                 order=True, low: Optional[int] = None, high: Optional[int] = None):
        layout = _layout(spark, path)
        if (layout["booked_at"], layout["due_at"]) != (cmap.booked_at, cmap.due_at):
            raise ValueError(f"the layout's lead day comes from {layout['booked_at']} and {layout['due_at']}")
        super().__init__(read_layout(spark, path, low, high), cmap, params, order)
        self._valid = read_layout(spark, path, max(0, low or 0), high)

    def events_of(self, scope: str) -> DataFrame:
        return self.events if scope == "raw" else self._valid
