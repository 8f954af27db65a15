"""BASE: project, normalise and scope an events table (one narrow stage)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, TimestampType

from ..config import AuditParams, ColumnMap, WAREHOUSE_COLUMNS, check_scope
from ..functions.dates import lead_days_sql, to_utc_date_sql
from ..functions.outcome import outcome_flag_sql
from ..functions.rules import ident
from ..session import check_utc


def qcol(name: str) -> Column:
    """Column by exact name; backticks keep names such as ``No-show`` literal."""
    return F.col("`" + name.replace("`", "``") + "`")


def prepare(
    df: DataFrame,
    cmap: ColumnMap = WAREHOUSE_COLUMNS,
    scope: str = "valid",
    params: AuditParams = AuditParams(),
) -> DataFrame:
    """Clean + feature base.

    Output: key, entity, attributes, ``no_show_status`` (BOOLEAN, NULL when the
    outcome is missing or unmapped), ``scheduled_date``, ``appointment_date``,
    ``lead_time`` (INT days).  ``scope`` keeps all rows (``raw``), rows with
    ``lead_time >= 0`` (``valid``) or those that also have an entity key
    (``production``).
    """
    check_scope(scope)
    n = params.names
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in (cmap.booked_at, cmap.due_at):
        if c not in types:
            raise ValueError(f"column {c!r} not in input {list(types)}")
        if isinstance(types[c], (TimestampType, StringType)):
            # zoned timestamps (and ISO text parsed into them): the calendar date
            # depends on the session zone
            check_utc(df.sparkSession)
    booked = to_utc_date_sql(ident(cmap.booked_at), types[cmap.booked_at])
    due = to_utc_date_sql(ident(cmap.due_at), types[cmap.due_at])
    cols = [ident(cmap.key)]
    if cmap.entity:
        cols.append(ident(cmap.entity))
    absent = [a for a in cmap.attributes if a not in types]
    if absent:
        raise ValueError(f"attributes {absent} are not in the input {list(types)}")
    cols += [ident(a) for a in cmap.attributes]
    cols += [
        f"{outcome_flag_sql(ident(cmap.outcome), cmap.outcome_values)} AS {ident(n.outcome)}",
        f"{booked} AS {ident(n.booked_date)}",
        f"{due} AS {ident(n.due_date)}",
        f"{lead_days_sql(due, booked)} AS {ident(n.lead)}",
    ]
    out = df.selectExpr(*cols)
    conds = []
    if scope != "raw":
        conds.append(f"{ident(n.lead)} >= 0")
    if scope == "production":
        if not cmap.entity:
            raise ValueError("production scope needs an entity column")
        conds.append(f"{ident(cmap.entity)} IS NOT NULL")
    return out.where(" AND ".join(conds)) if conds else out


def has_flags(params: AuditParams = AuditParams()) -> dict:
    """Condition flags as 0/1 INT columns ``has_<condition>`` (enriched-table shape)."""
    h, d, a = params.conditions
    return {
        "has_diabetes": F.expr(f"CAST({ident(d)} AS INT)"),
        "has_hypertension": F.expr(f"CAST({ident(h)} AS INT)"),
        "has_alcoholism": F.expr(f"CAST({ident(a)} AS INT)"),
    }

