"""Single figures defined once, evaluated over event rows or over cube cells.

A ``Metric`` is a kind of measure over the rows matching a SQL condition:

* ``count``      rows matching;
* ``mean_lead``  mean lead time of the rows matching;
* ``rate``       outcome rate (%) among the rows matching (n / d * 100);
* ``share``      rows matching as a % of all rows in scope;
* ``const``      a fixed value (e.g. the wall day a figure is compared with).

``row_sql`` translates it to an aggregate over event rows; ``cell_sql`` to
the same aggregate over cube cells (``cnt``, ``sum_lead``), where counts
become sums of ``cnt`` — exact integers, so both give identical doubles.
Conditions may use any cohort key, label or the lead day.
All metrics of a list are evaluated in ONE aggregate pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional, Sequence

from pyspark.sql import DataFrame, functions as F

from ..config import AuditParams
from ..functions.rules import ident, sql_literal

KINDS = ("count", "mean_lead", "rate", "share", "const")


@dataclass(frozen=True)
class Metric:
    label: str
    kind: str
    where: Optional[str] = None
    digits: Optional[int] = None
    value: Optional[float] = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"metric kind must be one of {KINDS}")


def _round(expr: str, digits: Optional[int]) -> str:
    return expr if digits is None else f"round({expr}, {int(digits)})"


def _and(*conds: Optional[str]) -> str:
    parts = [f"({c})" for c in conds if c]
    return " AND ".join(parts) if parts else "TRUE"


def row_sql(m: Metric, params: AuditParams = AuditParams()) -> str:
    lead, o = ident(params.names.lead), ident(params.names.outcome)
    w = _and(m.where)
    if m.kind == "count":
        e = "count(1)" if m.where is None else f"count_if({w})"
    elif m.kind == "mean_lead":
        e = f"avg(CASE WHEN {w} THEN {lead} END)"
    elif m.kind == "rate":
        e = f"try_divide(count_if({_and(m.where, o)}), count_if({w})) * CAST(100 AS DOUBLE)"
    elif m.kind == "share":
        e = f"try_divide(count_if({w}), count(1)) * CAST(100 AS DOUBLE)"
    else:
        e = f"CAST({sql_literal(float(m.value))} AS DOUBLE)"
    return _round(e, m.digits)


def cell_sql(m: Metric, params: AuditParams = AuditParams(), cnt: str = "cnt", sum_lead: str = "sum_lead") -> str:
    o = ident(params.names.outcome)
    w = _and(m.where)

    def total(cond: str) -> str:
        return f"coalesce(sum(CASE WHEN {cond} THEN {cnt} END), 0)"

    if m.kind == "count":
        e = total(w)
    elif m.kind == "mean_lead":
        e = (f"try_divide(sum(CASE WHEN {w} THEN {sum_lead} END), "
             f"sum(CASE WHEN {_and(w, f'{sum_lead} IS NOT NULL')} THEN {cnt} END))")
    elif m.kind == "rate":
        e = f"try_divide({total(_and(w, o))}, {total(w)}) * CAST(100 AS DOUBLE)"
    elif m.kind == "share":
        e = f"try_divide({total(w)}, {total('TRUE')}) * CAST(100 AS DOUBLE)"
    else:
        e = f"CAST({sql_literal(float(m.value))} AS DOUBLE)"
    return _round(e, m.digits)


def partial_sql(m: Metric, i: int, params: AuditParams = AuditParams()) -> tuple:
    """(partials, final): row aggregates [(alias, SQL)] whose sums over any groups give the metric by the SQL ``final``.

    All partials are counts and sums of integers, so the figure does not depend on how the rows are grouped."""
    lead, o = ident(params.names.lead), ident(params.names.outcome)
    w = _and(m.where)
    a, b = f"_p{i}a", f"_p{i}b"
    if m.kind == "const":
        return [], row_sql(m, params)
    if m.kind == "count":
        parts, e = [(a, f"count_if({w})")], a
    elif m.kind == "mean_lead":
        parts, e = [(a, f"sum(CASE WHEN {w} THEN {lead} END)"), (b, f"count(CASE WHEN {w} THEN {lead} END)")], f"try_divide({a}, {b})"
    elif m.kind == "rate":
        parts, e = [(a, f"count_if({_and(m.where, o)})"), (b, f"count_if({w})")], f"try_divide({a}, {b}) * CAST(100 AS DOUBLE)"
    else:
        parts, e = [(a, f"count_if({w})"), (b, "count(1)")], f"try_divide({a}, {b}) * CAST(100 AS DOUBLE)"
    return parts, _round(e, m.digits)


def evaluate(df: DataFrame, metrics: Sequence[Metric], params: AuditParams = AuditParams(),
             cells: bool = False) -> DataFrame:
    """One row, one column ``_m<i>`` per metric (counts BIGINT, the rest DOUBLE), one aggregate."""
    tr = cell_sql if cells else row_sql

    def typed(m: Metric) -> str:
        return "BIGINT" if m.kind == "count" else "DOUBLE"

    return df.agg(*[F.expr(f"CAST({tr(m, params)} AS {typed(m)}) AS _m{i}") for i, m in enumerate(metrics)])


def metrics_long(df: DataFrame, metrics: Sequence[Metric], params: AuditParams = AuditParams(),
                 cells: bool = False) -> DataFrame:
    """(label, actual) rows for the metrics, from one aggregate pass."""
    wide = evaluate(df, metrics, params, cells)
    rows = ", ".join(f"struct({sql_literal(m.label)} AS label, CAST(_m{i} AS DOUBLE) AS actual)"
                     for i, m in enumerate(metrics))
    return wide.selectExpr(f"inline(array({rows}))")


def reference_checkpoint_metrics(params: AuditParams = AuditParams()) -> Sequence[Metric]:
    """The published checkpoints except the distinct-key count, over a raw-scope frame."""
    from ..config import REFERENCE_CHECKPOINTS
    n = params.names
    lead, o = ident(n.lead), ident(n.outcome)
    valid = f"{lead} >= 0"
    h, d, a = (ident(c) for c in params.conditions)
    sms, dis, age = ident(params.sms), ident(n.disabled), ident(n.age_class)
    dg = params.digits
    lb = [lbl for lbl, _, _ in REFERENCE_CHECKPOINTS]

    def missed_lead(label, cond):
        return Metric(label, "mean_lead", _and(valid, o, cond), dg)

    return (
        Metric(lb[0], "count"),
        Metric(lb[2], "count", valid),
        missed_lead(lb[3], f"{d} = 1 AND {h} = 1 AND {a} = 1"),
        missed_lead(lb[4], f"{d} = 0 AND {h} = 0 AND {a} = 0"),
        Metric(lb[5], "rate", _and(valid, f"{lead} = {int(params.wall)}"), dg),
        Metric(lb[6], "rate", _and(valid, f"{sms} = 1"), dg),
        Metric(lb[7], "rate", _and(valid, f"{sms} = 0"), dg),
        missed_lead(lb[8], f"{sms} = 1"),
        missed_lead(lb[9], f"{dis} = 1"),
        missed_lead(lb[10], f"{dis} = 0"),
        Metric(lb[11], "rate", _and(valid, f"{age} = {sql_literal(params.labels['minor'])}")),
        Metric(lb[12], "rate", _and(valid, f"{age} = {sql_literal(params.labels['adult'])}")),
    )
