"""Cohort aggregates: AUD-1…8, AUD-5A curve, AUD-5A-b contrast, the ``-b`` findings.

Every grouped audit is ``groupBy(keys).agg(...)``: Spark plans a map-side
partial aggregate, so the shuffle carries (groups x map tasks) rows no matter
how many rows a hot cohort holds.  Single-cohort figures are conditional
aggregates in one ``agg`` — one pass, one row, nothing collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional, Sequence, Tuple, Union

from pyspark.sql import Column, DataFrame, functions as F

from ..config import AuditParams, as_list
from ..functions.rules import ident, sql_literal
from .metrics import Metric, evaluate
from .prepare import qcol

Dims = Union[str, Sequence[str]]


Order = Union[bool, str]


def _order(df: DataFrame, dims: Sequence[str], order: Order) -> DataFrame:
    """Ascending on every key, NULLs first (Spark's ascending default).

    ``True``/``"global"``: a global sort (range-partitioned; right for any
    size).  ``"single"``: gather the rows into one partition and sort there —
    no range-sampling job, for outputs bounded by key domains (a few hundred
    cohorts), never for per-entity results.
    """
    if not order or not dims:
        return df
    keys = [ident(d) for d in dims]
    if order == "single":
        return df.repartition(1).sortWithinPartitions(*keys)
    return df.orderBy(*keys)


def _round_sql(expr: str, digits: Optional[int]) -> str:
    return expr if digits is None else f"round({expr}, {int(digits)})"


def cohort_summary(
    df: DataFrame,
    dims: Dims,
    params: AuditParams = AuditParams(),
    volume: Optional[str] = None,
    avg: Optional[str] = None,
    digits: Optional[int] = None,
    order: Order = True,
    avg_first: bool = False,
    drop_null_keys: bool = False,
    count_of: Optional[str] = None,
) -> DataFrame:
    """Per cohort: row count (``COUNT(*)``) and mean lead time rounded to 1 dp.

    NULL keys form their own cohort (SQL rule); ``drop_null_keys=True`` drops
    them instead (the dataframe-library rule).  ``count_of`` counts the
    non-NULL values of one column instead of rows.  ``avg_first`` puts the
    mean before the count, as the condition-combination audit does.
    """
    n = params.names
    dims = as_list(dims)
    digits = params.digits if digits is None else digits
    if drop_null_keys and dims:
        df = df.where(" AND ".join(f"{ident(d)} IS NOT NULL" for d in dims))
    counted = "1" if count_of is None else ident(count_of)
    cnt = F.expr(f"count({counted}) AS {ident(volume or n.volume)}")
    mean = F.expr(f"{_round_sql(f'avg({ident(n.lead)})', digits)} AS {ident(avg or n.avg_lead)}")
    measures = [mean, cnt] if avg_first else [cnt, mean]
    out = df.groupBy(*[ident(d) for d in dims]).agg(*measures)
    return _order(out, dims, order)


def rate_by(
    df: DataFrame,
    dims: Dims,
    params: AuditParams = AuditParams(),
    rate: str = "no_show_rate",
    volume: str = "total_appointments",
    digits: Optional[int] = None,
    order: Order = True,
) -> DataFrame:
    """AUD-6A: outcome rate (%) per cohort, then the cohort size.

    A NULL outcome counts as a row but not as a miss, like
    ``AVG(CASE WHEN missed = 1 THEN 1.0 ELSE 0 END)``; the mean is taken in
    DOUBLE, so no decimal truncation happens before the final rounding.
    """
    dims = as_list(dims)
    digits = params.digits if digits is None else digits
    o = ident(params.names.outcome)
    mean = f"avg(CASE WHEN {o} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * CAST(100 AS DOUBLE)"
    out = df.groupBy(*[ident(d) for d in dims]).agg(
        F.expr(f"{_round_sql(mean, digits)} AS {ident(rate)}"),
        F.expr(f"count(1) AS {ident(volume)}"),
    )
    return _order(out, dims, order)


@dataclass(frozen=True)
class CurveNames:
    day: str = "lead_time_day"
    total: str = "total_appointments"
    missed: str = "total_noshows"
    shown: str = "total_shows"
    missed_pct: str = "noshowrate_pct"
    shown_pct: str = "show_rate_pct"


def rate_curve(
    df: DataFrame,
    params: AuditParams = AuditParams(),
    bucket: Optional[str] = None,
    names: CurveNames = CurveNames(),
    digits: Optional[int] = None,
    order: Order = True,
    shows: str = "countif",
) -> DataFrame:
    """AUD-5A: per lead day — rows, misses, shows, and both rates (n / d * 100, 1 dp).

    ``shows='countif'`` counts ``outcome = FALSE``, so a NULL outcome is in
    neither count (SQL rule); ``shows='complement'`` takes rows - misses, so a
    NULL outcome counts as shown (the subtraction variant).
    """
    bucket = bucket or params.names.lead
    digits = params.digits if digits is None else digits
    o = ident(params.names.outcome)
    if shows not in ("countif", "complement"):
        raise ValueError("shows must be 'countif' or 'complement'")
    shown = f"count_if(NOT {o})" if shows == "countif" else f"count(1) - count_if({o})"
    out = (df.groupBy(F.expr(f"{ident(bucket)} AS {ident(names.day)}"))
             .agg(F.expr(f"count(1) AS {ident(names.total)}"),
                  F.expr(f"count_if({o}) AS {ident(names.missed)}"),
                  F.expr(f"{shown} AS {ident(names.shown)}")))

    def rate(num: str) -> str:  # n / d * 100, the audit's order; NULL if d = 0
        return _round_sql(f"try_divide({ident(num)}, {ident(names.total)}) * CAST(100 AS DOUBLE)", digits)

    out = out.selectExpr("*", f"{rate(names.missed)} AS {ident(names.missed_pct)}",
                         f"{rate(names.shown)} AS {ident(names.shown_pct)}")
    return _order(out, [names.day], order)


def threshold_contrast(
    curve: DataFrame,
    params: AuditParams = AuditParams(),
    names: CurveNames = CurveNames(),
    weighted: bool = False,
    digits: Optional[int] = None,
) -> DataFrame:
    """AUD-5A-b: mean rate before and after the wall, the lift, and the wall-day rate.

    Default = unweighted mean of the already rounded daily rates over the
    ``pre`` and ``post`` day windows (both inclusive; day 0 falls in
    neither).  ``weighted=True`` pools the counts instead.
    """
    day, rate = ident(names.day), ident(names.missed_pct)
    pre = f"{day} BETWEEN {int(params.pre[0])} AND {int(params.pre[1])}"
    post = f"{day} BETWEEN {int(params.post[0])} AND {int(params.post[1])}"
    if weighted:  # pooled counts: misses / rows in the window
        m, t = ident(names.missed), ident(names.total)

        def mean(w):
            return f"try_divide(sum(CASE WHEN {w} THEN {m} END), sum(CASE WHEN {w} THEN {t} END)) * CAST(100 AS DOUBLE)"
    else:  # unweighted mean of the daily (already rounded) rates
        def mean(w):
            return f"avg(CASE WHEN {w} THEN {rate} END)"
    out = curve.agg(
        F.expr(f"{mean(pre)} AS pre_wall_rate"),
        F.expr(f"{mean(post)} AS post_wall_rate"),
        F.expr(f"max(CASE WHEN {day} = {int(params.wall)} THEN {rate} END) AS wall_day_rate"),
    )
    r = (lambda e: e) if digits is None else (lambda e: f"round({e}, {int(digits)})")
    return out.selectExpr(f"{r('pre_wall_rate')} AS pre_wall_rate", f"{r('post_wall_rate')} AS post_wall_rate",
                          f"{r('post_wall_rate - pre_wall_rate')} AS lift", f"{r('wall_day_rate')} AS wall_day_rate")


def cohort_metric(
    df: DataFrame,
    where: str,
    params: AuditParams = AuditParams(),
    prefix: str = "cohort",
    digits: Optional[int] = None,
    cells: bool = False,
) -> DataFrame:
    """One cohort's size, misses and miss rate (%), one row; NULL rate if empty.

    ``where`` is a SQL condition; ``cells=True`` evaluates over cube cells.
    """
    o = ident(params.names.outcome)
    ms = [Metric(f"{prefix}_total", "count", where),
          Metric(f"{prefix}_noshows", "count", f"({where}) AND {o}"),
          Metric(f"{prefix}_rate", "rate", where, digits)]
    wide = evaluate(df, ms, params, cells)
    return wide.selectExpr(*[f"_m{i} AS {ident(m.label)}" for i, m in enumerate(ms)])


@dataclass(frozen=True)
class Gap:
    """Two figures of one audit compared: ``gap = a - b``, ``gap_pct = gap / b * 100``."""

    label: str
    a: Metric
    b: Metric


def cohort_gaps(df: DataFrame, gaps: Sequence[Gap], digits: Optional[int] = None,
                params: AuditParams = AuditParams(), cells: bool = False) -> DataFrame:
    """All gaps from ONE aggregate pass, returned long: label, a, b, gap, gap_pct."""
    ms = [m for g in gaps for m in (g.a, g.b)]
    wide = evaluate(df, ms, params, cells)
    rows = ", ".join(f"struct({sql_literal(g.label)} AS label, _m{2 * i} AS a, _m{2 * i + 1} AS b)"
                     for i, g in enumerate(gaps))
    long = wide.selectExpr(f"inline(array({rows}))")
    r = (lambda e: e) if digits is None else (lambda e: f"round({e}, {int(digits)})")
    return long.selectExpr("label", f"{r('a')} AS a", f"{r('b')} AS b", f"{r('a - b')} AS gap",
                           f"{r('try_divide(a - b, b) * CAST(100 AS DOUBLE)')} AS gap_pct")


def reference_gaps(params: AuditParams = AuditParams()) -> Tuple[Gap, ...]:
    """The audit's published comparisons (AUD-4A-b, 6A-b, 6b, 7b, 8b) over a V-scope frame.

    Figures read from rounded audit tables are rounded to 1 dp first, as there.
    """
    n = params.names
    o = ident(n.outcome)
    h, d, a = (ident(c) for c in params.conditions)
    sms, dis, age = ident(params.sms), ident(n.disabled), ident(n.age_class)
    dg = params.digits

    def missed_lead(label, cond):
        return Metric(label, "mean_lead", f"{o} AND {cond}", dg)

    return (
        Gap("condition_compression",
            missed_lead("no_conditions", f"{d} = 0 AND {h} = 0 AND {a} = 0"),
            missed_lead("all_conditions", f"{d} = 1 AND {h} = 1 AND {a} = 1")),
        Gap("reminder_penalty", Metric("sms_rate", "rate", f"{sms} = 1", dg),
            Metric("no_sms_rate", "rate", f"{sms} = 0", dg)),
        Gap("reminded_missed_lead_vs_wall", missed_lead("sms_missed_lead", f"{sms} = 1"),
            Metric("wall", "const", value=float(params.wall))),
        Gap("disability_compression", missed_lead("not_disabled", f"{dis} = 0"),
            missed_lead("disabled", f"{dis} = 1")),
        Gap("advocacy_gap",
            Metric("minor_rate", "rate", f"{age} = {sql_literal(params.labels['minor'])}"),
            Metric("adult_rate", "rate", f"{age} = {sql_literal(params.labels['adult'])}")),
    )


def share_of(df: DataFrame, where: str, name: str = "pct_of_volume",
             params: AuditParams = AuditParams(), cells: bool = False) -> DataFrame:
    """AUD-7b: one cohort's share of all rows in % (mean of a 0/1 flag x 100)."""
    ms = [Metric("cohort_rows", "count", where), Metric("total_rows", "count"),
          Metric(name, "share", where)]
    wide = evaluate(df, ms, params, cells)
    return wide.selectExpr("_m0 AS cohort_rows", "_m1 AS total_rows", f"_m2 AS {ident(name)}")


def pick(
    result: DataFrame,
    where: Union[Column, str, dict],
    column: str,
    how: str = "one",
    name: Optional[str] = None,
) -> DataFrame:
    """Read cells of a result table as a one-row DataFrame (no collect).

    ``where`` is a condition or a ``{column: value}`` conjunction of equalities.
    ``how='one'``: the value of the single matching row (NULL when none
    matches — where a positional read would raise); ``how='sum'``: the sum over
    matching rows (0 when none match).
    """
    if isinstance(where, dict):
        cond = None
        for k, v in where.items():
            c = qcol(k).isNull() if v is None else (qcol(k) == F.lit(v))
            cond = c if cond is None else (cond & c)
    else:
        cond = F.expr(where) if isinstance(where, str) else where
    val = F.when(cond, qcol(column))
    if how == "one":
        agg = F.max(val)
    elif how == "sum":
        agg = F.coalesce(F.sum(val), F.lit(0))
    else:
        raise ValueError("how must be 'one' or 'sum'")
    return result.agg(agg.alias(name or column))
