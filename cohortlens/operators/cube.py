"""ONE-1: the cohort cube — one scan of the events serves every audit.

Every audit measure except the distinct-key count is a function of counts
per cohort cell.  The cube is one plain aggregate over the events: cohort
keys x entity present x outcome x exact lead day -> ``cnt`` (and the exact
``sum_lead`` = lead x cnt).  Any wall day, day window, curve or metric reads
the same cells; nothing about the lead day is cut off or fixed at build.

The partial aggregate collapses every map task's rows to its cells before
the shuffle; the cells are bounded by key domains x lead days, never by the
row count.  Audits re-aggregate cells: n = sum(cnt); mean lead =
sum(sum_lead) / sum(cnt); rate = sum(cnt where outcome) / sum(cnt) * 100.

Counts are mergeable: cubes of days add up cell by cell, and a day taken back is
its cells counted -1 times (``sinks.cube_store`` keeps such deltas).

Some labels are keys of the cells (age class, level flag).  The cube carries
what they were built with (``build_tag``); reading it with other values is
refused, whether in memory, from a table or from a stream's snapshot.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Optional, Sequence, Tuple

from pyspark.sql import Column, DataFrame, functions as F

from ..config import AuditParams, ColumnMap, WAREHOUSE_COLUMNS, as_list, check_scope
from ..functions.measures import pct, rounded
from ..functions.rules import band_rule, ident, sql_literal, tier_rule
from .cohorts import CurveNames, _order
from .exposure import exposure_dims, with_exposure
from .prepare import qcol

CNT = "cnt"
SUM_LEAD = "sum_lead"
TAG = "cube_build"


@dataclass(frozen=True)
class AuditSpec:
    """A grouped audit: keys, scope, optional outcome filter, output names."""

    name: str
    dims: Tuple[str, ...]
    scope: str = "valid"
    missed_only: bool = False
    volume: Optional[str] = None
    avg: Optional[str] = None
    avg_first: bool = False


def cube_keys(cmap: ColumnMap = WAREHOUSE_COLUMNS, params: AuditParams = AuditParams()) -> Tuple[str, ...]:
    """The cohort keys of the cube (besides entity presence, outcome and lead)."""
    n = params.names
    h, d, a = params.conditions
    return (params.payer, params.gender, d, h, a, params.sms, n.disabled, n.age_class)


def _cell_avg(cond: Optional[Column] = None) -> Column:
    """Exact mean lead from cells: sum(sum_lead) / sum(cnt) over cells with a lead."""
    has = F.col(SUM_LEAD).isNotNull()
    w = has if cond is None else (cond & has)
    return F.try_divide(F.sum(F.when(w, F.col(SUM_LEAD))), F.sum(F.when(w, F.col(CNT))))


def _cell_rate(outcome: Column) -> Column:
    cnt = F.col(CNT)
    return pct(F.sum(F.when(outcome, cnt).otherwise(F.lit(0))), F.sum(cnt))


def build_tag(cmap: ColumnMap = WAREHOUSE_COLUMNS, params: AuditParams = AuditParams()) -> str:
    """What the cells depend on, as text: keys, source columns, and the labels that are keys."""
    n, lb = params.names, params.labels
    return json.dumps({
        "keys": list(cube_keys(cmap, params)), "entity": cmap.entity, "booked_at": cmap.booked_at, "due_at": cmap.due_at,
        "outcome": cmap.outcome, "outcome_values": dict(cmap.outcome_values) if cmap.outcome_values else None,
        "columns": [n.outcome, n.lead, n.entity_present], "age": params.age, "adult_age": params.adult_age,
        "minor": lb["minor"], "adult": lb["adult"], "level": params.level,
    }, sort_keys=True)


class CohortCube:
    """Counts per cohort cell; build once, roll up many times.

    ``tag``: what the cells were built with; None takes the given parameters' word for it."""

    def __init__(self, cells: DataFrame, cmap: ColumnMap, params: AuditParams, tag: Optional[str] = None):
        wanted = build_tag(cmap, params)
        if tag is not None and tag != wanted:
            have, want = json.loads(tag), json.loads(wanted)
            differ = {k: (have.get(k), want.get(k)) for k in sorted(have.keys() | want.keys()) if have.get(k) != want.get(k)}
            raise ValueError(f"the cube was built with other parameters (built, asked): {differ}; rebuild it")
        self.cells = cells
        self.cmap = cmap
        self.params = params
        self.tag = wanted

    # -- build -----------------------------------------------------------
    @classmethod
    def build(
        cls,
        seg_raw: DataFrame,
        cmap: ColumnMap = WAREHOUSE_COLUMNS,
        params: AuditParams = AuditParams(),
    ) -> "CohortCube":
        """From ``segment(prepare(df, scope='raw'))``: one aggregate, lazily."""
        n = params.names
        lead = ident(n.lead)
        ent = f"{ident(cmap.entity)} IS NOT NULL" if cmap.entity else "TRUE"
        keys = [ident(k) for k in cube_keys(cmap, params)]
        cells = (seg_raw.selectExpr(*keys, f"{ent} AS {ident(n.entity_present)}", ident(n.outcome), lead)
                 .groupBy(*keys, ident(n.entity_present), ident(n.outcome), lead)
                 .agg(F.expr(f"count(1) AS {CNT}"))
                 .selectExpr("*", f"CAST({lead} AS BIGINT) * {CNT} AS {SUM_LEAD}"))
        return cls(cells, cmap, params)

    def with_params(self, params: AuditParams) -> "CohortCube":
        """The same cells read with another wall, day window, rate card or labels that are no keys."""
        return CohortCube(self.cells, self.cmap, params, self.tag)

    def save(self, path: str, mode: str = "overwrite") -> None:
        """Write the cells as a table with their build tag, so later jobs roll audits up without
        rescanning the events."""
        self.cells.withColumn(TAG, F.lit(self.tag)).write.mode(mode).parquet(path)

    @classmethod
    def load(cls, spark, path: str, cmap: ColumnMap = WAREHOUSE_COLUMNS,
             params: AuditParams = AuditParams()) -> "CohortCube":
        """A saved cube; refused if any of its cells was built with other parameters."""
        return cls.from_table(spark.read.parquet(path), cmap, params)

    @classmethod
    def from_table(cls, table: DataFrame, cmap: ColumnMap, params: AuditParams) -> "CohortCube":
        low, high = table.agg(F.min(TAG), F.max(TAG)).first()
        if low != high:
            raise ValueError("the table mixes cells of cubes built with different parameters")
        return cls(table.drop(TAG), cmap, params, low)

    def materialize(self) -> "CohortCube":
        """Write the cells to the shared checkpoint folder and read them back from there."""
        from ..sinks.feed import materialize
        return CohortCube(materialize(self.cells), self.cmap, self.params, self.tag)

    # -- scoped cells with derived labels -------------------------------
    def _scope(self, c: DataFrame, lead: str, scope: str) -> DataFrame:
        n = self.params.names
        if scope != "raw":
            c = c.where(F.col(lead) >= 0)
        if scope == "production":
            c = c.where(F.col(n.entity_present))
        return c

    def scoped(self, scope: str = "valid") -> DataFrame:
        """Cells of a scope, with band / tier / has_* columns derived."""
        check_scope(scope)
        return self._labels(self._scope(self.cells, self.params.names.lead, scope))

    def _labels(self, c: DataFrame) -> DataFrame:
        p, n = self.params, self.params.names
        h, d, a = p.conditions
        tier = tier_rule(p).sql()
        return c.selectExpr(
            "*",
            f"{band_rule(p).sql()} AS {ident(n.band)}",
            f"{tier} AS {ident(n.tier)}",
            f"{tier} AS patient_acuity",
            f"CAST({ident(d)} AS INT) AS has_diabetes",
            f"CAST({ident(h)} AS INT) AS has_hypertension",
            f"CAST({ident(a)} AS INT) AS has_alcoholism",
        )

    # -- roll-ups ------------------------------------------------------------
    def summary(self, dims, scope: str = "valid", missed_only: bool = False,
                volume: Optional[str] = None, avg: Optional[str] = None,
                avg_first: bool = False, order: bool = True) -> DataFrame:
        """Same rows as ``cohort_summary`` over the same scope."""
        n = self.params.names
        dims = as_list(dims)
        c = self.scoped(scope)
        if missed_only:
            c = c.where(F.col(n.outcome))
        vol = F.sum(CNT).alias(volume or n.volume)
        mean = rounded(_cell_avg(), self.params.digits).alias(avg or n.avg_lead)
        out = c.groupBy(*[qcol(x) for x in dims]).agg(*([mean, vol] if avg_first else [vol, mean]))
        return _order(out, dims, order)

    def spec(self, s: AuditSpec, order: bool = True) -> DataFrame:
        return self.summary(list(s.dims), s.scope, s.missed_only, s.volume, s.avg, s.avg_first, order)

    def rate_by(self, dims, scope: str = "valid", rate: str = "no_show_rate",
                volume: str = "total_appointments", order: bool = True) -> DataFrame:
        n = self.params.names
        dims = as_list(dims)
        out = self.scoped(scope).groupBy(*[qcol(x) for x in dims]).agg(
            rounded(_cell_rate(F.col(n.outcome)), self.params.digits).alias(rate),
            F.sum(CNT).alias(volume))
        return _order(out, dims, order)

    def curve(self, scope: str = "valid", names: CurveNames = CurveNames(), order: bool = True) -> DataFrame:
        n = self.params.names
        cnt, o = F.col(CNT), F.col(n.outcome)
        dg = self.params.digits
        out = self.scoped(scope).groupBy(F.col(n.lead).alias(names.day)).agg(
            F.sum(cnt).alias(names.total),
            F.coalesce(F.sum(F.when(o, cnt)), F.lit(0)).cast("long").alias(names.missed),
            F.coalesce(F.sum(F.when(~o, cnt)), F.lit(0)).cast("long").alias(names.shown),
        ).withColumns({
            names.missed_pct: rounded(pct(F.col(names.missed), F.col(names.total)), dg),
            names.shown_pct: rounded(pct(F.col(names.shown), F.col(names.total)), dg),
        })
        return _order(out, [names.day], order)

    def scope_report(self) -> DataFrame:
        n = self.params.names
        cnt, lead, ent = F.col(CNT), F.col(n.lead), F.col(n.entity_present)
        valid = lead >= 0

        def s(cond):
            return F.coalesce(F.sum(F.when(cond, cnt)), F.lit(0)).cast("long")

        return self.cells.agg(
            F.coalesce(F.sum(cnt), F.lit(0)).cast("long").alias("raw_rows"),
            s(valid).alias("valid_lead_rows"),
            s(valid & ent).alias("production_rows"),
            s(lead < 0).alias("negative_lead_rows"),
            s(lead.isNull()).alias("null_lead_rows"),
            s(valid & ~ent).alias("null_entity_rows"),
        )

    def exposure(self, dims: Optional[Sequence[str]] = None, scope: str = "production",
                 impact: str = "modeled_revenue_impact", share: str = "pct_of_total_volume",
                 order: bool = True) -> DataFrame:
        p, n = self.params, self.params.names
        dims = exposure_dims(p) if dims is None else as_list(dims)
        groups = self.scoped(scope).groupBy(*[qcol(d) for d in dims]).agg(
            F.sum(CNT).alias(n.volume),
            rounded(_cell_avg(), p.digits).alias(n.avg_lead))
        out = with_exposure(groups, p, impact, share)
        if not order:
            return out
        rest = [d for d in (n.band, n.tier, n.outcome) if d in dims]
        tail = [d for d in dims if d != p.payer and d not in rest]
        return out.orderBy(qcol(p.payer).desc_nulls_last(),
                           *[qcol(d).asc_nulls_first() for d in rest + tail])

    # -- merging ---------------------------------------------------------------
    def times(self, sign: int) -> "CohortCube":
        """The same cells counted ``sign`` times; -1 takes them back when merged."""
        return CohortCube(self.cells.withColumns({CNT: F.col(CNT) * sign, SUM_LEAD: F.col(SUM_LEAD) * sign}),
                          self.cmap, self.params, self.tag)

    @classmethod
    def merge(cls, cubes: Sequence["CohortCube"]) -> "CohortCube":
        """One cube of several: counts add up cell by cell, and cells that come to nothing go."""
        first = cubes[0]
        if any(c.tag != first.tag for c in cubes):
            raise ValueError("cubes built with different parameters cannot be merged")
        return cls(add_cells(reduce(DataFrame.unionByName, [c.cells for c in cubes]), first.cmap, first.params), first.cmap, first.params, first.tag)

    # -- the whole catalogue in one pass over the cells ----------------------
    def grouped_sets(self, specs: Sequence[AuditSpec]) -> DataFrame:
        """Many grouped audits from ONE pass over the cells, by the engine's grouping sets.

        Columns: audit; every key of any audit with its own type (NULL where the audit has not got it); then
        total_patient_volume, total_noshows, avg_lead_time, noshowrate_pct.  Audits with the same keys share a grouping
        set; scopes and outcome filters are FILTERs of its sums."""
        rows, cols = self._sets(specs)
        entries = [f"struct({sql_literal(s.name)} AS audit, {self._figures(s, specs)}, {self._member(s, cols, specs)} AS _in)" for s in specs]
        return (rows.selectExpr(*[ident(c) for c in cols], f"inline(array({', '.join(entries)}))").where("_in")
                .select("audit", *[qcol(c) for c in cols], *[qcol(f) for f in self._figure_names()]))

    def _figure_names(self) -> Tuple[str, ...]:
        n = self.params.names
        return n.volume, "total_noshows", n.avg_lead, "noshowrate_pct"

    @staticmethod
    def _selections(specs: Sequence[AuditSpec]) -> list:
        """The distinct (scope, missed only) of the audits."""
        return list(dict.fromkeys((check_scope(s.scope), s.missed_only) for s in specs))

    def _sets(self, specs: Sequence[AuditSpec]) -> Tuple[DataFrame, list]:
        """(one row per group of every grouping set, the grouping columns)."""
        n = self.params.names
        lead, o, ent = ident(n.lead), ident(n.outcome), ident(n.entity_present)
        cols = list(dict.fromkeys(d for s in specs for d in s.dims))
        sums = []
        for i, (scope, missed) in enumerate(self._selections(specs)):
            conds = ([f"{lead} >= 0"] if scope != "raw" else []) + ([ent] if scope == "production" else []) + ([o] if missed else [])
            w = " AND ".join(conds) or "TRUE"
            sums += [F.expr(f"sum({CNT}) FILTER (WHERE {w}) AS _n{i}"), F.expr(f"sum({CNT}) FILTER (WHERE {w} AND {o}) AS _m{i}"),
                     F.expr(f"sum({SUM_LEAD}) FILTER (WHERE {w}) AS _s{i}"),
                     F.expr(f"sum({CNT}) FILTER (WHERE {w} AND {SUM_LEAD} IS NOT NULL) AS _l{i}")]
        sets = dict.fromkeys(tuple(c for c in cols if c in s.dims) for s in specs)
        rows = (self._labels(self.cells).groupingSets([[qcol(c) for c in x] for x in sets], *[qcol(c) for c in cols])
                .agg(F.grouping_id().alias("_set"), *sums))
        return rows, cols

    def _member(self, s: AuditSpec, cols: Sequence[str], specs: Sequence[AuditSpec]) -> str:
        """SQL: the group belongs to the audit (a bit of the grouping id is 1 where the column is not in the set)."""
        number = sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in s.dims)
        i = self._selections(specs).index((s.scope, s.missed_only))
        return f"_set = {number} AND coalesce(_n{i} > 0, FALSE)"

    def _figures(self, s: AuditSpec, specs: Sequence[AuditSpec]) -> str:
        i, dg = self._selections(specs).index((s.scope, s.missed_only)), self.params.digits
        volume, missed, avg, rate = (ident(x) for x in self._figure_names())
        mean, share = f"try_divide(_s{i}, _l{i})", f"try_divide(coalesce(_m{i}, 0), _n{i}) * CAST(100 AS DOUBLE)"
        if dg is not None:
            mean, share = f"round({mean}, {dg})", f"round({share}, {dg})"
        return f"_n{i} AS {volume}, coalesce(_m{i}, 0) AS {missed}, {mean} AS {avg}, {share} AS {rate}"

    def full_audit(self, specs: Sequence[AuditSpec], order: bool = False) -> DataFrame:
        """``grouped_sets`` in one long form: audit, key_1.. as text (the audit's keys in its own order), the figures."""
        rows, cols = self._sets(specs)
        width = max(len(s.dims) for s in specs)
        entries = []
        for s in specs:
            keys = [f"CAST({ident(d)} AS STRING)" for d in s.dims] + ["CAST(NULL AS STRING)"] * (width - len(s.dims))
            keys = ", ".join(f"{k} AS key_{i + 1}" for i, k in enumerate(keys))
            entries.append(f"struct({sql_literal(s.name)} AS audit, {keys}, {self._figures(s, specs)}, {self._member(s, cols, specs)} AS _in)")
        out = rows.selectExpr(f"inline(array({', '.join(entries)}))").where("_in").drop("_in")
        if order:
            out = out.orderBy("audit", *[F.col(f"key_{i + 1}").asc_nulls_first() for i in range(width)])
        return out


def add_cells(cells: DataFrame, cmap: ColumnMap, params: AuditParams) -> DataFrame:
    """Cells of several cubes (signed counts) added up; cells that come to nothing go."""
    n = params.names
    keys = [*cube_keys(cmap, params), n.entity_present, n.outcome, n.lead]
    return (cells.groupBy(*[qcol(k) for k in keys]).agg(F.sum(CNT).alias(CNT)).where(f"{CNT} <> 0")
            .withColumn(SUM_LEAD, qcol(n.lead).cast("bigint") * F.col(CNT)))
