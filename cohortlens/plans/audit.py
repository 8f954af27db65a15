"""The audit catalogue: every published audit as a named lazy DataFrame.

``Audit(events).run(name)`` picks one output without executing the others
(SNK-2); ``Audit(events).cube()`` serves all grouped audits from one scan
(ONE-1).  Each method only composes operators — Catalyst prunes the scan to
the columns a given audit needs.
"""

from __future__ import annotations

from typing import Callable, Dict, Optional, Tuple

from pyspark.sql import DataFrame, Observation, functions as F

from ..config import AuditParams, ColumnMap, WAREHOUSE_COLUMNS
from ..operators.cohorts import (
    Order, cohort_gaps, cohort_metric, cohort_summary, pick, rate_by, rate_curve,
    reference_gaps, share_of, threshold_contrast,
)
from ..operators.cube import AuditSpec, CohortCube
from ..operators.exposure import exposure_summary, fiscal_leak, fiscal_leak_total
from ..functions.rules import ident, reference_segments, sql_literal
from ..operators.prepare import has_flags, prepare, qcol
from ..operators.quality import (
    KeyPass, duplicate_keys, integrity_check, outcome_counts, outcome_report, scope_counts, scope_report,
)
from ..operators.segment import segment
from ..sinks.publish import publish
from ..operators.bitmaps import BitmapPass, bitmap_integrity, dense_integer_key
from ..operators.reconcile import one_pass_metrics, reconcile, reference_metrics, scorecard_summary

def grouped_audits(params: AuditParams = AuditParams()) -> Tuple[AuditSpec, ...]:
    """The grouped audits: (name, keys, scope, outcome filter, output names).

    Keys come from the parameters, so another dataset's column names work."""
    n = params.names
    h, d, a = params.conditions
    o = n.outcome
    return (
        AuditSpec("baseline_volume", (params.payer, o)),
        AuditSpec("gender_payer", (params.gender, params.payer, o)),
        AuditSpec("chronic_conditions", (d, h, o)),
        AuditSpec("condition_combinations", ("has_diabetes", "has_hypertension", "has_alcoholism"),
                  missed_only=True, volume="total_no_shows", avg="avg_lead_time_no_show", avg_first=True),
        AuditSpec("acuity_tiers", ("patient_acuity", o)),
        AuditSpec("wall_by_payer", (params.payer, n.band, o)),
        AuditSpec("wall_by_payer_prod", (params.payer, n.band, o), scope="production"),
        AuditSpec("reminder_outcome", (params.sms, o)),
        AuditSpec("reminder_band", (params.sms, n.band, o), scope="production"),
        AuditSpec("disability_outcome", (n.disabled, o)),
        AuditSpec("disability_band", (n.disabled, n.band, o), scope="production"),
        AuditSpec("age_class_outcome", (n.age_class, o)),
        AuditSpec("age_class_band", (n.age_class, n.band, o), scope="production"),
        AuditSpec("lead_by_outcome", (o,)),
    )


def full_audit_specs(params: AuditParams = AuditParams()) -> Tuple[AuditSpec, ...]:
    """Grouped audits plus the day curve and the reminder rate, for the long form."""
    return grouped_audits(params) + (
        AuditSpec("lead_day_curve", (params.names.lead,)),
        AuditSpec("reminder_rate", (params.sms,)),
    )


GROUPED_AUDITS: Tuple[AuditSpec, ...] = grouped_audits()
FULL_AUDIT_SPECS: Tuple[AuditSpec, ...] = full_audit_specs()
SPEC_BY_NAME = {s.name: s for s in GROUPED_AUDITS}

# every named audit the cube can serve (all but integrity / duplicates / outcome mapping,
# which need the event keys themselves)
CUBE_SERVED: Tuple[str, ...] = tuple(SPEC_BY_NAME) + (
    "reminder_rate", "lead_day_curve", "wall_contrast", "scope_report", "exposure_summary",
    "fiscal_leak", "beyond_wall", "disabled_share", "cohort_gaps", "cohort_volume")


def catalogue_order(params: AuditParams):
    """How audit outputs are sorted.  The catalogue's own keys have a handful of values, so their rows are gathered and
    sorted in one partition; keys that a caller names may have any number, so those get a global, ranged sort."""
    return "single" if grouped_audits(params) == GROUPED_AUDITS else True


def beyond_condition(params: AuditParams) -> str:
    return f"{ident(params.names.band)} = {sql_literal(params.labels['beyond'])}"


def disabled_condition(params: AuditParams) -> str:
    return f"{ident(params.names.disabled)} = 1"


class Audit:
    """All audits over one events table."""

    def __init__(self, events: DataFrame, cmap: ColumnMap = WAREHOUSE_COLUMNS,
                 params: AuditParams = AuditParams(), order: Order = True):
        """``order``: True sorts as the catalogue's keys allow, "global" always by a ranged sort, False not at all."""
        self.events = events
        self.cmap = cmap
        self.params = params
        self.order = order if order == "global" else catalogue_order(params) if order else False
        self.specs = {s.name: s for s in grouped_audits(params)}
        self._bases: Dict[str, DataFrame] = {}  # lazy plans, reused across audits

    # -- layers -----------------------------------------------------------------
    def required_columns(self) -> Tuple[str, ...]:
        c, p = self.cmap, self.params
        cols = (c.key, c.booked_at, c.due_at, c.outcome, p.payer, p.gender, p.age, p.level, p.sms,
                *p.conditions) + ((c.entity,) if c.entity else ())
        return tuple(dict.fromkeys(cols))

    def check_columns(self) -> None:
        """Fail early, naming what is missing, instead of deep inside plan analysis."""
        have = set(self.events.columns)
        missing = [col for col in self.required_columns() if col not in have]
        p = self.params
        unmapped = [a for a in (p.payer, p.gender, p.age, p.level, p.sms, *p.conditions) if a not in self.cmap.attributes]
        if unmapped:
            raise ValueError(f"AuditParams use {unmapped}, which ColumnMap.attributes does not list")
        if missing:
            raise ValueError(f"events lack columns {missing}; map the dataset's own names with "
                             f"ColumnMap (key, dates, outcome, entity) and AuditParams (attributes)")

    def base(self, scope: str = "valid") -> DataFrame:
        """prepare -> segment (+ has_* flags, ``patient_acuity``): the enriched view."""
        if scope not in self._bases:
            self._bases[scope] = self._build_base(scope)
        return self._bases[scope]

    def _build_base(self, scope: str) -> DataFrame:
        self.check_columns()
        p = self.params
        rules = reference_segments(p)
        rules["patient_acuity"] = rules[p.names.tier]
        return segment(prepare(self.events_of(scope), self.cmap, scope, p), rules, p).withColumns(has_flags(p))

    def events_of(self, scope: str) -> DataFrame:
        """The events that a scope's rows come from; a source that can prune gives fewer."""
        return self.events

    def cube(self) -> CohortCube:
        return CohortCube.build(self.base("raw"), self.cmap, self.params)

    def observed_cube(self) -> Tuple[CohortCube, Dict[str, DataFrame]]:
        """The materialised cube, and the scope and outcome reports counted on the very pass that writes it.

        The counts ride along as observed metrics, so the reports cost no scan.  A stage that ran again after a lost
        executor could count rows twice: the cells' own total shows that, and then the reports are read anew."""
        outcomes, scopes = Observation(), Observation()
        narrow = self.events.select(*[qcol(c) for c in self.required_columns()])
        watched = Audit(narrow.observe(outcomes, *outcome_counts(self.cmap)), self.cmap, self.params)
        cube = CohortCube.build(watched.base("raw").observe(scopes, *scope_counts(self.cmap, self.params)), self.cmap, self.params).materialize()
        spark, total = self.events.sparkSession, cube.scope_report().first()["raw_rows"]
        # An input that is known to be empty is never run, so nothing was observed.
        counts = {"scope_report": scopes.get, "outcome_report": outcomes.get} if total else {}
        if not counts or any(c[k] != total for c, k in ((counts["scope_report"], "raw_rows"), (counts["outcome_report"], "rows"))):
            return cube, {"scope_report": cube.scope_report(), "outcome_report": self.outcome_report()}
        return cube, {name: spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in row.items()]) for name, row in counts.items()}

    def full_audit(self, cube: Optional[CohortCube] = None) -> DataFrame:
        """Every grouped audit, the day curve and the reminder rate, long form, from the cube."""
        return (cube or self.cube()).full_audit(full_audit_specs(self.params))

    # -- AUD-0 / 0b ------------------------------------------------------------
    def integrity(self) -> DataFrame:
        return integrity_check(self.events, self.cmap.key)

    def duplicates(self) -> DataFrame:
        return duplicate_keys(self.events, self.cmap.key)

    def bitmap_integrity(self) -> DataFrame:
        """The integrity row (without ``duplicated_keys``) by bitmaps of the integer key."""
        return bitmap_integrity(self.events, self.cmap.key)

    def key_pass(self):
        """One pass over the keys for integrity, duplicates and the scorecard's distinct count: by bitmaps where the key
        is an integer whose values lie close, else by one shuffle of the keys."""
        dense = dense_integer_key(self.events, self.cmap.key)
        return (BitmapPass if dense else KeyPass)(self.events, self.cmap.key)

    def scope_report(self) -> DataFrame:
        return scope_report(prepare(self.events, self.cmap, "raw", self.params), self.cmap, self.params)

    def outcome_report(self) -> DataFrame:
        return outcome_report(self.events, self.cmap)

    # -- grouped audits ---------------------------------------------------------
    def grouped(self, spec: AuditSpec) -> DataFrame:
        b = self.base(spec.scope)
        if spec.missed_only:
            b = b.where(F.col(self.params.names.outcome))
        return cohort_summary(b, list(spec.dims), self.params, spec.volume, spec.avg,
                              order=self.order, avg_first=spec.avg_first)

    def reminder_rate(self) -> DataFrame:
        b = self.base("valid").withColumn("sms_received", qcol(self.params.sms))
        return rate_by(b, ["sms_received"], self.params, order=self.order)

    def lead_day_curve(self, shows: str = "countif") -> DataFrame:
        return rate_curve(self.base("valid"), self.params, order=self.order, shows=shows)

    def wall_contrast(self, digits: Optional[int] = None, weighted: bool = False) -> DataFrame:
        curve = rate_curve(self.base("valid"), self.params, order=False)
        return threshold_contrast(curve, self.params, weighted=weighted, digits=digits)

    def beyond_wall(self) -> DataFrame:
        """AUD-5b: rows, misses and miss rate beyond the wall (scope V)."""
        return cohort_metric(self.base("valid"), beyond_condition(self.params), self.params, prefix="beyond")

    def cohort_volume(self) -> DataFrame:
        """AUD-2b: the missed volume of ``params.volume_cohort``, summed from the gender x payer table."""
        p = self.params
        table = Audit(self.events, self.cmap, p, order=False).grouped(self.specs["gender_payer"])
        cells = {p.gender: p.volume_cohort[0], p.payer: p.volume_cohort[1], p.names.outcome: True}
        return pick(table, cells, p.names.volume, how="sum")

    def cohort_gaps(self, digits: Optional[int] = None) -> DataFrame:
        return cohort_gaps(self.base("valid"), reference_gaps(self.params), digits, self.params)

    def disabled_share(self) -> DataFrame:
        return share_of(self.base("valid"), disabled_condition(self.params), params=self.params)

    # -- exposure ------------------------------------------------------------------
    def exposure(self, rate_card=None) -> DataFrame:
        """``rate_card``: pairs, or (table, key column, rate column); default the parameters' pairs."""
        return exposure_summary(self.base("production"), None, self.params, rate_card, order=self.order)

    def fiscal_leak(self, beyond_wall_only: bool = False) -> DataFrame:
        exp = exposure_summary(self.base("production"), None, self.params, order=False)
        return fiscal_leak(exp, self.params, beyond_wall_only=beyond_wall_only, order=self.order)

    def fiscal_leak_total(self, beyond_wall_only: bool = False) -> DataFrame:
        return fiscal_leak_total(self.fiscal_leak(beyond_wall_only))

    # -- reconciliation ---------------------------------------------------------------
    def metrics(self, cube: Optional[CohortCube] = None, keys: Optional[KeyPass] = None) -> DataFrame:
        """Checkpoint actuals; ``cube`` serves twelve of them and ``keys`` the distinct count, without a scan."""
        integrity = None if keys is None else keys.integrity()
        if cube is None:
            return reference_metrics(self.base("raw"), self.cmap, self.params, integrity=integrity)
        return reference_metrics(self.base("raw"), self.cmap, cube.params, cube.scoped("raw"), integrity)

    def scorecard(self, expected=None, digits: Optional[int] = None,
                  cube: Optional[CohortCube] = None, keys: Optional[KeyPass] = None) -> DataFrame:
        from ..config import REFERENCE_CHECKPOINTS
        return reconcile(self.metrics(cube, keys), REFERENCE_CHECKPOINTS if expected is None else expected,
                         digits=digits, order=self.order)

    def scorecard_one_pass(self, expected=None, digits: Optional[int] = None) -> DataFrame:
        """The scorecard from one pass over the events: the distinct count (integer key) comes as bitmaps beside the rest."""
        from ..config import REFERENCE_CHECKPOINTS
        return reconcile(one_pass_metrics(self.base("raw"), self.cmap, self.params),
                         REFERENCE_CHECKPOINTS if expected is None else expected, digits=digits, order=self.order)

    def scorecard_summary(self, expected=None) -> DataFrame:
        return scorecard_summary(self.scorecard(expected))

    # -- dispatch (one output of the chain, the rest never executed) ------------------
    def run(self, name: str) -> DataFrame:
        if name in self.specs:
            return self.grouped(self.specs[name])
        fn: Dict[str, Callable[[], DataFrame]] = {
            "integrity": self.integrity,
            "duplicates": self.duplicates,
            "scope_report": self.scope_report,
            "outcome_report": self.outcome_report,
            "reminder_rate": self.reminder_rate,
            "lead_day_curve": self.lead_day_curve,
            "wall_contrast": self.wall_contrast,
            "beyond_wall": self.beyond_wall,
            "cohort_volume": self.cohort_volume,
            "cohort_gaps": self.cohort_gaps,
            "disabled_share": self.disabled_share,
            "exposure_summary": self.exposure,
            "fiscal_leak": self.fiscal_leak,
            "fiscal_leak_total": self.fiscal_leak_total,
            "scorecard": self.scorecard,
            "scorecard_summary": self.scorecard_summary,
        }
        if name not in fn:
            raise KeyError(f"unknown audit {name!r}; known: {sorted(list(fn) + list(self.specs))}")
        return fn[name]()


def cube_audit(cube: CohortCube, name: str, order=None) -> DataFrame:
    """The same named audits, rolled up from a cube instead of re-scanning."""
    order = catalogue_order(cube.params) if order is None else order
    specs = {s.name: s for s in grouped_audits(cube.params)}
    if name in specs:
        return cube.spec(specs[name], order)
    if name == "reminder_rate":
        return cube.rate_by([cube.params.sms], order=order).withColumnRenamed(cube.params.sms, "sms_received")
    if name == "lead_day_curve":
        return cube.curve(order=order)
    if name == "wall_contrast":
        return threshold_contrast(cube.curve(order=False), cube.params)
    if name == "scope_report":
        return cube.scope_report()
    if name == "exposure_summary":
        return cube.exposure(order=order)
    if name == "fiscal_leak":
        return fiscal_leak(cube.exposure(order=False), cube.params, order=order)
    p = cube.params
    if name == "beyond_wall":
        return cohort_metric(cube.scoped("valid"), beyond_condition(p), p, prefix="beyond", cells=True)
    if name == "disabled_share":
        return share_of(cube.scoped("valid"), disabled_condition(p), params=p, cells=True)
    if name == "cohort_gaps":
        return cohort_gaps(cube.scoped("valid"), reference_gaps(p), params=p, cells=True)
    if name == "cohort_volume":
        table = cube.spec(specs["gender_payer"], order=False)
        return pick(table, {p.gender: p.volume_cohort[0], p.payer: p.volume_cohort[1], p.names.outcome: True}, p.names.volume, how="sum")
    raise KeyError(f"audit {name!r} is not served by the cube")


def publish_cube(cube: CohortCube, path: str, extra: Optional[Dict[str, DataFrame]] = None) -> str:
    """Every audit the cube serves, and ``extra`` tables, written by one job and published together (``sinks.publish``).

    The grouped audits come from one pass of grouping sets; the others are further branches of the same job."""
    n, specs = cube.params.names, grouped_audits(cube.params)
    columns = {}
    for s in specs:
        figures = [(n.volume, s.volume or n.volume), (n.avg_lead, s.avg or n.avg_lead)]
        columns[s.name] = [(d, d) for d in s.dims] + (figures[::-1] if s.avg_first else figures)
    frames = {name: cube_audit(cube, name, order=False) for name in CUBE_SERVED if name not in columns}
    return publish(cube.cells.sparkSession, {**frames, **(extra or {})}, path, cube.grouped_sets(specs), columns)
