"""Ordered segment rules: first matching case wins, else the default.

A rule compiles to one ``CASE WHEN`` expression, so a whole label layer is a
single projection inside whole-stage codegen.  A NULL condition does not
match and falls through to the default, as in SQL.  Conditions may be SQL
text (compiled with one ``expr`` call) or ``Column`` objects.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Dict, Sequence, Tuple, Union

from pyspark.sql import Column, functions as F

Cond = Union[Column, str]


def ident(name: str) -> str:
    """A column name as a SQL identifier (backticks keep ``No-show`` literal)."""
    return "`" + name.replace("`", "``") + "`"


def sql_literal(v: Any) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Segment:
    cases: Tuple[Tuple[Cond, Any], ...]
    default: Any

    @classmethod
    def of(cls, cases: Sequence[Tuple[Cond, Any]], default: Any) -> "Segment":
        return cls(tuple((c, v) for c, v in cases), default)

    def sql(self) -> str:
        """The rule as one SQL CASE expression (string conditions only)."""
        if not self.cases:
            return sql_literal(self.default)
        whens = " ".join(f"WHEN {c} THEN {sql_literal(v)}" for c, v in self.cases)
        return f"CASE {whens} ELSE {sql_literal(self.default)} END"

    def column(self) -> Column:
        if all(isinstance(c, str) for c, _ in self.cases):
            return F.expr(self.sql())
        expr = None
        for cond, value in self.cases:
            c = F.expr(cond) if isinstance(cond, str) else cond
            expr = F.when(c, F.lit(value)) if expr is None else expr.when(c, F.lit(value))
        if expr is None:
            return F.lit(self.default)
        return expr.otherwise(F.lit(self.default))


def band_rule(params) -> Segment:
    lb = params.labels
    return Segment.of([(f"{ident(params.names.lead)} >= {int(params.wall)}", lb["beyond"])], lb["safe"])


def tier_rule(params) -> Segment:
    lb = params.labels
    h, d, a = (ident(c) for c in params.conditions)
    return Segment.of(
        [(f"{h} = 1 AND {d} = 1 AND {a} = 1", lb["triple"]), (f"{h} = 1 AND {d} = 1", lb["high"])],
        lb["baseline"],
    )


def age_rule(params) -> Segment:
    lb = params.labels
    return Segment.of([(f"{ident(params.age)} < {int(params.adult_age)}", lb["minor"])], lb["adult"])


def level_rule(params) -> Segment:
    return Segment.of([(f"{ident(params.level)} > 0", 1)], 0)


def reference_segments(params) -> Dict[str, Segment]:
    """The audit's four label layers, keyed by output column name."""
    n = params.names
    return {
        n.band: band_rule(params),
        n.tier: tier_rule(params),
        n.age_class: age_rule(params),
        n.disabled: level_rule(params),
    }
