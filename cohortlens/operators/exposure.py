"""EXP-1 / EXP-2: modeled exposure per cohort with a rate card, and the leak.

The rate card is applied AFTER aggregation, to group rows (the payer is a
group key), so nothing is joined to or broadcast with the event rows.  A
card given as pairs compiles to a CASE expression; a card kept as a table,
of any size, is left-joined to the aggregated cohort rows, after a check
that it holds no payer twice.  The share of total volume divides by a
scalar total of the aggregated rows, so no window gathers them in one task.
"""

from __future__ import annotations

from typing import Iterable, Optional, Sequence, Tuple, Union

from pyspark.sql import Column, DataFrame, functions as F

from ..config import AuditParams, as_list
from ..functions.measures import rounded, share_pct
from .cohorts import _order
from .prepare import qcol

def exposure_dims(params: AuditParams = AuditParams()) -> Tuple[str, ...]:
    """The exposure keys: payer, gender, band, tier, reminder, outcome."""
    n = params.names
    return (params.payer, params.gender, n.band, n.tier, params.sms, n.outcome)


EXPOSURE_DIMS = exposure_dims()


def validate_rate_card(pairs: Iterable[Tuple[object, int]]) -> Tuple[Tuple[object, int], ...]:
    pairs = tuple((k, v) for k, v in pairs)
    keys = [k for k, _ in pairs]
    dup = sorted({repr(k) for k in keys if keys.count(k) > 1})
    if dup:
        raise ValueError(f"rate card has duplicate keys {dup}; a duplicate would multiply rows")
    if any(k is None for k in keys):
        raise ValueError("rate card keys must not be NULL; NULL payers take the default rate")
    return pairs


def rate_expr(payer: Column, pairs: Sequence[Tuple[object, int]], default: int) -> Column:
    """Rate per payer value; unmatched and NULL payers get ``default`` (CASE ... ELSE)."""
    pairs = validate_rate_card(pairs)
    expr = None
    for k, v in pairs:
        expr = F.when(payer == F.lit(k), F.lit(v)) if expr is None else expr.when(payer == F.lit(k), F.lit(v))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def check_rate_table(card: DataFrame, key: str) -> DataFrame:
    """The card, whose evaluation fails if a payer stands in it twice (one aggregate, nothing collected).

    The failing row names the payer; a NULL payer in the card is ignored, as NULL payers take the default."""
    k = qcol(key)
    return (card.where(k.isNotNull()).groupBy(k.alias("_payer"))
            .agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[qcol(c) for c in card.columns])).alias("_row"))
            .withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(
                F.concat(F.lit("rate card has duplicate key "), F.col("_payer").cast("string")))).otherwise(F.lit(True)))
            .where("coalesce(cast(_ok as boolean), true)"))


def with_exposure(groups: DataFrame, params: AuditParams, impact: str, share: str,
                  rate_card: Optional["RateCard"] = None) -> DataFrame:
    """Aggregated cohort rows with ``impact`` (volume x rate of the payer) and ``share`` of the total volume.

    ``rate_card``: pairs, or (table, key column, rate column)."""
    n = params.names
    card = params.rate_card if rate_card is None else rate_card
    # A scalar subquery, one value.  It reads the mean as well, so that its aggregate is the very one of ``groups``
    # and the executed plan reuses that exchange instead of scanning the events again.
    total = groups.agg(F.struct(F.sum(F.col(n.volume)).alias("t"), F.count(F.col(n.avg_lead)))).scalar().getField("t")
    out = groups
    if len(card) == 3 and isinstance(card[0], DataFrame):
        table, key, rate = card
        rates = check_rate_table(table, key).select("_payer", F.col("_row").getField(rate).cast("long").alias("_rate"))
        out = out.join(rates, qcol(params.payer) == F.col("_payer"), "left")
        rate_col = F.coalesce(F.col("_rate"), F.lit(params.default_rate))
    else:
        rate_col = rate_expr(qcol(params.payer), card, params.default_rate)
    return out.select(
        *[qcol(c) for c in groups.columns],
        (F.col(n.volume) * rate_col).cast("long").alias(impact),
        F.round(share_pct(F.col(n.volume), total), 2).alias(share))


RateCard = Union[Sequence[Tuple[object, int]], Tuple[DataFrame, str, str]]


def exposure_summary(
    df: DataFrame,
    dims: Optional[Sequence[str]] = None,
    params: AuditParams = AuditParams(),
    rate_card: Optional[RateCard] = None,
    impact: str = "modeled_revenue_impact",
    share: str = "pct_of_total_volume",
    order: bool = True,
) -> DataFrame:
    """Per cohort: volume, mean lead, volume x rate(payer), share of total volume (%, 2 dp).

    Impact is computed for every cohort, missed or not (the outcome is only a
    key); ``fiscal_leak`` keeps the missed ones.
    """
    n = params.names
    dims = exposure_dims(params) if dims is None else as_list(dims)
    if params.payer not in dims:
        raise ValueError(f"payer column {params.payer!r} must be one of the dims {dims}")
    groups = df.groupBy(*[qcol(d) for d in dims]).agg(
        F.count(F.lit(1)).alias(n.volume),
        rounded(F.avg(F.col(n.lead)), params.digits).alias(n.avg_lead),
    )
    out = with_exposure(groups, params, impact, share, rate_card)
    if not order:
        return out
    # payer descending, then band, tier, outcome; the remaining keys break ties
    first = [qcol(params.payer).desc_nulls_last()]
    rest = [d for d in (n.band, n.tier, n.outcome) if d in dims]
    tail = [d for d in dims if d != params.payer and d not in rest]
    return out.orderBy(*first, *[qcol(d).asc_nulls_first() for d in rest + tail])


def fiscal_leak(
    exposure: DataFrame,
    params: AuditParams = AuditParams(),
    impact: str = "modeled_revenue_impact",
    beyond_wall_only: bool = False,
    order: bool = True,
) -> DataFrame:
    """EXP-2: per payer, missed volume and the impact of missed cohorts only."""
    n = params.names
    keep = F.col(n.outcome)
    if beyond_wall_only:
        keep = keep & (F.col(n.band) == F.lit(params.labels["beyond"]))
    out = exposure.groupBy(qcol(params.payer)).agg(
        F.coalesce(F.sum(F.when(keep, F.col(n.volume))), F.lit(0)).cast("long").alias("missed_volume"),
        F.coalesce(F.sum(F.when(keep, F.col(impact))), F.lit(0)).cast("long").alias("fiscal_leak"),
    )
    return _order(out, [params.payer], order)


def fiscal_leak_total(leak: DataFrame) -> DataFrame:
    return leak.agg(F.sum("missed_volume").cast("long").alias("missed_volume"),
                    F.sum("fiscal_leak").cast("long").alias("fiscal_leak"))
