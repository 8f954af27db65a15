"""CHK-1 / CHK-2: metrics vs expected values with tolerances.

Metrics come from one global aggregate over the raw-scope frame plus the
key-only integrity check for the distinct count, are turned long with
``inline``, and meet the expected values in a join against a table whose
size is the number of checkpoints.  A metric that is NULL (empty cohort)
fails its check instead of raising.
"""

from __future__ import annotations

from typing import Optional, Sequence, Tuple, Union

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..config import AuditParams, ColumnMap, REFERENCE_CHECKPOINTS, WAREHOUSE_COLUMNS
from ..functions.rules import ident, sql_literal
from .bitmaps import bucket_totals, key_buckets
from .metrics import metrics_long, partial_sql, reference_checkpoint_metrics
from .quality import integrity_check

Expected = Union[DataFrame, Sequence[Tuple[str, float, float]]]

EXPECTED_SCHEMA = StructType([
    StructField("seq", IntegerType(), False),
    StructField("label", StringType(), False),
    StructField("expected", DoubleType(), True),
    StructField("tol", DoubleType(), True),
])


def long_metrics(wide: DataFrame, labels: Sequence[Tuple[str, str]]) -> DataFrame:
    """(label, actual DOUBLE) rows from a one-row frame; ``labels`` = (label, column)."""
    rows = ", ".join(f"struct({sql_literal(lbl)} AS label, CAST({ident(c)} AS DOUBLE) AS actual)"
                     for lbl, c in labels)
    return wide.selectExpr(f"inline(array({rows}))")


def reference_metrics(
    seg_raw: DataFrame,
    cmap: ColumnMap = WAREHOUSE_COLUMNS,
    params: AuditParams = AuditParams(),
    cells: Optional[DataFrame] = None,
    integrity: Optional[DataFrame] = None,
) -> DataFrame:
    """The 13 published checkpoints' actual values, from a raw-scope segmented frame.

    Twelve come from one aggregate pass — over the rows, or over cube cells
    when ``cells`` is given.  The distinct-key count comes from
    ``integrity_check``, which shuffles the key column alone — folding a
    distinct count into the big aggregate would drag every other partial
    buffer through a per-key shuffle.  ``integrity`` gives that row where it is known already.
    """
    ms = reference_checkpoint_metrics(params)
    main = (metrics_long(seg_raw, ms, params) if cells is None
            else metrics_long(cells, ms, params, cells=True))
    label = REFERENCE_CHECKPOINTS[1][0]
    distinct = long_metrics(integrity_check(seg_raw, cmap.key) if integrity is None else integrity, [(label, "distinct_keys")])
    return main.unionByName(distinct)


def one_pass_metrics(
    seg_raw: DataFrame,
    cmap: ColumnMap = WAREHOUSE_COLUMNS,
    params: AuditParams = AuditParams(),
) -> DataFrame:
    """All 13 checkpoints' actual values, the distinct count too, from ONE pass over the rows and one shuffle.

    Rows are first reduced per bucket of the integer key: its bitmap of keys beside the partial sums of the other twelve
    figures.  The distinct count so shuffles with them, without a row per key."""
    ms = reference_checkpoint_metrics(params)
    parts = [partial_sql(m, i, params) for i, m in enumerate(ms)]
    names = [(alias, sql) for p, _ in parts for alias, sql in p]
    buckets = key_buckets(seg_raw, cmap.key, *[F.expr(f"{sql} AS {alias}") for alias, sql in names])
    totals = bucket_totals(buckets, *[F.expr(f"sum({alias}) AS {alias}") for alias, _ in names])
    figures = [(m.label, final if m.kind != "count" else f"coalesce({final}, 0)") for m, (_, final) in zip(ms, parts)]
    rows = ", ".join(f"struct({sql_literal(label)} AS label, CAST({final} AS DOUBLE) AS actual)"
                     for label, final in [*figures, (REFERENCE_CHECKPOINTS[1][0], "distinct_keys")])
    return totals.selectExpr(f"inline(array({rows}))")


def _expected_frame(spark, expected: Expected) -> DataFrame:
    if isinstance(expected, DataFrame):
        cols = expected.columns
        e = expected if "seq" in cols else expected.withColumn("seq", F.lit(0))
        # one row per label; the evaluation fails, naming the label, where a table has it twice
        once = e.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.min("seq").alias("seq"),
                                      F.min("expected").alias("expected"), F.min("tol").alias("tol"))
        return once.select(
            F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate checkpoint label "), F.col("label"))))
            .otherwise(F.col("seq")).cast("int").alias("seq"), "label",
            F.col("expected").cast("double").alias("expected"), F.col("tol").cast("double").alias("tol"))
    rows = [(i, str(lbl), float(exp), float(tol)) for i, (lbl, exp, tol) in enumerate(expected)]
    labels = [r[1] for r in rows]
    if len(set(labels)) != len(labels):
        raise ValueError("duplicate checkpoint labels")
    return spark.createDataFrame(rows, EXPECTED_SCHEMA)


def reconcile(
    actuals: DataFrame,
    expected: Expected = REFERENCE_CHECKPOINTS,
    digits: Optional[int] = None,
    order=True,
) -> DataFrame:
    """label, actual, expected, tol, ok — every expected label appears once (in checkpoint order).

    ``ok`` = ``|actual - expected| <= tol``; a missing or NULL actual is not ok.
    """
    exp = _expected_frame(actuals.sparkSession, expected)
    joined = exp.join(actuals, on="label", how="left")
    actual = "actual" if digits is None else f"round(actual, {int(digits)})"
    out = joined.selectExpr(
        "seq", "label", f"{actual} AS actual", "expected", "tol",
        f"coalesce(abs({actual} - expected) <= tol, FALSE) AS ok",
    )
    if order == "single":  # one row per checkpoint: sort in one partition
        out = out.repartition(1).sortWithinPartitions("seq")
    elif order:
        out = out.orderBy("seq")
    return out.drop("seq")


def scorecard_summary(checks: DataFrame) -> DataFrame:
    """CHK-2: passed, total, all_ok."""
    return checks.agg(
        F.count_if(F.col("ok")).alias("passed"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("all_ok", F.col("passed") == F.col("total"))
