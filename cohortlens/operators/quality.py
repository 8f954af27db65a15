"""AUD-0 / AUD-0b: integrity of the key, scope accounting, outcome mapping.

``integrity_check`` groups by the key first: the map-side partial
aggregate collapses repeated keys before the shuffle, so even a key that
holds a third of all rows sends one row per map task.  Totals then come
from a global aggregate over the per-key counts.
"""

from __future__ import annotations

from functools import reduce
from typing import List, Sequence, Union

from pyspark.sql import Column, DataFrame, functions as F

from ..config import AuditParams, ColumnMap, WAREHOUSE_COLUMNS, as_list
from ..functions.rules import sql_literal
from ..functions.outcome import outcome_flag, unmapped_outcome
from .prepare import qcol

Keys = Union[str, Sequence[str]]


def _key_counts(df: DataFrame, key: Keys) -> DataFrame:
    keys = as_list(key)
    return df.groupBy(*[qcol(k) for k in keys]).agg(F.count(F.lit(1)).alias("_cnt"))


def _null_key(keys) -> "F.Column":
    return reduce(lambda a, b: a | b, [qcol(k).isNull() for k in keys])


def integrity_check(df: DataFrame, key: Keys) -> DataFrame:
    """One row: total_records, distinct_keys, null_key_records, duplicated_keys,
    duplicate_records (rows beyond the first per key), is_unique."""
    keys = as_list(key)
    kc = _key_counts(df, keys)
    null_key = _null_key(keys)
    cnt = F.col("_cnt")
    agg = kc.agg(
        F.coalesce(F.sum(cnt), F.lit(0)).cast("long").alias("total_records"),
        F.count_if(~null_key).alias("distinct_keys"),
        F.coalesce(F.sum(F.when(null_key, cnt)), F.lit(0)).cast("long").alias("null_key_records"),
        F.count_if(~null_key & (cnt > 1)).alias("duplicated_keys"),
        F.coalesce(F.sum(F.when(~null_key & (cnt > 1), cnt - 1)), F.lit(0)).cast("long")
        .alias("duplicate_records"),
    )
    return agg.withColumn(
        "is_unique", (F.col("duplicate_records") == 0) & (F.col("null_key_records") == 0))


class KeyPass:
    """Integrity, duplicates and the distinct count from ONE shuffle of the keys.

    The key counts are reduced in one pass to what the audits read: keys that occur more than once or are NULL, and one
    row for all the others; that table is written to the shared checkpoint folder."""

    def __init__(self, df: DataFrame, key: Keys):
        from ..sinks.feed import materialize
        self.keys = as_list(key)
        once = (F.col("_cnt") == 1) & ~_null_key(self.keys)
        blank = [F.when(once, F.lit(None)).otherwise(qcol(k)).alias(k) for k in self.keys]
        self.table = materialize(
            _key_counts(df, self.keys).select(*blank, once.alias("_once"), "_cnt")
            .groupBy(*[qcol(k) for k in self.keys], "_once", "_cnt").agg(F.count(F.lit(1)).alias("_keys")))

    def integrity(self) -> DataFrame:
        """The same row as ``integrity_check``."""
        once, cnt, n = F.col("_once"), F.col("_cnt"), F.col("_keys")
        null_key = ~once & _null_key(self.keys)
        many = ~once & ~_null_key(self.keys)

        def total(x):
            return F.coalesce(F.sum(x), F.lit(0)).cast("long")

        out = self.table.agg(
            total(cnt * n).alias("total_records"), total(F.when(~null_key, n)).alias("distinct_keys"),
            total(F.when(null_key, cnt * n)).alias("null_key_records"), total(F.when(many, n)).alias("duplicated_keys"),
            total(F.when(many, (cnt - 1) * n)).alias("duplicate_records"))
        return out.withColumn("is_unique", (F.col("duplicate_records") == 0) & (F.col("null_key_records") == 0))

    def duplicates(self) -> DataFrame:
        """The same rows as ``duplicate_keys``."""
        return (self.table.where(~F.col("_once") & ~_null_key(self.keys))
                .select(*[qcol(k) for k in self.keys], F.col("_cnt").alias("occurrences")))


def duplicate_keys(df: DataFrame, key: Keys) -> DataFrame:
    """The offending keys and how often each occurs (distributed; never collected)."""
    keys = as_list(key)
    return (_key_counts(df, keys)
            .where((F.col("_cnt") > 1) & ~_null_key(keys))
            .withColumnRenamed("_cnt", "occurrences"))


def scope_counts(cmap: ColumnMap = WAREHOUSE_COLUMNS, params: AuditParams = AuditParams()) -> List[Column]:
    """Aggregates over a ``prepare(scope='raw')`` frame: rows kept and removed by each scope rule."""
    lead = F.col(params.names.lead)
    valid = lead >= 0
    ent = qcol(cmap.entity).isNotNull() if cmap.entity else F.lit(True)
    return [
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(valid).alias("valid_lead_rows"),
        F.count_if(valid & ent).alias("production_rows"),
        F.count_if(lead < 0).alias("negative_lead_rows"),
        F.count_if(lead.isNull()).alias("null_lead_rows"),
        F.count_if(valid & ~ent).alias("null_entity_rows"),
    ]


def scope_report(prepared_raw: DataFrame, cmap: ColumnMap = WAREHOUSE_COLUMNS,
                 params: AuditParams = AuditParams()) -> DataFrame:
    """Rows kept and removed by each scope rule, from a ``prepare(scope='raw')`` frame."""
    return prepared_raw.agg(*scope_counts(cmap, params))


def outcome_counts(cmap: ColumnMap = WAREHOUSE_COLUMNS) -> List[Column]:
    """Aggregates over the events: outcome values that are missing, or present but outside the mapping."""
    raw = qcol(cmap.outcome)
    flag = outcome_flag(raw, cmap.outcome_values)
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(flag).alias("outcome_true"),
        F.count_if(~flag).alias("outcome_false"),
        F.count_if(raw.isNull()).alias("null_outcomes"),
        F.count_if(unmapped_outcome(raw, flag)).alias("unmapped_outcomes"),
    ]


def outcome_report(df: DataFrame, cmap: ColumnMap = WAREHOUSE_COLUMNS) -> DataFrame:
    """Outcome values that are missing, or present but outside the mapping."""
    return df.agg(*outcome_counts(cmap))


def load_profile(df: DataFrame) -> DataFrame:
    """SNK-4: row count and column count in one row (a sample is ``df.limit(3)``)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(df.columns)))


def column_profile(df: DataFrame) -> DataFrame:
    """SNK-4: one row per column, in order: position, name, type, non-null values, smallest value as text.

    One aggregate over the table; the list of columns is turned long afterwards."""
    aggs = []
    for i, f in enumerate(df.schema.fields):
        aggs += [F.count(qcol(f.name)).alias(f"_n{i}"), F.min(qcol(f.name)).cast("string").alias(f"_s{i}")]
    rows = ", ".join(f"struct({i + 1} AS position, {sql_literal(f.name)} AS name, {sql_literal(f.dataType.simpleString())} AS type, "
                     f"_n{i} AS non_null, _s{i} AS smallest)" for i, f in enumerate(df.schema.fields))
    return df.agg(*aggs).selectExpr(f"inline(array({rows}))")


def sample_rows(df: DataFrame, n: int, key: Keys, seed: int = 0) -> DataFrame:
    """SNK-4: ``n`` rows that look random and are the same in every run: those with the smallest hash of key and seed.

    Neither row order nor partitioning matters; equal hashes are told apart by the key and then the whole row.  Spark
    takes the first ``n`` per task before anything moves."""
    keys = [qcol(k) for k in as_list(key)]
    rest = [qcol(c).cast("string") for c in df.columns]
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys, *rest).limit(n)
