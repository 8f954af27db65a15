"""AGG-2 / AUD-0 by compressed bitmaps: exact distinct counts of integer keys.

A key is a bit: ``bitmap_bucket_number`` names its bucket of 32,768 keys and
``bitmap_bit_position`` its place there.  A map task turns its rows into one
bitmap per bucket before the shuffle, so 32,768 keys travel as at most 4 KB
(far less when compressed) instead of a row each, and a key that holds a third
of the rows is one bit.  Bitmaps are mergeable: stored per cohort or day they
are OR-ed into any coarser grouping, which plain distinct counts are not.

A bucket with few keys costs as much as a full one, so this suits keys that
lie close (``dense_integer_key`` measures it); others keep ``integrity_check``.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

from ..config import as_list
from ..functions.rules import ident
from ..sinks.feed import materialize
from .prepare import qcol
from .quality import Keys, _key_counts, _null_key

BUCKET_KEYS = 32_768
# Up to so many buckets with repeated keys (16 bytes each) are broadcast; beyond that a plain join looks them up.
BROADCAST_BUCKETS = 100_000
_BITS = "_bits"


def _check_integer(df: DataFrame, column: str) -> None:
    kind = {f.name: f.dataType for f in df.schema.fields}.get(column)
    if not isinstance(kind, IntegralType):
        raise ValueError(f"bitmaps need an integer key; {column!r} is {kind}")


def dense_integer_key(df: DataFrame, key: Keys, keys_per_bucket: int = 512) -> bool:
    """Whether the (first) key is an integer with at least ``keys_per_bucket`` rows per bucket of its range.

    One aggregate (smallest, largest, count), which Parquet answers from its footers where aggregate push-down is on."""
    first = as_list(key)[0]
    if not isinstance(df.schema[first].dataType, IntegralType):
        return False
    low, high, n = df.agg(F.min(qcol(first)), F.max(qcol(first)), F.count(qcol(first))).first()
    return bool(n) and (high - low) // BUCKET_KEYS * keys_per_bucket <= n


def _bucketed(keys: Sequence[str]) -> Sequence[Column]:
    """Group columns of a (composite) key: bits stand for the first key, the others group; all NULL where any is."""
    null = _null_key(keys)
    bucket = F.when(~null, F.expr(f"bitmap_bucket_number({ident(keys[0])})")).alias("_bucket")
    return [null.alias("_null"), bucket, *[F.when(~null, qcol(k)).alias(f"_k{i}") for i, k in enumerate(keys[1:])]]


def _construct(key: str) -> Column:
    return F.expr(f"bitmap_construct_agg(bitmap_bit_position({ident(key)}))").alias(_BITS)


def key_buckets(df: DataFrame, key: Keys, *aggregates: Column) -> DataFrame:
    """One row per bucket of keys: ``_null``, ``_bucket``, ``_k1``.., ``_n`` rows, ``_keys`` distinct keys, and the given
    aggregates of the bucket's rows."""
    keys = as_list(key)
    _check_integer(df, keys[0])
    groups = _bucketed(keys)
    out = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), _construct(keys[0]), *aggregates)
    return out.withColumn("_keys", F.expr(f"if(_null, 0L, bitmap_count({_BITS}))")).drop(_BITS)


def _total(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0)).cast("long")


def bucket_totals(buckets: DataFrame, *aggregates: Column) -> DataFrame:
    """One row from ``key_buckets``: total_records, distinct_keys, null_key_records, duplicate_records, is_unique."""
    out = buckets.agg(_total(F.col("_n")).alias("total_records"), _total(F.col("_keys")).alias("distinct_keys"),
                      _total(F.when(F.col("_null"), F.col("_n"))).alias("null_key_records"),
                      _total(F.when(~F.col("_null"), F.col("_n") - F.col("_keys"))).alias("duplicate_records"), *aggregates)
    return out.withColumn("is_unique", (F.col("duplicate_records") == 0) & (F.col("null_key_records") == 0))


def bitmap_integrity(df: DataFrame, key: Keys) -> DataFrame:
    """``integrity_check`` without ``duplicated_keys`` (bits do not tell how many keys repeat), lazily, in one pass."""
    return bucket_totals(key_buckets(df, key))


class BitmapPass:
    """The answers of ``KeyPass`` from bitmaps: one pass over the keys, then a second one over the buckets that hold
    repeated keys, if there are any."""

    def __init__(self, df: DataFrame, key: Keys):
        self.df, self.keys = df, as_list(key)
        self.buckets = materialize(key_buckets(df, self.keys))
        self._repeated = self.buckets.where("not _null and _n > _keys")
        self.repeated_buckets = self._repeated.count()

    def duplicates(self) -> DataFrame:
        """The same rows as ``duplicate_keys``; no scan where the bitmaps show that no key repeats."""
        if not self.repeated_buckets:
            return _key_counts(self.df.limit(0), self.keys).withColumnRenamed("_cnt", "occurrences")
        names = ["_bucket", *[f"_k{i}" for i in range(len(self.keys) - 1)]]
        suspects = self._repeated.select(*names)
        if self.repeated_buckets <= BROADCAST_BUCKETS:
            suspects = F.broadcast(suspects)
        keyed = self.df.select(*[qcol(k) for k in self.keys], *_bucketed(self.keys)).where("not _null")
        rows = keyed.join(suspects, names, "left_semi")
        return _key_counts(rows, self.keys).where("_cnt > 1").withColumnRenamed("_cnt", "occurrences")

    def integrity(self) -> DataFrame:
        """The same row as ``integrity_check``."""
        totals = bucket_totals(self.buckets)
        if self.repeated_buckets:
            totals = totals.crossJoin(self.duplicates().agg(F.count(F.lit(1)).alias("duplicated_keys")))  # one row each
        else:
            totals = totals.withColumn("duplicated_keys", F.lit(0).cast("long"))
        return totals.select("total_records", "distinct_keys", "null_key_records", "duplicated_keys", "duplicate_records", "is_unique")


def distinct_bitmaps(df: DataFrame, dims: Sequence[str], key: str) -> DataFrame:
    """(dims.., bucket, bits): the keys of every cohort as bitmaps, to be stored and merged; NULL keys are left out."""
    _check_integer(df, key)
    return (df.where(qcol(key).isNotNull())
            .groupBy(*[qcol(d) for d in dims], F.expr(f"bitmap_bucket_number({ident(key)})").alias("bucket"))
            .agg(_construct(key).alias("bits")))


def merge_bitmaps(parts: Sequence[DataFrame], dims: Sequence[str]) -> DataFrame:
    """Bitmaps of several days or sources as one table over ``dims`` (all or some of the parts' dims), OR-ed by bucket."""
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy(*[qcol(d) for d in dims], "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def count_bitmaps(bitmaps: DataFrame, dims: Sequence[str], name: str = "distinct_keys") -> DataFrame:
    """Exact distinct keys per cohort of ``dims``: bitmaps of one bucket are OR-ed, then their bits counted."""
    merged = merge_bitmaps([bitmaps], dims)
    return merged.groupBy(*[qcol(d) for d in dims]).agg(F.expr("sum(bitmap_count(bits))").alias(name))
