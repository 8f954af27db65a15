"""Row positions in a global order, without gathering the rows in one task."""

from __future__ import annotations

import uuid
from typing import Sequence, Union

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sinks.feed import materialize


def with_position(df: DataFrame, order: Sequence[Union[str, Column]], name: str = "position") -> DataFrame:
    """``df`` with each row's 1-based place (BIGINT ``name``) under ``order``.

    The rows are range-partitioned and sorted by ``order``.  Rows that tie under it take consecutive places in any order.
    NULL keys sort as the order says (first when ascending, by default)."""
    return in_position(df.repartitionByRange(*order).sortWithinPartitions(*order), name)


def in_position(df: DataFrame, name: str = "position") -> DataFrame:
    """``df``, whose partitions and rows stand in order already (a global sort leaves them so), with each row's place.

    The rows are written once to the shared checkpoint folder, so that partitions and places inside them are fixed; the
    rows of every earlier partition are then added.  That prefix sum runs over one count per partition (a few thousand
    rows at most), which is why it may sit in one task and be broadcast.  The rows come back in order, partition by
    partition."""
    part, at, n, earlier = (f"_{x}_{uuid.uuid4().hex[:8]}" for x in ("part", "at", "n", "earlier"))
    placed = materialize(df.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}))
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    before = counts.select(part, (F.sum(n).over(Window.orderBy(part)) - F.col(n)).alias(earlier))
    # The low 33 bits of the id are the place inside its partition.
    place = (F.col(earlier) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")
    return placed.join(F.broadcast(before), part).select(place.alias(name), *[F.col(f"`{c}`") for c in df.columns])
