"""SNK-2 / SNK-1: many audit tables written by ONE job and published together.

The tables are unioned into one long table that is written split by ``audit``
(``runs/<run>/audit=<name>``), in one job however many audits there are; then
the pointer ``_LATEST`` is replaced, which publishes all of them at once: a
reader sees every table of the old run or every table of the new one.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from typing import Dict, List, Sequence, Tuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.rules import sql_literal
from ..operators.prepare import qcol
from .atomic import read_text, replace_text

Columns = List[Tuple[str, str]]  # (stored name, the audit's own name), in the audit's order


def _stored(frames: Dict[str, DataFrame]) -> Tuple[List[DataFrame], Dict[str, Columns]]:
    """Frames with stored names, one per (name, type), and the manifest of them."""
    taken: Dict[str, str] = {"audit": "string"}
    out, manifest = [], {}
    for audit, df in frames.items():
        columns: Columns = []
        for name, kind in df.dtypes:
            stored = name if taken.setdefault(name, kind) == kind and name != "audit" else f"{name} as {kind}"
            taken.setdefault(stored, kind)
            columns.append((stored, name))
        manifest[audit] = columns
        out.append(df.select(F.expr(sql_literal(audit)).alias("audit"), *[qcol(name).alias(stored) for stored, name in columns]))
    return out, manifest


def publish(spark: SparkSession, frames: Dict[str, DataFrame], path: str, long: DataFrame = None,
            long_columns: Dict[str, Sequence[Tuple[str, str]]] = None) -> str:
    """Write all tables in one job and publish them; returns the run's folder.

    ``long`` may hold many audits already (a column ``audit`` and the union of their columns, as
    ``CohortCube.grouped_sets`` gives); ``long_columns`` names each one's columns: (in ``long``, the audit's own)."""
    parts, manifest = _stored(frames)
    if long is not None:
        kinds = {n: k for p in parts for n, k in p.dtypes}
        rename = {n: n if kinds.get(n, k) == k else f"{n} as {k}" for n, k in long.dtypes}
        parts.append(long.where(F.col("audit").isin(list(long_columns))).select(*[qcol(n).alias(rename[n]) for n in long.columns]))
        manifest.update({a: [(rename[s], n) for s, n in cols] for a, cols in long_columns.items()})
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    run = f"runs/{uuid.uuid4().hex}"
    whole.write.partitionBy("audit").parquet(f"{path.rstrip('/')}/{run}")
    schema = json.loads(whole.schema.json())
    replace_text(spark, f"{path.rstrip('/')}/_LATEST", json.dumps({"run": run, "audits": manifest, "schema": schema}))
    return f"{path.rstrip('/')}/{run}"


class Published:
    """The tables of one published run; it keeps reading that run, whatever is published later."""

    def __init__(self, spark: SparkSession, path: str):
        text = read_text(spark, f"{path.rstrip('/')}/_LATEST")
        if text is None:
            raise FileNotFoundError(f"nothing is published under {path}")
        self.spark, self.manifest = spark, json.loads(text)
        self.path = f"{path.rstrip('/')}/{self.manifest['run']}"

    def names(self) -> List[str]:
        return sorted(self.manifest["audits"])

    def table(self, audit: str) -> DataFrame:
        """One audit with its own columns and types; only its folder is read, and it may be empty."""
        from pyspark.sql.types import StructType
        rows = self.spark.read.schema(StructType.fromJson(self.manifest["schema"])).parquet(self.path)
        columns = self.manifest["audits"][audit]
        return rows.where(F.col("audit") == audit).select(*[qcol(stored).alias(name) for stored, name in columns])
