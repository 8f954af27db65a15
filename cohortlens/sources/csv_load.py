"""SRC-3: one pass over a headed CSV that types its rows and sets faulty ones aside.

A row goes to quarantine, whole, if the line is malformed, a value cannot be
read as its column's type, or a required column is empty; the rejects table has
one row per fault: file, row key as written, column, value as written, reason.
Typed rows and faults are written by one job to a staged table (split by
``rejected``), so the CSV's text is parsed once however many audits follow; the
same job counts both, and a share of rejected rows above the caller's limit
fails the load, with the rejects left for inspection.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional, Sequence, Tuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import IntegralType, StringType, StructField, StructType, TimestampType

from ..functions.rules import ident, sql_literal
from ..operators.prepare import qcol

_LINE = "_malformed_line"


class TooManyRejects(ValueError):
    """More rows were set aside than the caller allows; ``load`` still has them."""

    def __init__(self, load: "CsvLoad", limit: float):
        super().__init__(f"{load.rejected_rows} of {load.total_rows} rows were rejected, more than {limit:.2%}; see {load.path}")
        self.load = load


@dataclass(frozen=True)
class CsvLoad:
    """A loaded CSV: the good rows, the faults, and the counts of both."""

    staged: DataFrame
    path: str
    columns: Tuple[str, ...]
    total_rows: int
    rejected_rows: int

    @property
    def rows(self) -> DataFrame:
        # Columns are stored by number, so that the file's names cannot clash with the stage's own.
        return self.staged.where("not rejected").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(self.columns)])

    @property
    def rejects(self) -> DataFrame:
        """(source_file, row_key, column, raw, reason), one row per fault."""
        return self.staged.where("rejected").select("source_file", "row_key", F.inline("faults"))

    def report(self) -> DataFrame:
        """One row per column and reason: how many values were rejected."""
        return self.rejects.groupBy("column", "reason").agg(F.count(F.lit(1)).alias("faults"))


def _typed(f: StructField) -> str:
    """SQL of the value as the column's type; NULL where it cannot be read."""
    c = ident(f.name)
    if isinstance(f.dataType, StringType):
        return c
    if isinstance(f.dataType, TimestampType):
        return f"try_to_timestamp({c})"
    if isinstance(f.dataType, IntegralType):
        # Integers may be written as 2.98e13 or 29872499824296.0; a fraction is a fault.
        d = f"try_cast({c} AS DECIMAL(38, 4))"
        return f"CASE WHEN {d} = floor({d}) THEN try_cast({d} AS {f.dataType.simpleString()}) END"
    return f"try_cast({c} AS {f.dataType.simpleString()})"


def _faults(schema: StructType, required: Sequence[str]) -> str:
    def fault(when: str, column: str, raw: str, reason: str) -> str:
        return (f"CASE WHEN {when} THEN named_struct('column', {sql_literal(column)}, 'raw', {raw}, "
                f"'reason', {sql_literal(reason)}) END")

    found = [fault(f"{_LINE} IS NOT NULL", "", _LINE, "malformed line")]
    for f in schema.fields:
        c = ident(f.name)
        if not isinstance(f.dataType, StringType):
            found.append(fault(f"{_LINE} IS NULL AND {c} IS NOT NULL AND {_typed(f)} IS NULL", f.name, c, f"not a {f.dataType.simpleString()}"))
        if f.name in required:
            found.append(fault(f"{_LINE} IS NULL AND {c} IS NULL", f.name, c, "missing"))
    return f"filter(array({', '.join(found)}), x -> x IS NOT NULL)"


def read_csv_lines(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    """The schema's columns of a headed CSV as text, in the header's order whatever it is, with the whole line where it
    has too few or too many fields; refused if the header lacks a column."""
    header = spark.read.options(header="true", **options).csv(path).columns
    absent = [f.name for f in schema.fields if f.name not in header]
    if absent:
        raise ValueError(f"CSV header lacks columns {absent}; it has {header}")
    text = StructType([StructField(c, StringType()) for c in header] + [StructField(_LINE, StringType())])
    # With columns pruned, the parser would not see that a line has too few or too many fields.
    raw = spark.read.schema(text).options(header="true", mode="PERMISSIVE", columnNameOfCorruptRecord=_LINE, enforceSchema="false",
                                          columnPruning="false", **options).csv(path)
    return raw.select(*[qcol(f.name) for f in schema.fields], _LINE, F.col("_metadata.file_path").alias("_file"))


def load_csv(spark: SparkSession, path: str, schema: StructType, staged: str, key: str, required: Optional[Sequence[str]] = None,
             max_reject_share: float = 0.01, **options) -> CsvLoad:
    """Type, check and stage a headed CSV in one pass (see the module's text).

    ``staged``: the folder of the staged table; ``key``: the column that names a row in the rejects; ``required``: the
    columns that may not be empty (by default the key)."""
    lines = read_csv_lines(spark, path, schema, **options)
    checked = lines.withColumn("faults", F.expr(_faults(schema, [key] if required is None else required)))
    counts = Observation()
    bad: Column = F.size("faults") > 0
    typed = checked.select(*[F.expr(_typed(f)).alias(f"c{i}") for i, f in enumerate(schema.fields)],
                           F.col("_file").alias("source_file"), qcol(key).alias("row_key"), "faults", bad.alias("rejected"))
    (typed.observe(counts, F.count(F.lit(1)).alias("total"), F.count_if("rejected").alias("rejected"))
     .write.partitionBy("rejected").parquet(staged))
    table = spark.read.schema(typed.schema).parquet(staged)
    got = counts.get
    load = CsvLoad(table, staged, tuple(f.name for f in schema.fields), got["total"], got["rejected"])
    if load.rejected_rows > max_reject_share * load.total_rows:
        raise TooManyRejects(load, max_reject_share)
    return load
