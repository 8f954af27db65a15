"""Reading an events table from Parquet, a catalog table or a headed CSV.

CSV columns are taken by the header's names, in any order, and cast to the
given schema (no ``inferSchema`` pass: inference costs a full extra scan and
turns an id written ``29872499824296.0`` into a DOUBLE).  A column that the
header lacks is refused; ``csv_cast_report`` counts, per column, the values
that could not be cast.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.rules import sql_literal
from ..operators.prepare import qcol
from pyspark.sql.types import (
    IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)

# Column layout of the public appointment extract (CSV with header).
REFERENCE_CSV_SCHEMA = StructType([
    StructField("PatientId", StringType()),
    StructField("AppointmentID", LongType()),
    StructField("Gender", StringType()),
    StructField("ScheduledDay", StringType()),
    StructField("AppointmentDay", StringType()),
    StructField("Age", IntegerType()),
    StructField("Neighbourhood", StringType()),
    StructField("Scholarship", IntegerType()),
    StructField("Hipertension", IntegerType()),
    StructField("Diabetes", IntegerType()),
    StructField("Alcoholism", IntegerType()),
    StructField("Handcap", IntegerType()),
    StructField("SMS_received", IntegerType()),
    StructField("No-show", StringType()),
])

# The same columns as their own types, for ``load_csv``: ids as BIGINT (also where written 2.98e13), days as timestamps.
REFERENCE_CSV_TYPES = StructType([
    StructField(f.name, {"PatientId": LongType(), "ScheduledDay": TimestampType(), "AppointmentDay": TimestampType()}.get(f.name, f.dataType))
    for f in REFERENCE_CSV_SCHEMA.fields])


def read_events(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: Optional[StructType] = None,
    **options,
) -> DataFrame:
    """Lazy scan of an events table.  ``fmt`` is parquet, orc, csv, json or table."""
    if fmt == "table":
        return spark.table(path)
    if fmt == "csv":
        if schema is None:
            raise ValueError("csv sources need an explicit schema")
        return cast_by_name(read_csv_text(spark, path, schema, **options), schema)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "json":
        raise ValueError("json sources need an explicit schema")
    return reader.options(**options).format(fmt).load(path)


def read_csv_text(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    """The schema's columns of a headed CSV, as text; refused if the header lacks one of them."""
    raw = spark.read.options(header="true", mode="PERMISSIVE", **options).csv(path)
    absent = [f.name for f in schema.fields if f.name not in raw.columns]
    if absent:
        raise ValueError(f"CSV header lacks columns {absent}; it has {raw.columns}")
    return raw.select(*[qcol(f.name) for f in schema.fields])


def cast_by_name(text: DataFrame, schema: StructType) -> DataFrame:
    """Every column cast to its type; what cannot be cast is NULL (see ``csv_cast_report``)."""
    return text.select(*[qcol(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def csv_cast_report(text: DataFrame, schema: StructType) -> DataFrame:
    """Per column of a text table: rows, null values, and values that cannot be cast to the schema's type."""
    aggs = []
    for i, f in enumerate(schema.fields):
        c = qcol(f.name)
        aggs += [F.count_if(c.isNull()).alias(f"_n{i}"),
                 F.count_if(c.isNotNull() & c.try_cast(f.dataType).isNull()).alias(f"_f{i}")]
    rows = ", ".join(f"struct({i + 1} AS position, {sql_literal(f.name)} AS name, _rows AS rows, _n{i} AS nulls, _f{i} AS cast_failures)"
                     for i, f in enumerate(schema.fields))
    return text.agg(F.count(F.lit(1)).alias("_rows"), *aggs).selectExpr(f"inline(array({rows}))")


def normalise_reference_csv(df: DataFrame) -> DataFrame:
    """Repair the CSV's id column: text like ``2.98e13`` or ``29872499824296.0`` -> BIGINT."""
    pid = F.col("PatientId")
    return df.withColumn("PatientId", pid.cast("decimal(38,2)").cast("long"))
