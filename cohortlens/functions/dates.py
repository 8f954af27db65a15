"""Timestamp -> date and day-difference expressions (SQL text)."""

from __future__ import annotations

from pyspark.sql.types import DataType, DateType, StringType


def to_utc_date_sql(expr: str, dtype: DataType) -> str:
    """Calendar date of a booked/due value, as SQL text.

    Dates pass through; timestamps are cast in the session time zone (which
    ``prepare`` requires to be UTC for zoned timestamps); ISO text such as
    ``2016-04-29T18:38:08Z`` is parsed first, keeping its offset; text that is
    no timestamp gives NULL (a NULL lead, which the scope report counts).
    """
    if isinstance(dtype, DateType):
        return expr
    if isinstance(dtype, StringType):
        return f"to_date(try_to_timestamp({expr}))"
    return f"CAST({expr} AS DATE)"


def lead_days_sql(due: str, booked: str) -> str:
    """Whole days from booking to due date (INT, negative when due first)."""
    return f"datediff({due}, {booked})"
