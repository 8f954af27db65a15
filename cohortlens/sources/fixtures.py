"""Fixture views over the provided TPC-H-like tables (see FIXTURES.md).

F1 ``appointment_view``: one appointment per order with planted effects.
F2 ``shipment_view``: one appointment per line item, booked on the order
    date and due on the ship date (a real join, real date spread).
F5 ``clinic_view``: one appointment per order with independent conditions, NULLs, text outcome and zoned timestamps.
F3 ``line_keys``: line items keyed by (order, line number) — not unique.

Every column is a SQL expression over the scan (one ``selectExpr``), so
Catalyst prunes the scan to the two or three source columns an audit
actually needs.  Tables are read with their known schema: no footer read
for inference, and a drifted file fails loudly instead of changing types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_SCHEMAS = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = TABLE_SCHEMAS.get(name)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def _threshold(g: str) -> str:
    # planted no-show probability (%) by lead day: 5 on day <= 0, 25 on days 1-9, 33 from day 10
    return f"CASE WHEN {g} <= 0 THEN 5 WHEN {g} < 10 THEN 25 ELSE 33 END"


def _attributes(k: str, c: str) -> list:
    return [
        f"CASE WHEN {k} % 1000 = 7 THEN CAST(NULL AS BIGINT) ELSE {c} END AS PatientId",
        f"CASE WHEN {c} % 3 = 0 THEN 'M' ELSE 'F' END AS Gender",
    ]


def _flags(c: str) -> list:
    return [
        f"CAST({c} % 95 AS INT) AS Age",
        f"CASE WHEN {c} % 10 = 0 THEN 1 ELSE 0 END AS Scholarship",
        f"CASE WHEN {c} % 5 = 0 THEN 1 ELSE 0 END AS Hipertension",
        f"CASE WHEN {c} % 15 = 0 THEN 1 ELSE 0 END AS Diabetes",
        f"CASE WHEN {c} % 30 = 0 THEN 1 ELSE 0 END AS Alcoholism",
        f"CASE WHEN {c} % 49 = 0 THEN 2 ELSE 0 END AS Handcap",
    ]


def appointment_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the appointments table shape (``No-show`` BOOLEAN) over ``orders``."""
    o = read_table(spark, sf_dir, "orders")
    g = "CAST((o_orderkey * 37) % 63 - 2 AS INT)"
    sched = "CAST(o_orderdate AS DATE)"
    pid, gender = _attributes("o_orderkey", "o_custkey")
    return o.selectExpr(
        pid,
        "o_orderkey AS AppointmentID",
        gender,
        f"{sched} AS ScheduledDay",
        f"date_add({sched}, {g}) AS AppointmentDay",
        *_flags("o_custkey"),
        f"CASE WHEN {g} >= 3 AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS SMS_received",
        f"(o_orderkey * 7919) % 100 < {_threshold(g)} AS `No-show`",
    )


def shipment_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one appointment per line item; ``lineitem`` joined to ``orders``.

    Both sides are large at scale, so the join is left to Catalyst (sort-merge
    on the order key, AQE splitting a hot key); no broadcast is forced.
    """
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"], "inner")
    sched, due = "CAST(o_orderdate AS DATE)", "CAST(l_shipdate AS DATE)"
    lead = f"datediff({due}, {sched})"
    pid, gender = _attributes("o_orderkey", "o_custkey")
    return j.selectExpr(
        pid,
        "o_orderkey * 100 + l_linenumber AS AppointmentID",
        gender,
        f"{sched} AS ScheduledDay",
        f"{due} AS AppointmentDay",
        *_flags("o_custkey"),
        f"CASE WHEN {lead} >= 3 AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS SMS_received",
        f"(o_orderkey * 7919 + l_linenumber) % 100 < {_threshold(lead)} AS `No-show`",
    )


def clinic_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one appointment per order that exercises what F1 cannot: conditions that are independent of each other,
    NULL in every attribute, Yes/No text with a stray value and NULLs, zoned timestamps with times of day, leads from
    -2 to 117 days, and missing due dates."""
    o = read_table(spark, sf_dir, "orders")
    k, c = "o_orderkey", "o_custkey"
    g = f"CAST(({k} * 37) % 120 - 2 AS INT)"
    sched = "CAST(o_orderdate AS DATE)"

    gender = f"CASE WHEN {c} % 3 = 0 THEN 'M' ELSE 'F' END"

    def at(day: str, hours: str) -> str:
        return f"CAST({day} AS TIMESTAMP) + make_dt_interval(0, CAST({hours} AS INT))"

    def sometimes(every: str, expr: str) -> str:
        return f"CASE WHEN {every} THEN NULL ELSE {expr} END"

    return o.selectExpr(
        f"{sometimes(f'{k} % 1000 = 7', c)} AS PatientId",
        f"{k} AS AppointmentID",
        f"{sometimes(f'{c} % 37 = 0', gender)} AS Gender",
        f"{at(sched, f'{k} % 24')} AS ScheduledDay",
        f"{sometimes(f'{k} % 53 = 0', at(f'date_add({sched}, {g})', f'{k} % 7'))} AS AppointmentDay",
        f"{sometimes(f'{c} % 23 = 0', f'CAST({c} % 95 AS INT)')} AS Age",
        f"{sometimes(f'{c} % 31 = 0', f'CASE WHEN {c} % 10 < 3 THEN 1 ELSE 0 END')} AS Scholarship",
        f"CASE WHEN {c} % 5 < 2 THEN 1 ELSE 0 END AS Hipertension",
        f"CASE WHEN {c} % 7 < 3 THEN 1 ELSE 0 END AS Diabetes",
        f"CASE WHEN {c} % 11 < 4 THEN 1 ELSE 0 END AS Alcoholism",
        f"{sometimes(f'{c} % 29 = 0', f'CAST({c} % 3 AS INT)')} AS Handcap",
        f"CASE WHEN {g} >= 3 AND {k} % 3 = 0 THEN 1 ELSE 0 END AS SMS_received",
        f"CASE WHEN {k} % 41 = 0 THEN NULL WHEN {k} % 43 = 0 THEN 'Maybe' "
        f"WHEN ({k} * 7919) % 100 < {_threshold(g)} THEN 'Yes' ELSE 'No' END AS `No-show`",
    )


def nation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate-card table: payer n_nationkey (0 is left to the default rate), rate 100 + 10 x n_nationkey."""
    nation = spark.read.parquet(f"{sf_dir.rstrip('/')}/nation.parquet")
    return nation.where("n_nationkey > 0").selectExpr("n_nationkey AS payer", "100 + 10 * n_nationkey AS rate")


def line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the line-item key pair, which holds duplicates."""
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
