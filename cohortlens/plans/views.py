"""Named views of the audit layers, for Spark SQL users.

``register_audit_views`` exposes the events and the derived layers as
session temp views, so audits can also be written as ``spark.sql(...)``
(Catalyst plans them exactly like the DataFrame forms):

* ``appointments_raw``          — the events as given;
* ``appointments_enriched_v2``  — valid-lead rows with ``lead_time``,
  ``has_diabetes``/``has_hypertension``/``has_alcoholism``,
  ``missed_appointment`` (INT 0/1) and ``sms_received``;
* ``appointment_segmentation``  — production rows with the four label layers.

Views are lazy: registering them reads nothing.
"""

from __future__ import annotations

from typing import Dict, Optional

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import AuditParams, ColumnMap, WAREHOUSE_COLUMNS
from ..functions.rules import ident

VIEW_NAMES = {
    "raw": "appointments_raw",
    "enriched": "appointments_enriched_v2",
    "segmented": "appointment_segmentation",
}


def audit_views(events: DataFrame, cmap: ColumnMap = WAREHOUSE_COLUMNS,
                params: AuditParams = AuditParams()) -> Dict[str, DataFrame]:
    from .audit import Audit
    a = Audit(events, cmap, params, order=False)
    n = params.names
    enriched = (a.base("valid")
                .withColumn("missed_appointment", F.expr(f"CAST({ident(n.outcome)} AS INT)"))
                .withColumnRenamed(params.sms, "sms_received"))
    return {"raw": events, "enriched": enriched, "segmented": a.base("production")}


def register_audit_views(spark: SparkSession, events: DataFrame, cmap: ColumnMap = WAREHOUSE_COLUMNS,
                         params: AuditParams = AuditParams(),
                         names: Optional[Dict[str, str]] = None) -> Dict[str, str]:
    """Create or replace the temp views; returns {layer: view name}."""
    names = {**VIEW_NAMES, **(names or {})}
    for layer, df in audit_views(events, cmap, params).items():
        df.createOrReplaceTempView(names[layer])
    return names
