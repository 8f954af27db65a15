"""cohortlens — cohort audits of scheduled events on Spark DataFrames.

Derive lead time, label segments from ordered rules, summarise volume, mean
lead time and outcome rate per cohort, trace the rate by lead day, price
missed events with a rate card, check keys, and reconcile metrics against
expected values — all as lazy DataFrame plans, with a compact cohort cube
so a full audit needs one scan.
"""

from .config import (
    AuditParams, ColumnMap, CSV_COLUMNS, Names, REFERENCE_CHECKPOINTS, WAREHOUSE_COLUMNS,
)
from .operators import *  # noqa: F401,F403
from .operators import __all__ as _ops
from .plans import Audit, FULL_AUDIT_SPECS, GROUPED_AUDITS, cube_audit, full_audit_specs, grouped_audits
from .sources import appointment_view, line_keys, read_events, shipment_view
from .functions import Segment, reference_segments

__all__ = list(_ops) + [
    "AuditParams", "ColumnMap", "CSV_COLUMNS", "Names", "REFERENCE_CHECKPOINTS",
    "WAREHOUSE_COLUMNS", "Audit", "FULL_AUDIT_SPECS", "GROUPED_AUDITS", "cube_audit",
    "full_audit_specs", "grouped_audits",
    "appointment_view", "line_keys", "read_events", "shipment_view", "Segment",
    "reference_segments",
]
