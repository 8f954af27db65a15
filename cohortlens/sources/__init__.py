"""Event-table readers and the fixture views built over the provided tables."""

from .events import (
    REFERENCE_CSV_SCHEMA, cast_by_name, csv_cast_report, normalise_reference_csv, read_csv_text, read_events,
)
from .fixtures import appointment_view, clinic_view, line_keys, nation_rates, read_table, shipment_view

__all__ = [
    "REFERENCE_CSV_SCHEMA", "cast_by_name", "csv_cast_report", "normalise_reference_csv", "read_csv_text", "read_events",
    "appointment_view", "clinic_view", "line_keys", "nation_rates", "read_table", "shipment_view",
]
