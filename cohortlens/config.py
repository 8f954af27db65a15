"""Column roles, audit parameters and the fixed values the audits must reproduce.

Nothing in the operators is tied to one dataset: every physical column name,
label, threshold and rate lives here as a parameter whose default reproduces
the published audit.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Mapping, Optional, Sequence, Tuple

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the published audit for its results to match.
# Labels, thresholds, rates and the 13 reconciliation checkpoints, verbatim.
# ---------------------------------------------------------------------------
WALL_DAY = 10
ADULT_AGE = 18
PRE_WALL_DAYS = (1, 9)
POST_WALL_DAYS = (10, 30)

BEYOND_WALL_LABEL = "Beyond Trust Wall"
SAFE_ZONE_LABEL = "Operational Safe Zone"
TRIPLE_THREAT_LABEL = "Triple Threat"
HIGH_ACUITY_LABEL = "High-Acuity"
BASELINE_LABEL = "Baseline"
MINOR_LABEL = "Guardian-Advocate (Minor)"
ADULT_LABEL = "Self-Advocate (Adult)"

SCHOLARSHIP_RATE = 120  # payer = 1 (Medicaid benchmark)
DEFAULT_RATE = 210      # any other payer value, NULL included (commercial benchmark)

OUTCOME_TEXT = {"Yes": True, "No": False}

# (label, expected, tolerance) — the published scorecard, in its own order.
REFERENCE_CHECKPOINTS: Tuple[Tuple[str, float, float], ...] = (
    ("Total records (raw)", 110527.0, 0.0),
    ("Distinct AppointmentIDs", 110527.0, 0.0),
    ("Post lead-time filter count", 110522.0, 0.0),
    ("Triple Threat avg lead time (d)", 12.2, 0.5),
    ("No-conditions avg lead time (d)", 16.1, 0.5),
    ("Day 10 no-show rate (%)", 31.6, 1.0),
    ("SMS=1 no-show rate (%)", 27.6, 0.5),
    ("SMS=0 no-show rate (%)", 16.7, 0.5),
    ("SMS no-show avg lead time (d)", 20.0, 1.0),
    ("Disabled no-show avg LT (d)", 13.0, 0.5),
    ("Baseline no-show avg LT (d)", 15.9, 0.5),
    ("Minors no-show rate (%)", 21.9, 0.5),
    ("Adults no-show rate (%)", 19.63, 0.5),
)
# ---------------------------------------------------------------------------

SCOPES = ("raw", "valid", "production")


@dataclass(frozen=True)
class ColumnMap:
    """Maps logical roles to physical column names of an events table.

    ``outcome_values`` maps outcome text to a boolean (``{"Yes": True, ...}``);
    ``None`` means the outcome column is already boolean.
    """

    key: str = "AppointmentID"
    entity: Optional[str] = "PatientId"
    booked_at: str = "ScheduledDay"
    due_at: str = "AppointmentDay"
    outcome: str = "No-show"
    outcome_values: Optional[Mapping[str, bool]] = None
    attributes: Tuple[str, ...] = (
        "Gender", "Age", "Scholarship", "Hipertension", "Diabetes",
        "Alcoholism", "Handcap", "SMS_received",
    )

    def with_(self, **kw) -> "ColumnMap":
        return replace(self, **kw)


# The warehouse table of the audit stores the outcome as a boolean `No-show`.
WAREHOUSE_COLUMNS = ColumnMap()
# The CSV extract stores it as Yes/No text.
CSV_COLUMNS = ColumnMap(outcome_values=OUTCOME_TEXT)


@dataclass(frozen=True)
class Names:
    """Output column names; defaults are the audit's own."""

    lead: str = "lead_time"
    outcome: str = "no_show_status"
    booked_date: str = "scheduled_date"
    due_date: str = "appointment_date"
    entity_present: str = "entity_present"
    volume: str = "total_patient_volume"
    avg_lead: str = "avg_lead_time"
    band: str = "trust_wall_status"
    tier: str = "acuity_tier"
    age_class: str = "advocacy_type"
    disabled: str = "is_disabled"


@dataclass(frozen=True)
class AuditParams:
    """Thresholds, labels and rates of the audit. Defaults reproduce it."""

    wall: int = WALL_DAY
    adult_age: int = ADULT_AGE
    pre: Tuple[int, int] = PRE_WALL_DAYS
    post: Tuple[int, int] = POST_WALL_DAYS
    digits: int = 1
    payer: str = "Scholarship"
    rate_card: Tuple[Tuple[int, int], ...] = ((1, SCHOLARSHIP_RATE),)
    default_rate: int = DEFAULT_RATE
    age: str = "Age"
    level: str = "Handcap"
    conditions: Tuple[str, str, str] = ("Hipertension", "Diabetes", "Alcoholism")
    sms: str = "SMS_received"
    gender: str = "Gender"
    # the single cohort of cohort_volume: gender and payer values
    volume_cohort: Tuple[object, object] = ("M", 1)
    labels: Mapping[str, str] = field(default_factory=lambda: {
        "beyond": BEYOND_WALL_LABEL,
        "safe": SAFE_ZONE_LABEL,
        "triple": TRIPLE_THREAT_LABEL,
        "high": HIGH_ACUITY_LABEL,
        "baseline": BASELINE_LABEL,
        "minor": MINOR_LABEL,
        "adult": ADULT_LABEL,
    })
    names: Names = field(default_factory=Names)

    def with_(self, **kw) -> "AuditParams":
        return replace(self, **kw)


def check_scope(scope: str) -> str:
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}, got {scope!r}")
    return scope


def as_list(cols: Sequence[str] | str) -> list:
    return [cols] if isinstance(cols, str) else list(cols)
