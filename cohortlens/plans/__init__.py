"""Named audit plans over an events table (direct and cube-served)."""

from .audit import (
    CUBE_SERVED, FULL_AUDIT_SPECS, GROUPED_AUDITS, SPEC_BY_NAME, Audit, cube_audit, full_audit_specs,
    grouped_audits,
)
from .registry import build_queries
from .views import audit_views, register_audit_views

__all__ = ["Audit", "cube_audit", "CUBE_SERVED", "FULL_AUDIT_SPECS", "GROUPED_AUDITS", "SPEC_BY_NAME",
           "full_audit_specs", "grouped_audits", "build_queries", "audit_views",
           "register_audit_views"]
