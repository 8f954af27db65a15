"""DataFrame -> DataFrame operators of the audit (lazy; no actions inside,
except the explicit validation helpers that say so)."""

from .prepare import prepare, qcol
from .segment import segment
from .quality import duplicate_keys, integrity_check, column_profile, load_profile, outcome_report, sample_rows, scope_report
from .cohorts import (
    CurveNames, Gap, cohort_gaps, cohort_metric, cohort_summary, pick, rate_by,
    rate_curve, reference_gaps, share_of, threshold_contrast,
)
from .bitmaps import (
    BitmapPass, bitmap_integrity, count_bitmaps, dense_integer_key, distinct_bitmaps, merge_bitmaps,
)
from .ordering import in_position, with_position
from .metrics import Metric, evaluate, metrics_long, reference_checkpoint_metrics
from .exposure import (
    EXPOSURE_DIMS, exposure_dims, exposure_summary, fiscal_leak, fiscal_leak_total, check_rate_table, with_exposure,
    rate_expr, validate_rate_card,
)
from .reconcile import long_metrics, one_pass_metrics, reconcile, reference_metrics, scorecard_summary
from .cube import AuditSpec, CohortCube, cube_keys

__all__ = [name for name in dir() if not name.startswith("_")]
