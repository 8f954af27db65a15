"""DuckDB oracle: the same audits as plain SQL over the raw tables.

Views ``orders`` and ``lineitem`` (and the rest) are registered by the
caller.  Types are pinned to Spark's: counts BIGINT, lead INTEGER, rates and
means DOUBLE (no DECIMAL literals), division by zero -> NULL.
"""

from __future__ import annotations

from typing import Dict, Sequence

# FIXED VALUES of the published audit, stated here a second time so that a wrong constant in the package shows.
WALL_DAY, ADULT_AGE = 10, 18
PRE_WALL_DAYS, POST_WALL_DAYS = (1, 9), (10, 30)
BEYOND_WALL_LABEL, SAFE_ZONE_LABEL = "Beyond Trust Wall", "Operational Safe Zone"
TRIPLE_THREAT_LABEL, HIGH_ACUITY_LABEL, BASELINE_LABEL = "Triple Threat", "High-Acuity", "Baseline"
MINOR_LABEL, ADULT_LABEL = "Guardian-Advocate (Minor)", "Self-Advocate (Adult)"
SCHOLARSHIP_RATE, DEFAULT_RATE = 120, 210
CHECKPOINTS = (
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
ANCHORS = (
    ("Day 10 no-show rate (%)", 33.0, 15.0),
    ("SMS=1 no-show rate (%)", 32.0, 6.0),
    ("SMS=0 no-show rate (%)", 31.0, 6.0),
    ("SMS no-show avg lead time (d)", 32.0, 6.0),
    ("Adults no-show rate (%)", 31.0, 6.0),
)


def _text_keys(sql: str, keys: Sequence[str]) -> str:
    """The query with its cohort keys as text."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({k} AS VARCHAR) AS {k}' for k in keys)}) FROM ({sql})"


def _counts(sql: str) -> str:
    """COUNT_IF(c) as COUNT(CASE WHEN c THEN 1 END): DuckDB's COUNT_IF is NULL where every condition is NULL, SQL counts 0."""
    while "COUNT_IF(" in sql:
        head, _, rest = sql.partition("COUNT_IF(")
        depth, end = 1, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
        sql = f"{head}COUNT(CASE WHEN {rest[:end - 1]} THEN 1 END){rest[end:]}"
    return sql


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"

# F1 — one appointment per order (FIXTURES.md).
_APPT = """
appt_g AS (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS sched,
         CAST((o_orderkey * 37) % 63 - 2 AS INTEGER) AS g
  FROM orders
),
appt AS (
  SELECT
    CASE WHEN k % 1000 = 7 THEN NULL ELSE c END AS PatientId,
    k AS AppointmentID,
    CASE WHEN c % 3 = 0 THEN 'M' ELSE 'F' END AS Gender,
    sched AS ScheduledDay,
    sched + g AS AppointmentDay,
    CAST(c % 95 AS INTEGER) AS Age,
    CASE WHEN c % 10 = 0 THEN 1 ELSE 0 END AS Scholarship,
    CASE WHEN c % 5 = 0 THEN 1 ELSE 0 END AS Hipertension,
    CASE WHEN c % 15 = 0 THEN 1 ELSE 0 END AS Diabetes,
    CASE WHEN c % 30 = 0 THEN 1 ELSE 0 END AS Alcoholism,
    CASE WHEN c % 49 = 0 THEN 2 ELSE 0 END AS Handcap,
    CASE WHEN g >= 3 AND k % 3 = 0 THEN 1 ELSE 0 END AS SMS_received,
    (k * 7919) % 100 < CASE WHEN g <= 0 THEN 5 WHEN g < 10 THEN 25 ELSE 33 END AS "No-show"
  FROM appt_g
)"""

# F2 — one appointment per line item, booked on the order date, due on the ship date.
_SHIP = """
ship_g AS (
  SELECT o_orderkey AS k, o_custkey AS c, l_linenumber AS ln,
         CAST(o_orderdate AS DATE) AS sched, CAST(l_shipdate AS DATE) AS due,
         CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS g
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
appt AS (
  SELECT
    CASE WHEN k % 1000 = 7 THEN NULL ELSE c END AS PatientId,
    k * 100 + ln AS AppointmentID,
    CASE WHEN c % 3 = 0 THEN 'M' ELSE 'F' END AS Gender,
    sched AS ScheduledDay,
    due AS AppointmentDay,
    CAST(c % 95 AS INTEGER) AS Age,
    CASE WHEN c % 10 = 0 THEN 1 ELSE 0 END AS Scholarship,
    CASE WHEN c % 5 = 0 THEN 1 ELSE 0 END AS Hipertension,
    CASE WHEN c % 15 = 0 THEN 1 ELSE 0 END AS Diabetes,
    CASE WHEN c % 30 = 0 THEN 1 ELSE 0 END AS Alcoholism,
    CASE WHEN c % 49 = 0 THEN 2 ELSE 0 END AS Handcap,
    CASE WHEN g >= 3 AND k % 3 = 0 THEN 1 ELSE 0 END AS SMS_received,
    (k * 7919 + ln) % 100 < CASE WHEN g <= 0 THEN 5 WHEN g < 10 THEN 25 ELSE 33 END AS "No-show"
  FROM ship_g
)"""

_TIER = (f"CASE WHEN Hipertension = 1 AND Diabetes = 1 AND Alcoholism = 1 THEN {_q(TRIPLE_THREAT_LABEL)} "
         f"WHEN Hipertension = 1 AND Diabetes = 1 THEN {_q(HIGH_ACUITY_LABEL)} ELSE {_q(BASELINE_LABEL)} END")
_MINOR, _ADULT, _BEYOND = _q(MINOR_LABEL), _q(ADULT_LABEL), _q(BEYOND_WALL_LABEL)

# F5 — one appointment per order: independent conditions, NULLs, text outcome, timestamps.
_CLINIC = """
clinic_g AS (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS sched,
         CAST((o_orderkey * 37) % 120 - 2 AS INTEGER) AS g
  FROM orders
),
appt AS (
  SELECT
    CASE WHEN k % 1000 = 7 THEN NULL ELSE c END AS PatientId,
    k AS AppointmentID,
    CASE WHEN c % 37 = 0 THEN NULL WHEN c % 3 = 0 THEN 'M' ELSE 'F' END AS Gender,
    sched AS ScheduledDay,
    CASE WHEN k % 53 = 0 THEN NULL ELSE sched + g END AS AppointmentDay,
    CASE WHEN c % 23 = 0 THEN NULL ELSE CAST(c % 95 AS INTEGER) END AS Age,
    CASE WHEN c % 31 = 0 THEN NULL WHEN c % 10 < 3 THEN 1 ELSE 0 END AS Scholarship,
    CASE WHEN c % 5 < 2 THEN 1 ELSE 0 END AS Hipertension,
    CASE WHEN c % 7 < 3 THEN 1 ELSE 0 END AS Diabetes,
    CASE WHEN c % 11 < 4 THEN 1 ELSE 0 END AS Alcoholism,
    CASE WHEN c % 29 = 0 THEN NULL ELSE CAST(c % 3 AS INTEGER) END AS Handcap,
    CASE WHEN g >= 3 AND k % 3 = 0 THEN 1 ELSE 0 END AS SMS_received,
    CASE WHEN k % 41 = 0 THEN NULL WHEN k % 43 = 0 THEN 'Maybe'
         WHEN (k * 7919) % 100 < CASE WHEN g <= 0 THEN 5 WHEN g < 10 THEN 25 ELSE 33 END THEN 'Yes' ELSE 'No' END AS "No-show"
  FROM clinic_g
)"""


# base / segmentation / scopes, shared by the fixtures
def _layers(wall: int = WALL_DAY, adult_age: int = ADULT_AGE, outcome: str = '"No-show"') -> str:
    return f"""
raw AS (
  SELECT *,
    {outcome} AS no_show_status,
    CAST(date_diff('day', ScheduledDay, AppointmentDay) AS INTEGER) AS lead_time
  FROM appt
),
seg AS (
  SELECT *,
    CASE WHEN lead_time >= {wall} THEN {_BEYOND} ELSE {_q(SAFE_ZONE_LABEL)} END AS trust_wall_status,
    {_TIER} AS acuity_tier,
    {_TIER} AS patient_acuity,
    CASE WHEN Age < {adult_age} THEN {_MINOR} ELSE {_ADULT} END AS advocacy_type,
    CASE WHEN Handcap > 0 THEN 1 ELSE 0 END AS is_disabled,
    CAST(Diabetes AS INTEGER) AS has_diabetes,
    CAST(Hipertension AS INTEGER) AS has_hypertension,
    CAST(Alcoholism AS INTEGER) AS has_alcoholism
  FROM raw
),
v AS (SELECT * FROM seg WHERE lead_time >= 0),
p AS (SELECT * FROM v WHERE PatientId IS NOT NULL)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


F1 = _with(_APPT, _layers())
F2 = _with(_SHIP, _layers())
F5 = _with(_CLINIC, _layers(outcome="""CASE WHEN "No-show" = 'Yes' THEN TRUE WHEN "No-show" = 'No' THEN FALSE END"""))
# F5 without the rows whose extract has a fault, and F5 where some booking days are no days
F5_CLEAN = F5.replace("FROM clinic_g\n", "FROM clinic_g WHERE NOT (k % 97 = 5 OR k % 101 = 3 OR k % 103 = 4)\n")
F5_TEXT = F5.replace("sched AS ScheduledDay", "CASE WHEN k % 103 = 4 THEN NULL ELSE sched END AS ScheduledDay")

# grouped audits: name -> (keys, scope view, missed only, volume name, avg name, avg first)
_GROUPED = [
    ("baseline_volume", ["Scholarship", "no_show_status"], "v", False),
    ("gender_payer", ["Gender", "Scholarship", "no_show_status"], "v", False),
    ("chronic_conditions", ["Diabetes", "Hipertension", "no_show_status"], "v", False),
    ("condition_combinations", ["has_diabetes", "has_hypertension", "has_alcoholism"], "v", True),
    ("acuity_tiers", ["patient_acuity", "no_show_status"], "v", False),
    ("wall_by_payer", ["Scholarship", "trust_wall_status", "no_show_status"], "v", False),
    ("wall_by_payer_prod", ["Scholarship", "trust_wall_status", "no_show_status"], "p", False),
    ("reminder_outcome", ["SMS_received", "no_show_status"], "v", False),
    ("reminder_band", ["SMS_received", "trust_wall_status", "no_show_status"], "p", False),
    ("disability_outcome", ["is_disabled", "no_show_status"], "v", False),
    ("disability_band", ["is_disabled", "trust_wall_status", "no_show_status"], "p", False),
    ("age_class_outcome", ["advocacy_type", "no_show_status"], "v", False),
    ("age_class_band", ["advocacy_type", "trust_wall_status", "no_show_status"], "p", False),
    ("lead_by_outcome", ["no_show_status"], "v", False),
]


def _grouped_sql(keys: Sequence[str], view: str, missed_only: bool, base: str = F1) -> str:
    k = ", ".join(keys)
    if missed_only:
        return (f"{base}\nSELECT {k}, ROUND(AVG(lead_time), 1) AS avg_lead_time_no_show, "
                f"COUNT(*) AS total_no_shows FROM {view} WHERE no_show_status GROUP BY {k}")
    return (f"{base}\nSELECT {k}, COUNT(*) AS total_patient_volume, "
            f"ROUND(AVG(lead_time), 1) AS avg_lead_time FROM {view} GROUP BY {k}")


def _rate(num: str, den: str) -> str:
    return f"CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0) * 100"


def _curve(base: str) -> str:
    return f"""{base}
SELECT lead_time AS lead_time_day,
  COUNT(*) AS total_appointments,
  CAST(COUNT_IF(no_show_status) AS BIGINT) AS total_noshows,
  CAST(COUNT_IF(NOT no_show_status) AS BIGINT) AS total_shows,
  ROUND({_rate('COUNT_IF(no_show_status)', 'COUNT(*)')}, 1) AS noshowrate_pct,
  ROUND({_rate('COUNT_IF(NOT no_show_status)', 'COUNT(*)')}, 1) AS show_rate_pct
FROM v GROUP BY lead_time"""


def _exposure_cte(rate: str = f"CASE WHEN Scholarship = 1 THEN {SCHOLARSHIP_RATE} ELSE {DEFAULT_RATE} END") -> str:
    return f"""exposure AS (
  SELECT Scholarship, Gender, trust_wall_status, acuity_tier, SMS_received, no_show_status,
    COUNT(*) AS total_patient_volume,
    ROUND(AVG(lead_time), 1) AS avg_lead_time,
    CAST(COUNT(*) * {rate} AS BIGINT) AS modeled_revenue_impact,
    ROUND(CAST(100 AS DOUBLE) * COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE), 2)
      AS pct_of_total_volume
  FROM p
  GROUP BY Scholarship, Gender, trust_wall_status, acuity_tier, SMS_received, no_show_status
)"""


def _full_audit(base: str, typed: bool = False) -> str:
    """All grouped audits in one table, keys as text in key_1.., or (typed) each key in a column of its own."""
    specs = [(n, k, v, m) for n, k, v, m in _GROUPED] + [
        ("lead_day_curve", ["lead_time"], "v", False),
        ("reminder_rate", ["SMS_received"], "v", False),
    ]
    width = max(len(k) for _, k, _, _ in specs)
    every = list(dict.fromkeys(k for _, keys, _, _ in specs for k in keys))
    parts = []
    for name, keys, view, missed in specs:
        cols = [f"CAST({k} AS VARCHAR) AS key_{i + 1}" for i, k in enumerate(keys)]
        cols += [f"CAST(NULL AS VARCHAR) AS key_{i + 1}" for i in range(len(keys), width)]
        if typed:
            cols = [k if k in keys else f"NULL AS {k}" for k in every]
        where = " WHERE no_show_status" if missed else ""
        parts.append(
            f"SELECT '{name}' AS audit, {', '.join(cols)}, COUNT(*) AS total_patient_volume, "
            f"CAST(COUNT_IF(no_show_status) AS BIGINT) AS total_noshows, "
            f"ROUND(AVG(lead_time), 1) AS avg_lead_time, "
            f"ROUND({_rate('COUNT_IF(no_show_status)', 'COUNT(*)')}, 1) AS noshowrate_pct "
            f"FROM {view}{where} GROUP BY {', '.join(keys)}")
    return base + "\n" + "\nUNION ALL\n".join(parts)


def _scorecard(base: str = F1, checks=CHECKPOINTS) -> str:
    lt = "ROUND(AVG(CASE WHEN lead_time >= 0 AND no_show_status AND {c} THEN lead_time END), 1)"
    rt = "ROUND(" + _rate("COUNT_IF(lead_time >= 0 AND {c} AND no_show_status)",
                          "COUNT_IF(lead_time >= 0 AND {c})") + ", 1)"
    rt_raw = _rate("COUNT_IF(lead_time >= 0 AND {c} AND no_show_status)", "COUNT_IF(lead_time >= 0 AND {c})")
    exprs = [
        "COUNT(*)",
        "COUNT(DISTINCT AppointmentID)",
        "COUNT_IF(lead_time >= 0)",
        lt.format(c="Diabetes = 1 AND Hipertension = 1 AND Alcoholism = 1"),
        lt.format(c="Diabetes = 0 AND Hipertension = 0 AND Alcoholism = 0"),
        rt.format(c=f"lead_time = {WALL_DAY}"),
        rt.format(c="SMS_received = 1"),
        rt.format(c="SMS_received = 0"),
        lt.format(c="SMS_received = 1"),
        lt.format(c="is_disabled = 1"),
        lt.format(c="is_disabled = 0"),
        rt_raw.format(c=f"advocacy_type = {_MINOR}"),
        rt_raw.format(c=f"advocacy_type = {_ADULT}"),
    ]
    m = ", ".join(f"CAST({e} AS DOUBLE) AS m{i}" for i, e in enumerate(exprs))
    actuals = "\n  UNION ALL ".join(
        f"SELECT '{lbl}' AS label, m{i} AS actual FROM m" for i, (lbl, _, _) in enumerate(CHECKPOINTS))
    exp = ", ".join(f"({i}, '{lbl}', CAST({e} AS DOUBLE), CAST({t} AS DOUBLE))"
                    for i, (lbl, e, t) in enumerate(checks))
    return f"""{base},
m AS (SELECT {m} FROM seg),
actuals AS ({actuals}),
expected(seq, label, expected, tol) AS (VALUES {exp})
SELECT e.label, ROUND(a.actual, 4) AS actual, e.expected, e.tol,
  COALESCE(ABS(ROUND(a.actual, 4) - e.expected) <= e.tol, FALSE) AS ok
FROM expected e LEFT JOIN actuals a ON a.label = e.label"""


def _gaps(base: str = F1) -> str:
    lt = "ROUND(AVG(CASE WHEN no_show_status AND {c} THEN lead_time END), 1)"
    rt1 = "ROUND(" + _rate("COUNT_IF({c} AND no_show_status)", "COUNT_IF({c})") + ", 1)"
    rt = _rate("COUNT_IF({c} AND no_show_status)", "COUNT_IF({c})")
    rows = [
        ("condition_compression",
         lt.format(c="Diabetes = 0 AND Hipertension = 0 AND Alcoholism = 0"),
         lt.format(c="Diabetes = 1 AND Hipertension = 1 AND Alcoholism = 1")),
        ("reminder_penalty", rt1.format(c="SMS_received = 1"), rt1.format(c="SMS_received = 0")),
        ("reminded_missed_lead_vs_wall", lt.format(c="SMS_received = 1"), f"{float(WALL_DAY)}"),
        ("disability_compression", lt.format(c="is_disabled = 0"), lt.format(c="is_disabled = 1")),
        ("advocacy_gap", rt.format(c=f"advocacy_type = {_MINOR}"), rt.format(c=f"advocacy_type = {_ADULT}")),
    ]
    aggs = ", ".join(f"CAST({a} AS DOUBLE) AS a{i}, CAST({b} AS DOUBLE) AS b{i}"
                     for i, (_, a, b) in enumerate(rows))
    sel = "\n  UNION ALL ".join(
        f"SELECT '{lbl}' AS label, a{i} AS a, b{i} AS b FROM w" for i, (lbl, _, _) in enumerate(rows))
    return f"""{base},
w AS (SELECT {aggs} FROM v),
g AS ({sel})
SELECT label, ROUND(a, 4) AS a, ROUND(b, 4) AS b, ROUND(a - b, 4) AS gap,
  ROUND((a - b) / NULLIF(b, 0) * 100, 4) AS gap_pct
FROM g"""


def _integrity(base: str, source: str, keys: Sequence[str]) -> str:
    k = ", ".join(keys)
    null_key = " OR ".join(f"{c} IS NULL" for c in keys)
    return f"""{base}{',' if base else 'WITH'}
kc AS (SELECT {k}, COUNT(*) AS cnt FROM {source} GROUP BY {k})
SELECT CAST(COALESCE(SUM(cnt), 0) AS BIGINT) AS total_records,
  CAST(COUNT_IF(NOT ({null_key})) AS BIGINT) AS distinct_keys,
  CAST(COALESCE(SUM(CASE WHEN {null_key} THEN cnt END), 0) AS BIGINT) AS null_key_records,
  CAST(COUNT_IF(NOT ({null_key}) AND cnt > 1) AS BIGINT) AS duplicated_keys,
  CAST(COALESCE(SUM(CASE WHEN NOT ({null_key}) AND cnt > 1 THEN cnt - 1 END), 0) AS BIGINT)
    AS duplicate_records,
  COALESCE(SUM(CASE WHEN NOT ({null_key}) AND cnt > 1 THEN cnt - 1 END), 0) = 0
    AND COALESCE(SUM(CASE WHEN {null_key} THEN cnt END), 0) = 0 AS is_unique
FROM kc"""


def build_oracle() -> Dict[str, str]:
    q: Dict[str, str] = {
        "integrity_orders": _integrity(F1, "appt", ["AppointmentID"]),
        "integrity_lineitem": _integrity("", "lineitem", ["l_orderkey", "l_linenumber"]),
        "duplicate_keys_lineitem": """SELECT l_orderkey, l_linenumber, COUNT(*) AS occurrences
FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""",
        "scope_report": f"""{F1}
SELECT COUNT(*) AS raw_rows,
  CAST(COUNT_IF(lead_time >= 0) AS BIGINT) AS valid_lead_rows,
  CAST(COUNT_IF(lead_time >= 0 AND PatientId IS NOT NULL) AS BIGINT) AS production_rows,
  CAST(COUNT_IF(lead_time < 0) AS BIGINT) AS negative_lead_rows,
  CAST(COUNT_IF(lead_time IS NULL) AS BIGINT) AS null_lead_rows,
  CAST(COUNT_IF(lead_time >= 0 AND PatientId IS NULL) AS BIGINT) AS null_entity_rows
FROM raw""",
        "load_profile": f"""{F1}
SELECT COUNT(*) AS rows, CAST((SELECT COUNT(*) FROM (DESCRIBE SELECT * FROM appt)) AS INTEGER) AS columns FROM appt""",
        "outcome_report": f"""{F1}
SELECT COUNT(*) AS rows,
  CAST(COUNT_IF("No-show") AS BIGINT) AS outcome_true,
  CAST(COUNT_IF(NOT "No-show") AS BIGINT) AS outcome_false,
  CAST(COUNT_IF("No-show" IS NULL) AS BIGINT) AS null_outcomes,
  CAST(COUNT_IF("No-show" IS NOT NULL AND "No-show" NOT IN (TRUE, FALSE)) AS BIGINT) AS unmapped_outcomes
FROM appt""",
    }
    for name, keys, view, missed in _GROUPED:
        q[name] = _grouped_sql(keys, view, missed)
    q.update({
        "reminder_rate": f"""{F1}
SELECT SMS_received AS sms_received,
  ROUND(AVG(CASE WHEN no_show_status THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100, 1)
    AS no_show_rate,
  COUNT(*) AS total_appointments
FROM v GROUP BY SMS_received""",
        "lead_day_curve": _curve(F1),
        "lead_day_curve_complement": f"""{F1}
SELECT lead_time AS lead_time_day,
  COUNT(*) AS total_appointments,
  CAST(COUNT_IF(no_show_status) AS BIGINT) AS total_noshows,
  CAST(COUNT(*) - COUNT_IF(no_show_status) AS BIGINT) AS total_shows,
  ROUND({_rate('COUNT_IF(no_show_status)', 'COUNT(*)')}, 1) AS noshowrate_pct,
  ROUND({_rate('COUNT(*) - COUNT_IF(no_show_status)', 'COUNT(*)')}, 1) AS show_rate_pct
FROM v GROUP BY lead_time""",
        "wall_contrast": f"""{F1},
curve AS (
  SELECT lead_time AS d, ROUND({_rate('COUNT_IF(no_show_status)', 'COUNT(*)')}, 1) AS r
  FROM v GROUP BY lead_time
)
SELECT ROUND(AVG(CASE WHEN d BETWEEN {PRE_WALL_DAYS[0]} AND {PRE_WALL_DAYS[1]} THEN r END), 4) AS pre_wall_rate,
  ROUND(AVG(CASE WHEN d BETWEEN {POST_WALL_DAYS[0]} AND {POST_WALL_DAYS[1]} THEN r END), 4) AS post_wall_rate,
  ROUND(AVG(CASE WHEN d BETWEEN {POST_WALL_DAYS[0]} AND {POST_WALL_DAYS[1]} THEN r END)
        - AVG(CASE WHEN d BETWEEN {PRE_WALL_DAYS[0]} AND {PRE_WALL_DAYS[1]} THEN r END), 4) AS lift,
  ROUND(MAX(CASE WHEN d = {WALL_DAY} THEN r END), 4) AS wall_day_rate
FROM curve""",
        "wall_contrast_weighted": f"""{F1},
curve AS (
  SELECT lead_time AS d, COUNT(*) AS t, COUNT_IF(no_show_status) AS m,
    ROUND({_rate('COUNT_IF(no_show_status)', 'COUNT(*)')}, 1) AS r
  FROM v GROUP BY lead_time
),
w AS (
  SELECT {_rate(f"SUM(CASE WHEN d BETWEEN {PRE_WALL_DAYS[0]} AND {PRE_WALL_DAYS[1]} THEN m END)",
                f"SUM(CASE WHEN d BETWEEN {PRE_WALL_DAYS[0]} AND {PRE_WALL_DAYS[1]} THEN t END)")} AS pre,
    {_rate(f"SUM(CASE WHEN d BETWEEN {POST_WALL_DAYS[0]} AND {POST_WALL_DAYS[1]} THEN m END)",
           f"SUM(CASE WHEN d BETWEEN {POST_WALL_DAYS[0]} AND {POST_WALL_DAYS[1]} THEN t END)")} AS post,
    MAX(CASE WHEN d = {WALL_DAY} THEN r END) AS wd
  FROM curve
)
SELECT ROUND(pre, 4) AS pre_wall_rate, ROUND(post, 4) AS post_wall_rate, ROUND(post - pre, 4) AS lift,
  ROUND(wd, 4) AS wall_day_rate
FROM w""",
        "beyond_wall": f"""{F1}
SELECT CAST(COUNT_IF(trust_wall_status = {_BEYOND}) AS BIGINT) AS beyond_total,
  CAST(COUNT_IF(trust_wall_status = {_BEYOND} AND no_show_status) AS BIGINT) AS beyond_noshows,
  {_rate(f"COUNT_IF(trust_wall_status = {_BEYOND} AND no_show_status)",
         f"COUNT_IF(trust_wall_status = {_BEYOND})")} AS beyond_rate
FROM v""",
        "cohort_volume": f"""{F1}
SELECT CAST(COUNT_IF(Gender = 'M' AND Scholarship = 1 AND no_show_status) AS BIGINT) AS total_patient_volume
FROM v""",
        "cohort_gaps": _gaps(),
        "disabled_share": f"""{F1}
SELECT CAST(COUNT_IF(is_disabled = 1) AS BIGINT) AS cohort_rows, COUNT(*) AS total_rows,
  {_rate('COUNT_IF(is_disabled = 1)', 'COUNT(*)')} AS pct_of_volume
FROM v""",
        "exposure_summary": f"""{F1},
{_exposure_cte()}
SELECT * FROM exposure""",
        "fiscal_leak": f"""{F1},
{_exposure_cte()}
SELECT Scholarship,
  CAST(COALESCE(SUM(CASE WHEN no_show_status THEN total_patient_volume END), 0) AS BIGINT) AS missed_volume,
  CAST(COALESCE(SUM(CASE WHEN no_show_status THEN modeled_revenue_impact END), 0) AS BIGINT) AS fiscal_leak
FROM exposure GROUP BY Scholarship""",
        "scorecard": _scorecard(),
        "scorecard_summary": f"""WITH sc AS ({_scorecard()})
SELECT CAST(COUNT_IF(ok) AS BIGINT) AS passed, COUNT(*) AS total, COUNT_IF(ok) = COUNT(*) AS all_ok
FROM sc""",
        "full_audit_cube": _full_audit(F1),
        "shipment_lead_day_curve": _curve(F2),
        "shipment_exposure_summary": f"""{F2},
{_exposure_cte()}
SELECT * FROM exposure""",
        "shipment_full_audit_cube": _full_audit(F2),
    })
    leak = """SELECT CAST(COALESCE(SUM(CASE WHEN {c} THEN total_patient_volume END), 0) AS BIGINT) AS missed_volume,
  CAST(COALESCE(SUM(CASE WHEN {c} THEN modeled_revenue_impact END), 0) AS BIGINT) AS fiscal_leak"""
    beyond = f"no_show_status AND trust_wall_status = {_BEYOND}"
    far = "\n  UNION ALL ".join(f"SELECT '{label}' AS label, CAST({e} AS DOUBLE) AS actual FROM v" for label, e in (
        ("rows, lead >= 70", "COUNT_IF(lead_time >= 70)"), ("rows, lead = 80", "COUNT_IF(lead_time = 80)"),
        ("rows, lead = 61", "COUNT_IF(lead_time = 61)"), ("rows, lead 61 to 200", "COUNT_IF(lead_time BETWEEN 61 AND 200)"),
        ("missed rate, lead >= 70", f"ROUND({_rate('COUNT_IF(lead_time >= 70 AND no_show_status)', 'COUNT_IF(lead_time >= 70)')}, 4)"),
        ("mean lead, lead >= 70", "ROUND(AVG(CASE WHEN lead_time >= 70 THEN lead_time END), 4)")))
    types = [("PatientId", "bigint"), ("AppointmentID", "bigint"), ("Gender", "string"), ("ScheduledDay", "date"),
             ("AppointmentDay", "date"), ("Age", "int"), ("Scholarship", "int"), ("Hipertension", "int"), ("Diabetes", "int"),
             ("Alcoholism", "int"), ("Handcap", "int"), ("SMS_received", "int"), ("No-show", "boolean")]
    profile = "\nUNION ALL ".join(
        f"SELECT CAST({i + 1} AS INTEGER) AS position, '{c}' AS name, '{t}' AS type, COUNT(\"{c}\") AS non_null, "
        f"CAST(MIN(\"{c}\") AS VARCHAR) AS smallest FROM appt" for i, (c, t) in enumerate(types))
    q.update({
        "shipment_cube_scorecard": _scorecard(F2),
        "shipment_cube_cohort_gaps": _gaps(F2),
        "shipment_cube_wall_365": _grouped_sql(["Scholarship", "trust_wall_status", "no_show_status"], "v", False,
                                               _with(_SHIP, _layers(wall=365))),
        "shipment_cube_far_metrics": f"{F2}\n{far}",
        "cube_adult_age_40": _grouped_sql(["advocacy_type", "no_show_status"], "v", False, _with(_APPT, _layers(adult_age=40))),
        "fiscal_leak_total": f"{F1},\n{_exposure_cte()}\n{leak.format(c='no_show_status')} FROM exposure",
        "fiscal_leak_beyond_wall": f"{F1},\n{_exposure_cte()}\n{leak.format(c=beyond).replace('SELECT', 'SELECT Scholarship,', 1)} "
                                   "FROM exposure GROUP BY Scholarship",
        "exposure_rate_table": f"{F1},\n" + _exposure_cte(
            f"COALESCE(MAX((SELECT 100 + 10 * n_nationkey FROM nation WHERE n_nationkey > 0 AND n_nationkey = Scholarship)), {DEFAULT_RATE})")
            + "\nSELECT * FROM exposure",
        "lead_day_curve_0_25": _curve(F1).replace("FROM v GROUP", "FROM v WHERE lead_time <= 25 GROUP"),
        "column_profile": f"{F1}\n{profile}",
        "scorecard_anchors": _scorecard(F1, ANCHORS),
        "wall_by_payer_ordered": f"SELECT ROW_NUMBER() OVER (ORDER BY Scholarship NULLS FIRST, trust_wall_status NULLS FIRST, "
                                 f"no_show_status NULLS FIRST) AS position, * FROM ({q['wall_by_payer']})",
        "lead_day_curve_ordered": f"SELECT ROW_NUMBER() OVER (ORDER BY lead_time_day) AS position, * FROM ({_curve(F1)})",
        "exposure_summary_ordered": f"SELECT ROW_NUMBER() OVER (ORDER BY Scholarship DESC NULLS LAST, trust_wall_status, acuity_tier, "
                                    f"no_show_status, Gender, SMS_received) AS position, * FROM ({q['exposure_summary']})",
        "clinic_lead_day_curve": _curve(F5),
        "clinic_lead_day_curve_complement": q["lead_day_curve_complement"].replace(F1, F5),
        "clinic_outcome_report": f"""{F5}
SELECT COUNT(*) AS rows, CAST(COUNT_IF("No-show" = 'Yes') AS BIGINT) AS outcome_true,
  CAST(COUNT_IF("No-show" = 'No') AS BIGINT) AS outcome_false, CAST(COUNT_IF("No-show" IS NULL) AS BIGINT) AS null_outcomes,
  CAST(COUNT_IF("No-show" NOT IN ('Yes', 'No')) AS BIGINT) AS unmapped_outcomes
FROM appt""",
        "clinic_scope_report": q["scope_report"].replace(F1, F5),
        "clinic_exposure_summary": _text_keys(f"{F5},\n{_exposure_cte()}\nSELECT * FROM exposure",
                                              ["Scholarship", "SMS_received", "no_show_status"]),
        "clinic_full_audit_cube": _full_audit(F5),
        "clinic_nonnull_counts": f"{F5}\nSELECT Scholarship, COUNT(Age) AS total_patient_volume, "
                                 "ROUND(AVG(lead_time), 1) AS avg_lead_time FROM v WHERE Scholarship IS NOT NULL GROUP BY Scholarship",
    })
    def bitmap(sql: str) -> str:
        return f"SELECT * EXCLUDE (duplicated_keys) FROM ({sql})"

    q.update({
        "integrity_orders_bitmap": bitmap(q["integrity_orders"]),
        "integrity_lineitem_bitmap": bitmap(q["integrity_lineitem"]),
        "shipment_integrity_bitmap": bitmap(_integrity(F2, "appt", ["AppointmentID"])),
        "cube_store_full_audit": q["full_audit_cube"],
        "published_condition_combinations": q["condition_combinations"],
        "published_fiscal_leak": q["fiscal_leak"],
        "observed_scope_report": q["scope_report"],
        "clinic_observed_outcome_report": q["clinic_outcome_report"],
        "csv_rejects": """SELECT * FROM (VALUES
  ('Age', 'not a int', (SELECT COUNT(*) FROM orders WHERE o_orderkey % 97 = 5)),
  ('PatientId', 'not a bigint', (SELECT COUNT(*) FROM orders WHERE o_orderkey % 101 = 3)),
  ('ScheduledDay', 'not a timestamp', (SELECT COUNT(*) FROM orders WHERE o_orderkey % 103 = 4))) AS t("column", reason, faults)
WHERE faults > 0""",
        "csv_age_class_outcome": _text_keys(_grouped_sql(["advocacy_type", "no_show_status"], "v", False, F5_CLEAN),
                                            ["advocacy_type", "no_show_status"]),
        "csv_lead_day_curve": _curve(F5_CLEAN),
        "text_timestamp_scope_report": q["scope_report"].replace(F1, F5_TEXT),
        "text_timestamp_lead_day_curve": _curve(F5_TEXT),
        "layout_lead_day_curve_0_25": _curve(F5).replace("FROM v GROUP", "FROM v WHERE lead_time <= 25 GROUP"),
        "layout_wall_by_payer_prod": _text_keys(_grouped_sql(["Scholarship", "trust_wall_status", "no_show_status"], "p", False, F5),
                                                ["Scholarship", "trust_wall_status", "no_show_status"]),
        "layout_scope_report": q["clinic_scope_report"],
        "feed_exposure_summary": q["exposure_summary"],
        "baseline_by_ordinal": f"""{F1}
SELECT Scholarship, CAST(no_show_status AS INTEGER) AS no_show, COUNT(*) AS total_patient_volume, ROUND(AVG(lead_time), 1) AS avg_lead_time
FROM v GROUP BY 1, 2""",
        "grouped_audits_typed": _full_audit(F1, typed=True),
        "clinic_grouped_audits_typed": _full_audit(F5, typed=True),
        "shipment_scorecard_one_pass": _scorecard(F2),
        "clinic_scorecard_one_pass": _scorecard(F5),
        "distinct_patients_by_payer": f"{F1}\nSELECT Scholarship, COUNT(DISTINCT PatientId) AS distinct_patients FROM v GROUP BY Scholarship",
    })
    for name, keys, view, missed in _GROUPED:
        q[f"clinic_{name}"] = _text_keys(_grouped_sql(keys, view, missed, F5), keys)
    # cube-served forms answer with the same rows as the direct forms
    q["cube_exposure_summary"] = q["exposure_summary"]
    q["cube_cohort_gaps"] = q["cohort_gaps"]
    q["cube_scorecard"] = q["scorecard"]
    return {name: _counts(sql) for name, sql in q.items()}
