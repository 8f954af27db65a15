"""Shuffle volume vs input volume across two scales (measured from the event log).

Runs in its own process (its own session with an event log in a scratch folder).
"""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_grouped_shuffles_do_not_grow_with_the_input():
    names = ["baseline_volume", "exposure_summary", "cohort_gaps", "full_audit_cube", "integrity_orders",
             "integrity_orders_bitmap", "integrity_lineitem", "integrity_lineitem_bitmap", "shipment_cube_scorecard", "shipment_scorecard_one_pass"]
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "tools", "shuffle_growth.py"),
         "/root/testdata/sf0.001", "/root/testdata/sf0.1", *names],
        capture_output=True, text=True, timeout=900, check=True)
    g = json.loads(out.stdout.strip().splitlines()[-1])
    assert all(v["input_x"] == 100.0 for v in g.values())  # 100x the rows
    for n in ("baseline_volume", "exposure_summary", "cohort_gaps"):
        assert g[n]["shuffle_x"] < 1.5, (n, g[n])            # pre-aggregated: flat
    assert g["full_audit_cube"]["shuffle_x"] < 10, g          # bounded by cells, not rows
    assert g["integrity_orders"]["shuffle_x"] > 20, g         # the key-only shuffle does grow
    # bitmaps move less than a tenth of the bytes that the keys themselves do
    for keys, bits in (("integrity_orders", "integrity_orders_bitmap"), ("integrity_lineitem", "integrity_lineitem_bitmap")):
        assert 0 < g[bits]["shuffle_bytes"] < g[keys]["shuffle_bytes"] / 10, (g[keys], g[bits])
    # the scorecard with the distinct count inside its one pass reads the join's inputs once, not twice
    assert g["shipment_scorecard_one_pass"]["input_records"] <= g["shipment_cube_scorecard"]["input_records"] / 2
