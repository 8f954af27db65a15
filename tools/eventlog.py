"""Per-job-group shuffle and stage counts from a Spark event log (no UI involved).

Tag work with ``spark.sparkContext.setJobGroup(tag, tag)``; after the session
stops, ``shuffle_by_group(event_log_dir)`` sums, per tag, the shuffle bytes
written, the records read by scans and the number of stages run.
"""

from __future__ import annotations

import io
import json
import os
from collections import defaultdict
from typing import Dict, Iterator


def _lines(path: str) -> Iterator[str]:
    if path.endswith(".zstd"):
        import zstandard
        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh, read_across_frames=True)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def _event_files(log_dir: str) -> Iterator[str]:
    for root, _, names in os.walk(log_dir):
        for n in sorted(names):
            if not n.startswith(".") and not n.startswith("appstatus"):
                yield os.path.join(root, n)


def shuffle_by_group(log_dir: str) -> Dict[str, Dict[str, int]]:
    stage_group: Dict[int, str] = {}
    out: Dict[str, Dict[str, int]] = defaultdict(lambda: {"shuffle_bytes": 0, "input_records": 0, "stages": 0})
    for path in _event_files(log_dir):
        for line in _lines(path):
            if line.strip():
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    if group:
                        for sid in ev.get("Stage IDs", []):
                            stage_group[sid] = group
                elif kind == "SparkListenerStageCompleted":
                    info = ev.get("Stage Info", {})
                    group = stage_group.get(info.get("Stage ID"))
                    if group and not info.get("Failure Reason"):
                        out[group]["stages"] += 1
                elif kind == "SparkListenerTaskEnd":
                    group = stage_group.get(ev.get("Stage ID"))
                    m = ev.get("Task Metrics") or {}
                    if group:
                        out[group]["shuffle_bytes"] += (m.get("Shuffle Write Metrics") or {}).get(
                            "Shuffle Bytes Written", 0)
                        out[group]["input_records"] += (m.get("Input Metrics") or {}).get("Records Read", 0)
    return dict(out)
