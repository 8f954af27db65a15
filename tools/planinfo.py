"""Read a physical plan's shape: scans, joins, and what each exchange carries.

Each exchange is classified by the paths from it down to the leaves of its
subtree:

* ``aggregated`` — every path meets an aggregate (or an earlier exchange)
  first: it moves pre-aggregated rows, bounded by groups x map tasks;
* ``events``     — some path reaches a file scan with no aggregate between:
  it moves input rows, a shuffle that grows with the data;
* ``local``      — it only moves a small driver-side table (e.g. the expected
  checkpoint values).
"""

from __future__ import annotations

import re
from typing import Dict, List, Optional

from pyspark.sql import DataFrame

_NODE = re.compile(r"(\*\(\d+\) )?([A-Z]\w*)")


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _parse(text: str) -> List[dict]:
    nodes: List[dict] = []
    for line in text.splitlines():
        m = None
        for m in _NODE.finditer(line):
            break
        if not m or m.group(2) == "AdaptiveSparkPlan":
            continue
        depth = m.start()
        parent: Optional[int] = None
        for j in range(len(nodes) - 1, -1, -1):
            if nodes[j]["depth"] < depth:
                parent = j
                break
        nodes.append({"depth": depth, "name": m.group(2), "line": line.strip(), "parent": parent,
                      "children": []})
        if parent is not None:
            nodes[parent]["children"].append(len(nodes) - 1)
    return nodes


def _classify(nodes: List[dict], i: int) -> str:
    kinds = set()

    def walk(j: int) -> None:
        n = nodes[j]
        if n["name"] in ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "Exchange",
                         "BroadcastExchange", "ShuffleQueryStage", "BroadcastQueryStage"):
            kinds.add("aggregated" if "Aggregate" in n["name"] else "boundary")
            return
        if not n["children"]:
            kinds.add("events" if n["name"] in ("FileScan", "BatchScan") else "local")
            return
        for c in n["children"]:
            walk(c)

    for c in nodes[i]["children"]:
        walk(c)
    if "events" in kinds:
        return "events"
    if "aggregated" in kinds or "boundary" in kinds:
        return "aggregated"
    return "local"


def exchanges(df: DataFrame) -> List[Dict[str, str]]:
    """Each exchange: partitioning kind and what it carries."""
    nodes = _parse(plan_text(df))
    out = []
    for i, n in enumerate(nodes):
        if n["name"] not in ("Exchange", "BroadcastExchange"):
            continue
        part = re.search(r"Exchange (\w+)", n["line"])
        out.append({
            "kind": "broadcast" if n["name"] == "BroadcastExchange" else (part.group(1) if part else "?"),
            "carries": _classify(nodes, i),
            "line": n["line"][:160],
        })
    return out


def shape(df: DataFrame) -> Dict[str, int]:
    text = plan_text(df)
    ex = exchanges(df)
    return {
        "scans": len(re.findall(r"FileScan \w+", text)),
        "exchanges": len(ex),
        "event_row_exchanges": sum(1 for e in ex if e["carries"] == "events"),
        "joins": len(re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin)", text)),
        "expand": len(re.findall(r"Expand \[", text)),
    }
