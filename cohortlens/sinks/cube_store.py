"""ONE-1 as a store: a cohort cube kept up to date by deltas.

Every day (or late or corrected batch) is built as a cube of its own and added;
a batch that was wrong is taken back, which adds its cells counted -1 times.
Counts add up cell by cell, so the cube of the store equals one built over all
its batches at once, in whatever order they came.

``<path>/deltas/<attempt>`` holds the cells of a batch and ``<path>/ledger/``
one small file per entry, which names its delta and sign.  An entry counts from
the moment its ledger file exists; the file is created once (``write_once``), so
a batch that is added again, by a retry or by two writers, counts once.  A
delta whose writer died before its entry is never read.  ``compact`` adds all
entries up into one delta and points ``_BASE`` at it.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from typing import Dict, List, Optional
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import AuditParams, ColumnMap, WAREHOUSE_COLUMNS
from ..operators.cube import CNT, SUM_LEAD, CohortCube, add_cells, build_tag
from .atomic import list_names, read_text, replace_text, write_once


class CubeStore:
    def __init__(self, spark: SparkSession, path: str, cmap: ColumnMap = WAREHOUSE_COLUMNS, params: AuditParams = AuditParams()):
        self.spark, self.path, self.cmap, self.params = spark, path.rstrip("/"), cmap, params
        self.tag = build_tag(cmap, params)

    # -- ledger ----------------------------------------------------------------
    def _entry_path(self, entry: str) -> str:
        return f"{self.path}/ledger/{quote(entry, safe='')}.json"

    def _read(self, entry: str) -> Optional[Dict]:
        text = read_text(self.spark, self._entry_path(entry))
        return None if text is None else json.loads(text)

    def entries(self) -> List[str]:
        """The names in the ledger (one small file each, so as many as there were batches)."""
        return [unquote(n[:-len(".json")]) for n in list_names(self.spark, f"{self.path}/ledger")]

    def _commit(self, entry: str, delta: str, sign: int) -> bool:
        return write_once(self.spark, self._entry_path(entry), json.dumps({"delta": delta, "sign": sign, "tag": self.tag}))

    def _write(self, cells: DataFrame) -> str:
        delta = f"deltas/{uuid.uuid4().hex}"
        cells.write.parquet(f"{self.path}/{delta}")
        return delta

    # -- changes ---------------------------------------------------------------
    def add(self, entry: str, cube: CohortCube) -> bool:
        """Count a batch under the name ``entry``; False, and nothing changed, where that name was added before."""
        if cube.tag != self.tag:
            raise ValueError("the batch was built with other parameters than the store")
        if self._read(entry) is not None:
            return False
        return self._commit(entry, self._write(cube.cells), 1)

    def take_back(self, entry: str) -> bool:
        """Uncount a batch; False where it was taken back before.  Its name stays used: a corrected batch gets a new one."""
        kept = self._read(entry)
        if kept is None:
            raise KeyError(f"the ledger has no entry {entry!r}")
        return self._commit(f"{entry} taken back", kept["delta"], -kept["sign"])

    def replace(self, entry: str, by: str, cube: CohortCube) -> bool:
        """Take a batch back and count its corrected form under the name ``by``."""
        added = self.add(by, cube)
        return self.take_back(entry) or added

    # -- reading ---------------------------------------------------------------
    def _base(self) -> Dict:
        text = read_text(self.spark, f"{self.path}/_BASE")
        return {"delta": None, "entries": []} if text is None else json.loads(text)

    def _parts(self, names: List[str], base: Dict) -> List[DataFrame]:
        by_sign: Dict[int, List[str]] = {1: [], -1: []}
        if base["delta"]:
            by_sign[1].append(f"{self.path}/{base['delta']}")
        for entry in names:
            kept = self._read(entry)
            if kept["tag"] != self.tag:
                raise ValueError(f"entry {entry!r} was built with other parameters than the store")
            by_sign[kept["sign"]].append(f"{self.path}/{kept['delta']}")
        # A delta taken back, added and taken back again is listed once per entry.
        return [self._counted(p, sign) for sign, paths in by_sign.items() for p in self._once(paths)]

    def _once(self, paths: List[str]) -> List[List[str]]:
        """The paths in lists without repeats, since one read names a folder once."""
        out: List[List[str]] = []
        for p in paths:
            for group in out:
                if p not in group:
                    group.append(p)
                    break
            else:
                out.append([p])
        return out

    def _counted(self, paths: List[str], sign: int) -> DataFrame:
        cells = self.spark.read.parquet(*paths)
        return cells if sign == 1 else cells.withColumns({CNT: F.col(CNT) * sign, SUM_LEAD: F.col(SUM_LEAD) * sign})

    def cube(self) -> CohortCube:
        """The cube of everything that counts now."""
        base = self._base()
        parts = self._parts(sorted(set(self.entries()) - set(base["entries"])), base)
        if not parts:
            raise FileNotFoundError(f"no batch was added to the cube store {self.path}")
        return CohortCube(add_cells(reduce(DataFrame.unionByName, parts), self.cmap, self.params), self.cmap, self.params, self.tag)

    def compact(self) -> None:
        """Add all entries up into one delta.  Entries that come meanwhile are not in its list and count as before."""
        base = self._base()
        names = sorted(set(self.entries()) - set(base["entries"]))
        if names:
            parts = self._parts(names, base)
            cells = add_cells(reduce(DataFrame.unionByName, parts), self.cmap, self.params)
            delta = self._write(cells)
            replace_text(self.spark, f"{self.path}/_BASE", json.dumps({"delta": delta, "entries": sorted([*base["entries"], *names])}))
