"""Operator 2 — URL filters by a bit-parallel wildcard automaton.

Glob rules run over a canonical URL, host (A-Z lower-cased) followed by path.
``*`` stands for any run of bytes without ``/``, ``**`` for any run of bytes;
everything else stands for itself.  All rules are packed side by side into
multiword Shift-And masks: one bit per byte of a rule, plus one where it
begins.  Reading a byte shifts every rule's bits at once, keeps those whose
next byte it is, and lets a bit stand where a wildcard follows it; the words
carry into each other.  A batch of URLs advances in lockstep.

A host rule such as ``example.com/en/`` becomes two globs, the host itself and
``*.`` before it for its subdomains.  Of the host rules that match, the longest
wins (then the earliest); a URL that none matches is blocked if a ``BLOCKED``
glob matches, and allowed otherwise.

Defined results: a null URL, or one without ``://``, has an empty host and
path, no rule, and is allowed; URLs of any length are matched whole; repeated rows are judged row by row; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from typing import Iterator, List, Sequence, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# (verdict, host and path)
RULES: Tuple[Tuple[str, str], ...] = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
)
# For URLs that no rule fits.
BLOCKED: Tuple[str, ...] = ("*spam*/**", "**/ads/**", "**/tracker/**", "**.exe")

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def split_url(url) -> Tuple[str, str]:
    """(host, path) of a URL."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    path = rest[cut:].partition("#")[0].partition("?")[0]
    return rest[:cut].encode().translate(_LOWER).decode(), path


class Globs:
    """All globs as one automaton over bytes."""

    def __init__(self, globs: Sequence[str]):
        tokens: List[Tuple[int, int, bool]] = []  # (byte or -1 where a glob begins, wildcard after it: 0 / 1 / 2, last)
        for g in globs:
            raw = g.encode()
            own, i = [[-1, 0, False]], 0
            while i < len(raw):
                if raw[i: i + 2] == b"**":
                    own[-1][1], i = 2, i + 2
                elif raw[i: i + 1] == b"*":
                    own[-1][1], i = max(own[-1][1], 1), i + 1
                else:
                    own.append([raw[i], 0, False])
                    i += 1
            own[-1][2] = True
            tokens.extend(map(tuple, own))
        self.count = len(globs)
        self.words = max(1, -(-len(tokens) // 64))
        self.step = np.zeros((256, self.words), np.uint64)  # bits a byte may move into
        self.stay = np.zeros((256, self.words), np.uint64)  # bits a byte may leave standing
        self.start = np.zeros(self.words, np.uint64)
        self.ends: List[Tuple[int, np.uint64]] = []
        for at, (byte, wild, last) in enumerate(tokens):
            w, bit = at // 64, np.uint64(1 << (at % 64))
            if byte < 0:
                self.start[w] |= bit
            else:
                self.step[byte, w] |= bit
            if wild:
                self.stay[:, w] |= bit
                if wild == 1:
                    self.stay[ord("/"), w] &= ~bit
            if last:
                self.ends.append((w, np.uint64(at % 64)))

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """(texts, globs) booleans: the glob matches the whole text."""
        order = np.array(sorted(range(len(texts)), key=lambda i: -len(texts[i])), np.int64)
        size = np.array([len(texts[i]) for i in order], np.int64)
        flat = np.frombuffer(b"".join(texts[i] for i in order) or b"\0", np.uint8)
        begin = np.cumsum(size) - size
        bits = np.tile(self.start, (len(texts), 1))
        alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        for pos, k in enumerate(alive.tolist()):
            byte, now = flat[begin[:k] + pos], bits[:k]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            bits[:k] = (moved & self.step[byte]) | (now & self.stay[byte])
        out = np.zeros((len(texts), self.count), bool)
        for g, (w, bit) in enumerate(self.ends):
            out[order, g] = (bits[:, w] >> bit) & np.uint64(1) == 1
        return out


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
          rules: Sequence[Tuple[str, str]] = RULES, blocked: Sequence[str] = BLOCKED) -> DataFrame:
    """(id_col, host, path, rule, verdict), one row per input row."""
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    globs = [p + r[1] + "**" for r in ranked for p in ("", "*.")] + list(blocked)
    n = len(ranked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Globs(globs)
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            hit = auto.match([(h + p).encode() for h, p in parts])
            host_hit = hit[:, 0: 2 * n: 2] | hit[:, 1: 2 * n: 2]
            found = host_hit.any(axis=1)
            best = host_hit.argmax(axis=1)
            bad = hit[:, 2 * n:].any(axis=1)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                pa.array([ranked[i][1] if f else None for i, f in zip(best, found)], pa.string()),
                pa.array([ranked[i][0] if f else "block" if x else "allow" for i, f, x in zip(best, found, bad)], pa.string()),
            ], [id_col, "host", "path", "rule", "verdict"])

    src = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("url"))
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
