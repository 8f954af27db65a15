"""Operator 12 — periodic runs of words, found by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and at least max(MIN_LENGTH, 2 q) words that no neighbouring
word extends.  All texts of an Arrow batch are worked on at once, in numpy:

1. Words become dense ids (exactly: by their bytes), and prefix doubling builds
   one suffix array of the batch whose suffixes sort by document first.  Every
   round gives the classes of equal stretches of 2^k words and, since later
   rounds only permute inside a class, the class's interval of the suffix array.
2. A wavelet matrix over the suffix array (without the positions whose
   four words stand nowhere else in their document) answers range-successor
   queries: the occurrences of a class in a window of positions.
3. Dyadic blocks of 2^k words ask for their occurrences in the neighbouring
   windows: a run of period q holds such a block, and its copy q words on, with
   q in the block's range (``_windows``).  Occurrences in one window form an
   arithmetic progression, so its first two members and their number give them
   all; each distance from the block is a candidate period.  Where block and
   progression lie in one run of the progression's difference, only candidates
   up to that difference can be smallest periods, and the others are left out.
4. The candidate (block, period) is extended both ways by the classes, from the
   longest down; stretches that are long enough are runs, each with the least
   period found for it.

Time and memory are O(n log n) in the words of a batch (about 2 MB of text, or
one longer text alone, at some 300 bytes a word); no row needs another row, so
there is no shuffle and no group.

Defined results: a null or empty text, or one without a word, has no run and
collapses to the empty text; a text is worked on whole, however long; rows are
judged one by one, so ties and repeated rows give equal rows and a null id is
kept; an empty table gives an empty table; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from typing import Iterator, List, NamedTuple, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, utf8_view

MIN_LENGTH = 12
_BATCH_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Runs(NamedTuple):
    """Runs by text, start and period; starts are word positions in the batch."""
    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def words_of(data: np.ndarray, starts: np.ndarray) -> Tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed bytes, offsets, ids, first): word i is packed[offsets[i]:offsets[i + 1]], equal words have equal
    ids, and those of text t are first[t]:first[t + 1]."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begin = np.flatnonzero(solid & ~(np.concatenate(([False], solid[:-1])) & ~edge[:-1]))
    packed = data[solid]
    before = np.concatenate(([0], np.cumsum(solid)))
    offsets = np.append(before[begin], len(packed)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return packed, offsets, ids, np.searchsorted(begin, starts)


class Wavelet:
    """Wavelet matrix over values below 2^bits; queries are vectors of half-open ranges."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.bits = max(1, int(self.size).bit_length())
        self._zeros: List[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            self._zeros.append(np.concatenate(([0], np.cumsum(~one))).astype(np.int32))
            values = np.concatenate((values[~one], values[one]))

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of [lo, hi) are less than x (0 <= x <= size)."""
        lo, hi, count = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self._zeros):
            z, lo0, hi0 = int(zeros[-1]), zeros[lo], zeros[hi]
            one = (x >> (self.bits - 1 - level)) & 1 == 1
            count += np.where(one, hi0 - lo0, 0)
            lo, hi = np.where(one, z + lo - lo0, lo0), np.where(one, z + hi - hi0, hi0)
        return count

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest value (from 0) of [lo, hi); with ``below`` this is the range successor."""
        lo, hi, n, value = lo.copy(), hi.copy(), n.copy(), np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self._zeros):
            z, lo0, hi0 = int(zeros[-1]), zeros[lo], zeros[hi]
            one = n >= hi0 - lo0
            n -= np.where(one, hi0 - lo0, 0)
            value |= one.astype(np.int64) << (self.bits - 1 - level)
            lo, hi = np.where(one, z + lo - lo0, lo0), np.where(one, z + hi - hi0, hi0)
        return value


class Blocks(NamedTuple):
    level: int
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


class Suffixes:
    """Suffix array of all texts by prefix doubling, with the classes of every level and the blocks to query.

    ``classes[k][i]`` is equal for two positions of one text if and only if their next 2^k words are equal."""

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        n = len(ids)
        self.text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.start, self.end = first[self.text], first[self.text + 1]
        width = int(ids.max()) + 2
        key = self.text * width + ids
        if (len(first) - 1) * width * width >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        follow = np.where(np.arange(1, n + 1) < self.end, np.append(ids[1:], 0) + 1, 0)
        key = key * width + follow
        order = np.argsort(key, kind="stable")
        is_first = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(is_first, np.arange(n), 0))
        self.classes = [ids, rank]
        self.blocks: List[Blocks] = []
        shared = np.zeros(0, np.int64)
        level = 1
        while True:
            # Classes of one position are settled; the others are whole intervals of the order.
            open_ = np.flatnonzero(~(is_first & np.append(is_first[1:], True)))
            if level == 2:
                shared = open_
            if level >= 2:
                self._ask(level, order[open_], rank, open_, is_first)
            if len(open_) == 0:
                break
            at, step = order[open_], 1 << level
            after = at + step
            follow = np.where(after < self.end[at], rank[np.minimum(after, n - 1)] + 1, 0)
            key = rank[at] * (n + 1) + follow
            by = np.argsort(key, kind="stable")
            key = key[by]
            order[open_] = at[by]
            is_first[open_[1:]] |= key[1:] != key[:-1]
            rank = rank.copy()
            rank[order[open_]] = np.maximum.accumulate(np.where(is_first[open_], open_, 0))
            self.classes.append(rank)
            level += 1
        # Only positions whose class of four words has others can answer a block: those alone are kept.
        self.places = np.sort(order[shared])
        before = np.zeros(n + 1, np.int64)
        before[shared + 1] = 1
        np.cumsum(before, out=before)
        self.blocks = [Blocks(b.level, b.at, before[b.lo], before[b.hi]) for b in self.blocks]
        self.wavelet = Wavelet(np.searchsorted(self.places, order[shared]))

    def _ask(self, level: int, at: np.ndarray, rank: np.ndarray, open_: np.ndarray, is_first: np.ndarray) -> None:
        if len(at) == 0:
            return
        stride = 2 if level == 2 else 1 << level
        edges = np.flatnonzero(is_first[open_])
        ends = np.repeat(open_[np.append(edges[1:], len(open_)) - 1] + 1, np.diff(np.append(edges, len(open_))))
        block = (at - self.start[at]) % stride == 0
        if block.any():
            self.blocks.append(Blocks(level, at[block], rank[at][block], ends[block]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j (i < j, one text) on are equal."""
        got, end, last = np.zeros(len(i), np.int64), self.end[i], len(self.text) - 1
        for level in range(len(self.classes) - 1, -1, -1):
            c = self.classes[level]
            same = (j + got < end) & (c[i + got] == c[np.minimum(j + got, last)])
            got += same.astype(np.int64) << level
        return got

    def common_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words just before i and just before j (i < j, one text) are equal."""
        got, start = np.zeros(len(i), np.int64), self.start[i]
        for level in range(len(self.classes) - 1, -1, -1):
            c, back = self.classes[level], got + (1 << level)
            same = (i - back >= start) & (c[np.maximum(i - back, 0)] == c[np.maximum(j - back, 0)])
            got += same.astype(np.int64) << level
        return got


def _windows(level: int) -> Tuple[int, ...]:
    """Edges of the windows of distances that blocks of 2^level words ask for, each of at most 2^level distances.

    A run of period q and length >= max(12, 2 q) that starts at s holds the aligned block at b < s + stride and its copy
    at b + q if 2^level + stride - 1 + q <= length.  Blocks of four words, two apart, so serve every q up to 14;
    longer blocks, aligned to their length l, serve q from 2 l - 1 up to 4 l - 2."""
    size = 1 << level
    return (1, 5, 9, 13, 15) if level == 2 else (2 * size - 1, 3 * size - 1, 4 * size - 1)


def _candidates(s: Suffixes) -> Tuple[np.ndarray, np.ndarray]:
    """(block position, distance of an equal block) pairs; see step 3 above."""
    out_at, out_q = [], []
    for level, at, lo, hi in s.blocks:
        edges = _windows(level)
        counts = [s.wavelet.below(lo, hi, np.searchsorted(s.places, at + d)) for d in edges]
        for below, upto in zip(counts, counts[1:]):
            hit = np.flatnonzero(upto > below)
            if len(hit) == 0:
                continue
            b, left, right, skip, number = at[hit], lo[hit], hi[hit], below[hit], (upto - below)[hit]
            q = s.places[s.wavelet.nth(left, right, skip)] - b
            gap = np.ones(len(hit), np.int64)
            more = np.flatnonzero(number > 1)
            gap[more] = s.places[s.wavelet.nth(left[more], right[more], skip[more] + 1)] - b[more] - q[more]
            # In one run of period gap with the whole progression?
            long_ = np.flatnonzero(number > 2)
            inside = np.zeros(len(hit), bool)
            inside[long_] = s.common(b[long_], b[long_] + gap[long_]) >= q[long_] + (1 << level) - gap[long_]
            each = np.repeat(np.arange(len(hit)), number)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(number) - number, number)
            distance = q[each] + nth * gap[each]
            keep = ~inside[each] | (distance <= gap[each])
            out_at.append(b[each][keep])
            out_q.append(distance[keep])
    if not out_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_at), np.concatenate(out_q)


def runs_of(ids: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH) -> Runs:
    """All runs of all texts; ``ids`` are word ids, those of text t at first[t]:first[t + 1]."""
    if min_length < MIN_LENGTH:
        raise ValueError(f"the block layout finds runs of {MIN_LENGTH} words and more")
    none = np.zeros(0, np.int64)
    if len(ids) == 0:
        return Runs(none, none, none, none)
    s = Suffixes(ids, first)
    at, q = _candidates(s)
    back = s.common_before(at, at + q)
    length = back + q + s.common(at, at + q)
    good = length >= np.maximum(min_length, 2 * q)
    start, length, q = (at - back)[good], length[good], q[good]
    by = np.lexsort((q, length, start))
    start, length, q = start[by], length[by], q[by]
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])))[:len(start)]
    start, length, q = start[new], length[new], q[new]
    by = np.lexsort((q, start))
    start, length, q = start[by], length[by], q[by]
    return Runs(s.text[start], start, length, q)


def _collapse(packed: np.ndarray, offsets: np.ndarray, first: np.ndarray, runs: Runs) -> pa.Array:
    """The texts' words without those a run holds after its first period, joined by one space."""
    n = len(offsets) - 1
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, runs.start + runs.period, 1)
    np.add.at(cover, runs.start + runs.length, -1)
    kept = np.flatnonzero(np.cumsum(cover)[:n] == 0)
    bounds = np.searchsorted(kept, first)
    size = offsets[kept + 1] - offsets[kept]
    # Every kept word is followed by a space, but for the last of its text.
    tail = np.ones(len(kept), np.int64)
    tail[bounds[1:][np.diff(bounds) > 0] - 1] = 0
    ends = np.cumsum(size + tail)
    out = np.full(int(ends[-1]) if len(kept) else 0, 32, np.uint8)
    begin = ends - size - tail
    to = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
    if len(kept) == n:
        out[to] = packed
    else:
        out[to] = packed[np.arange(len(to)) + np.repeat(offsets[kept] - (np.cumsum(size) - size), size)]
    starts = np.append(0, ends)[bounds].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(starts), pa.py_buffer(out)])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, runs, collapsed), one row per input row.

    ``runs`` is an array of (start, length, period) by start, then period, in words; ``collapsed`` is the text's words,
    joined by one space, without those that any run holds after its first period."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in batches_of(whole, _BATCH_BYTES):
                data, starts = utf8_view(b.column(1))
                packed, offsets, ids, first = words_of(data, starts)
                runs = runs_of(ids, first)
                items = pa.StructArray.from_arrays(
                    [pa.array(x, pa.int64()) for x in (runs.start - first[runs.text], runs.length, runs.period)], ["start", "length", "period"])
                cuts = np.searchsorted(runs.text, np.arange(len(first))).astype(np.int32)
                collapsed = _collapse(packed, offsets, first, runs)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.ListArray.from_arrays(pa.array(cuts), items), collapsed.cast(pa.string())],
                    [id_col, "runs", "collapsed"])

    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(work, f"`{id_col}` {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col) with the test periods of the registered query: where crc32 of the decimal id ends in 0, the
    words from a point on repeat with some period (both drawn from the crc32); other texts stay as they are."""
    words = f"if(h % 10 = 0, regexp_extract_all({text_col}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0), null)"
    return (docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias(text_col),
                        F.expr(f"crc32(cast(`{id_col}` as string))").alias("h"))
            .select("i", text_col, "h", F.expr(words).alias("w"))
            .select("i", text_col, "h", "w", F.expr("cast(try_mod(h div 10, cast(size(w) as bigint)) as int)").alias("a"))
            .select("i", text_col, "w", "a", F.expr("cast(1 + (size(w) - a) div (3 + (h div 10) % 8) as int)").alias("p"))
            .select(F.col("i").alias(id_col),
                    F.expr(f"if(size(w) > 0, array_join(transform(w, (x, k) -> if(k >= a, w[a + (k - a) % p], x)), ' '), {text_col})")
                    .alias(text_col)))
