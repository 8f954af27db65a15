"""Operator 1 — exact substring deduplication with a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier
(smaller id, or same document, earlier start); matches never cross documents.

Suffix arrays.  A text's windows of LENGTH bytes are represented by sampled
suffixes: each window's minimiser is its leftmost K-byte string of least hash,
and consecutive windows with one minimiser form one entry.  Equal windows have
their minimiser at the same place, so equal windows meet under equal leading K
bytes.  An entry holds the hash of its suffix's leading K bytes (the sort key),
the hash of all bytes its windows cover, its place and its window count; about
one entry per 32 bytes.  Arrays are sorted by key and cut into shards by key.

Logarithmic family.  Documents arrive in batches of rising id.  A new batch's
array is merge-scanned, shard by shard, against every level: an entry whose
key and bytes are already there (or earlier in the batch) repeats in all its
windows; an entry whose key is there with other bytes may repeat in part.
What is new in the batch, the first place of every entry that no level holds,
becomes a level of its own; only levels of equal size merge, as a binary counter
carries, and the others stay as they were written.

Partly repeated entries are settled exactly: the documents give their bytes,
those of one key are compared window by window, and a window that an earlier
one equals is removed.  A hash stands for its bytes at 64 bits (entries: 112).

Bounded work: a map task collapses its own repeats first, so a group of copies
sends at most one entry per task and distinct string; a shard holds distinct
entries only.  Shards and document buckets grow in number with the bytes of the
texts, about ``TASK_BYTES`` each.  A key with very many variants is streamed in
order, keeping only the windows seen.  A text of any length is indexed whole, in
overlapping pieces.

Defined results: a null text is empty, 0 bytes; texts shorter than LENGTH
lose nothing; rows that share an id (null ids share one, the smallest) are one
document whose rows are told apart by a 64-bit hash of the text, so identical rows
are judged alike and do not remove each other; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from typing import Dict, Iterator, List, Tuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, batches_of, byte_values, mix64, stage_table, utf8_view

LENGTH, K = 100, 32
_VALUES = byte_values(1)
# Packed entries of a shard, and text of a document bucket.  A task unpacks and sorts a shard in about 20 times its size;
# larger executors take larger shards, and fewer of them.
TASK_BYTES = 8 << 20
_PIECE = 1 << 20  # windows handled at once
_PLACE_BITS = 21
_FLUSH = 8 << 20  # text bytes after which a map task sends its entries
ENTRY, SPAN, PARTIAL = 0, 1, 2
NULL_ID = -(1 << 63)
# fields and stored bytes of a packed block; pos is the place << 16, tag tells the rows of one id apart
_FIELDS = {
    ENTRY: (("key", 8), ("sk", 6), ("doc", 8), ("tag", 8), ("pos", 6), ("n", 1), ("a", 1)),
    SPAN: (("doc", 8), ("tag", 8), ("pos", 6), ("len", 4)),
    PARTIAL: (("key", 8), ("doc", 8), ("tag", 8), ("pos", 6), ("n", 1), ("a", 1)),
}
Block = Dict[str, np.ndarray]


def pack(block: Block, kind: int) -> bytes:
    """Byte planes, lowest first: the planes of small numbers are zeros and compress away."""
    return b"".join(np.ascontiguousarray(block[f].astype("<u8").view(np.uint8).reshape(-1, 8).T[:w]).tobytes() for f, w in _FIELDS[kind])


def unpack(raw: bytes, kind: int) -> Block:
    width = sum(w for _, w in _FIELDS[kind])
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out, at = {}, 0
    for f, w in _FIELDS[kind]:
        if w == 1:
            out[f] = planes[at].copy()
        else:
            full = np.zeros((planes.shape[1], 8), np.uint8)
            full[:, :w] = planes[at: at + w].T
            out[f] = full.view("<u8").ravel()
        at += w
    return out


def _concat(blocks: List[Block], kind: int) -> Block:
    return {f: np.concatenate([b[f] for b in blocks]) if blocks else np.zeros(0, np.uint64) for f, _ in _FIELDS[kind]}


def _take(block: Block, which: np.ndarray) -> Block:
    return {f: v[which] for f, v in block.items()}


def minimiser_runs(data: np.ndarray, starts: np.ndarray):
    """(key, content hash, first window, windows, minimiser's offset in the first window) over concatenated texts."""
    n, width = len(data), LENGTH - K + 1
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    roll = Rolling(data, _VALUES)
    at = np.arange(n - K + 1)
    key = mix64(roll.of(at, at + K))
    place = np.uint64((1 << _PLACE_BITS) - 1)
    low = (key & ~place) | at.astype(np.uint64)  # least hash, then leftmost
    have = 1
    while have < width:  # sliding minimum by doubling
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    where = (low & place).astype(np.int64)
    end = np.repeat(starts[1:], np.diff(starts))[: len(where)]
    window = np.flatnonzero(np.arange(len(where)) + LENGTH <= end)
    if len(window) == 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    where = where[window]
    new = np.ones(len(window), bool)
    new[1:] = (np.diff(window) != 1) | (np.diff(where) != 0)
    head = np.flatnonzero(new)
    last = np.concatenate((head[1:], [len(window)])) - 1
    first, offset = window[head], where[head] - window[head]
    content = mix64(roll.of(first, window[last] + LENGTH) + offset.astype(np.uint64))
    return key[where[head]], content, first, window[last] - first + 1, offset


def text_tag(text: bytes) -> int:
    """64 bits, signed, that tell rows of one id apart."""
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def _entries(batch: pa.RecordBatch) -> Iterator[Tuple[Block, int]]:
    """Entries of a batch (id, text), and the text bytes they stand for."""
    for b in batches_of(batch, 1 << 19):
        data, starts = utf8_view(b.column(1))
        ids = np.asarray(b.column(0).fill_null(NULL_ID)).astype(np.int64)
        raw = data.tobytes()
        tags = np.array([text_tag(raw[x:y]) for x, y in zip(starts[:-1].tolist(), starts[1:].tolist())], np.int64)
        if len(data) < (1 << _PLACE_BITS):
            pieces = [(0, data, starts, 0)]
        else:  # one by one, a very long text in overlapping pieces
            pieces = []
            for i, (x, y) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                for at in range(x, max(x + 1, y - LENGTH + 1), _PIECE):
                    stop = min(y, at + _PIECE + LENGTH - 1)
                    pieces.append((i, data[at:stop], np.array([0, stop - at]), at - x))
        for row0, part, edges, shift in pieces:
            key, content, first, n, offset = minimiser_runs(part, edges)
            row = row0 + np.searchsorted(edges, first, side="right") - 1
            place = first - edges[row - row0] + shift
            yield {"key": key.astype(np.uint64), "sk": content.astype(np.uint64) >> np.uint64(16), "doc": ids[row].view(np.uint64),
                   "tag": tags[row].view(np.uint64), "pos": (place << 16).astype(np.uint64), "n": n.astype(np.uint8), "a": offset.astype(np.uint8)}, len(part)


def first_places(e: Block) -> Tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, repeat, varied) per entry: the first place of its bytes; a later place of them; its key has other bytes too."""
    n = len(e["key"])
    first, repeat, varied = np.ones(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    order = np.argsort(e["key"])
    same = e["key"][order][1:] == e["key"][order][:-1]
    grouped = np.concatenate((same, [False])) | np.concatenate(([False], same)) if n else np.zeros(0, bool)
    some = order[grouped]
    if len(some) == 0:
        return first, repeat, varied
    some = some[np.lexsort((e["tag"][some].view(np.int64), e["pos"][some], e["doc"][some].view(np.int64), e["sk"][some], e["key"][some]))]
    key, sk = e["key"][some], e["sk"][some]
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    new = new_key | np.concatenate(([True], sk[1:] != sk[:-1]))
    head = some[np.flatnonzero(new)[np.cumsum(new) - 1]]
    elsewhere = (e["doc"][some] != e["doc"][head]) | (e["pos"][some] != e["pos"][head]) | (e["tag"][some] != e["tag"][head])  # not an identical row
    first[some] = new
    repeat[some] = ~new & elsewhere
    group = np.cumsum(new_key) - 1
    varied[some] = np.bincount(group, weights=new)[group] > 1
    return first, repeat, varied


def _as_spans(e: Block) -> Block:
    return {"doc": e["doc"], "tag": e["tag"], "pos": e["pos"], "len": e["n"] + np.uint64(LENGTH - 1)}


def _dealt(block: Block, kind: int, part: np.ndarray) -> Iterator[Tuple[int, int, bytes]]:
    """(kind, part, packed block) of each part."""
    order = np.argsort(part, kind="stable")
    ids, begin = np.unique(part[order], return_index=True)
    for p, lo, hi in zip(ids.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
        yield kind, int(p), pack(_take(block, order[lo:hi]), kind)


def _by_hash(values: np.ndarray, parts: int) -> np.ndarray:
    return ((mix64(values) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


_ROW = "kind int, part int, source int, payload binary"


def _rows(found: List[Tuple[int, int, bytes]], source: int = 0) -> pa.RecordBatch:
    kinds, parts, blobs = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()), pa.array([source] * len(kinds), pa.int32()), pa.array(blobs, pa.binary())],
        ["kind", "part", "source", "payload"])


def _index(parts: int, buckets: int):
    """Arrow function (id, text) -> packed entries by shard, and spans of repeats within the task by document bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            e = _concat(held, ENTRY)
            first, repeat, _ = first_places(e)
            kept, gone = _take(e, first), _as_spans(_take(e, repeat))
            kept = _take(kept, np.argsort(kept["key"]))
            return _rows([*_dealt(kept, ENTRY, _by_hash(kept["key"], parts)), *_dealt(gone, SPAN, _by_hash(gone["doc"], buckets))])

        for batch in batches:
            for block, n in _entries(batch):
                held.append(block)
                size += n
                if size >= _FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _merge_scan(buckets: int):
    """Group function of one (kind, part): merges levels and batch; spans pass through."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = int(pdf["kind"].iat[0])
        if kind != ENTRY:
            return pdf
        blocks = [unpack(x, ENTRY) for x in pdf["payload"]]
        fresh = np.repeat(pdf["source"].to_numpy() == 0, [len(b["key"]) for b in blocks])
        e = _concat(blocks, ENTRY)
        first, repeat, varied = first_places(e)
        # first places of keys with other bytes; only where the batch adds some, all are compared anew
        partial = first & varied
        touched = np.isin(e["key"], e["key"][partial & fresh]) if (partial & fresh).any() else np.zeros(len(fresh), bool)
        some = _take(e, partial & touched)
        gone = _as_spans(_take(e, repeat & fresh))
        level = _take(e, first & fresh)
        level = _take(level, np.argsort(level["key"]))
        out = [(ENTRY, int(pdf["part"].iat[0]), pack(level, ENTRY)), *_dealt(gone, SPAN, _by_hash(gone["doc"], buckets)),
               *_dealt({f: some[f] for f, _ in _FIELDS[PARTIAL]}, PARTIAL, _by_hash(some["doc"], buckets))]
        return pd.DataFrame({"kind": np.array([k for k, _, _ in out], np.int32), "part": np.array([p for _, p, _ in out], np.int32),
                             "source": np.zeros(len(out), np.int32), "payload": [x for _, _, x in out]})

    return run


def _merge_arrays(pdf: pd.DataFrame) -> pd.DataFrame:
    """One sorted array of a shard from those of several levels, which share no entry."""
    level = _concat([unpack(x, ENTRY) for x in pdf["payload"]], ENTRY)
    level = _take(level, np.argsort(level["key"], kind="stable"))
    return pd.DataFrame({"kind": np.array([ENTRY], np.int32), "part": pdf["part"].to_numpy()[:1].astype(np.int32),
                         "source": np.zeros(1, np.int32), "payload": [pack(level, ENTRY)]})


class SuffixIndex:
    """The levels, and the spans found so far.  Documents must be ingested in batches of rising id.

    ``text_bytes``: the bytes of all texts that are to come, from which shards and buckets are sized."""

    def __init__(self, text_bytes: int, task_bytes: int = 0):
        task_bytes = task_bytes or TASK_BYTES
        # An entry of 38 bytes stands for about 32 bytes of text.  A shard sends each bucket one block at most.
        self.parts = max(1, -(-text_bytes * 5 // (4 * task_bytes)))
        self.buckets = max(1, -(-text_bytes // task_bytes))
        self.tasks = max(self.parts, self.buckets)
        self.levels: List[Tuple[int, DataFrame]] = []  # (batches it stands for, packed entries), largest first
        self.found: List[DataFrame] = []  # spans and partial entries of every batch

    def ingest(self, docs: DataFrame, last: bool = False) -> None:
        """Index (id, text) and scan it against every level.  last: no later batch needs the merged level."""
        rows = docs.mapInArrow(_index(self.parts, self.buckets), _ROW)
        for i, (_, level) in enumerate(self.levels):
            rows = rows.union(level.withColumn("source", F.lit(i + 1)))
        out = rows.repartition(self.tasks, "kind", "part").groupBy("kind", "part").applyInPandas(_merge_scan(self.buckets), _ROW)
        if last:
            self.found.append(stage_table(out.where(F.col("kind") != ENTRY), "suffix-found"))
            return
        batch = stage_table(out, "suffix-batch")
        self.found.append(batch.where(F.col("kind") != ENTRY))
        # as a binary counter carries: the batch's array merges with levels of equal size only
        size, level, equal = 1, batch.where(F.col("kind") == ENTRY), []
        while self.levels and self.levels[-1][0] == size:
            n, other = self.levels.pop()
            size, equal = size + n, [*equal, other]
        if equal:
            for other in equal:
                level = level.union(other)
            level = stage_table(level.repartition(self.tasks, "part").groupBy("part").applyInPandas(_merge_arrays, _ROW), "suffix-level")
        self.levels.append((size, level))

    def together(self, texts: DataFrame, spans: DataFrame):
        """Both sides by document bucket, in as many tasks as there are buckets."""
        a, b = (df.repartition(self.buckets, "part").groupBy("part") for df in (texts, spans))
        return a.cogroup(b)

    def spans(self, docs: DataFrame) -> DataFrame:
        """All packed spans: those found whole, and those of partly repeated entries, settled from ``docs`` (id, text)."""
        found = self.found[0]
        for f in self.found[1:]:
            found = found.union(f)
        texts = docs.mapInArrow(_texts(self.buckets), "part int, id long, tag long, blob binary")
        wanted = found.where(F.col("kind") == PARTIAL).select("part", "payload")
        rows = self.together(texts, wanted).applyInPandas(
            _contents, "key long, doc long, pos long, tag long, n int, a int, content binary")
        partitions = max(self.tasks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = rows.repartition(partitions, "key").sortWithinPartitions("key", "doc", "pos", "tag")
        settled = dealt.mapInArrow(_settle(self.buckets), _ROW)
        return found.where(F.col("kind") == SPAN).union(settled).select("part", "payload")


def _texts(buckets: int):
    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for big in batches:
            for b in batches_of(big, 1 << 22):
                data, starts = utf8_view(b.column(1))
                ids = np.asarray(b.column(0).fill_null(NULL_ID)).astype(np.int64)
                raw = data.tobytes()
                texts = [raw[x:y] for x, y in zip(starts[:-1].tolist(), starts[1:].tolist())]
                # the length before the compressed bytes: the codec needs it back
                blobs = [len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_by_hash(ids.view(np.uint64), buckets).astype(np.int32)), pa.array(ids),
                     pa.array([text_tag(t) for t in texts], pa.int64()), pa.array(blobs, pa.binary())], ["part", "id", "tag", "blob"])

    return run


def _text(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return pa.Codec("zstd").decompress(blob[8:], n, asbytes=True) if n else b""


def _contents(texts: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """Bytes of the partly repeated entries of a bucket's documents."""
    e = _concat([unpack(x, PARTIAL) for x in wanted["payload"]], PARTIAL)
    e = _take(e, np.unique(np.stack([e["doc"], e["tag"], e["pos"]], 1), axis=0, return_index=True)[1])
    where: Dict[Tuple[int, int], bytes] = {(i, t): b for i, t, b in zip(texts["id"], texts["tag"], texts["blob"])}
    doc, tag = e["doc"].view(np.int64), e["tag"].view(np.int64)
    start, n = (e["pos"] >> np.uint64(16)).astype(np.int64), e["n"].astype(np.int64)
    content: List[bytes] = []
    open_, raw = None, b""
    for d, t, s, k in zip(doc.tolist(), tag.tolist(), start.tolist(), n.tolist()):  # sorted by document
        if (d, t) != open_:
            open_, raw = (d, t), _text(where[(d, t)])
        content.append(raw[s: s + k + LENGTH - 1])
    return pd.DataFrame({"key": e["key"].view(np.int64), "doc": doc, "pos": e["pos"].view(np.int64), "tag": tag,
                         "n": n.astype(np.int32), "a": e["a"].astype(np.int32), "content": content})


def _settle(buckets: int):
    """Stream entries sorted by key and place; send the windows that equal an earlier one, as spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, seen = None, np.zeros(0, np.uint64)
        for big in batches:
            for b in batches_of(big, 1 << 21, text_at=6):
                key = np.asarray(b.column(0)).view(np.uint64)
                doc, pos = np.asarray(b.column(1)).view(np.uint64), np.asarray(b.column(2)).view(np.uint64)
                tag = np.asarray(b.column(3)).view(np.uint64)
                n, a = np.asarray(b.column(4)).astype(np.int64), np.asarray(b.column(5)).astype(np.int64)
                data, starts = utf8_view(b.column(6))
                if len(data) == 0:
                    continue
                row = np.repeat(np.arange(len(n)), n)
                i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = starts[row] + i
                window = Rolling(data, _VALUES).of(at, at + LENGTH)
                same = mix64(mix64(window + key[row]) + (a[row] - i).astype(np.uint64))
                order = np.argsort(same, kind="stable")  # stable: rows and windows stay in place order
                again = np.zeros(len(row), bool)
                again[order[1:]] = same[order][1:] == same[order][:-1]
                if open_key is not None and key[0] == open_key:
                    mine = key[row] == open_key
                    again[mine] |= np.isin(same[mine], seen)
                else:
                    seen = np.zeros(0, np.uint64)
                last = same[key[row] == key[-1]]
                seen = np.unique(np.concatenate((seen, last))) if key[0] == key[-1] else np.unique(last)
                open_key = key[-1]
                head = again & ~np.concatenate(([False], again[:-1] & (row[1:] == row[:-1])))
                tail = again & ~np.concatenate((again[1:] & (row[1:] == row[:-1]), [False]))
                h, t = np.flatnonzero(head), np.flatnonzero(tail)
                spans = {"doc": doc[row[h]], "tag": tag[row[h]], "pos": pos[row[h]] + (i[h].astype(np.uint64) << np.uint64(16)),
                         "len": (t - h + LENGTH).astype(np.uint64)}
                yield _rows(list(_dealt(spans, SPAN, _by_hash(spans["doc"], buckets))))

    return run


def _remove(texts: pd.DataFrame, spans: pd.DataFrame, name: str, finish) -> pd.DataFrame:
    """Per document of a bucket: what was removed, and ``finish`` of its remaining bytes (one text at a time)."""
    s = _concat([unpack(x, SPAN) for x in spans["payload"]], SPAN)
    tag, start = s["tag"].view(np.int64), (s["pos"] >> np.uint64(16)).astype(np.int64)
    doc, end = s["doc"].view(np.int64), start + s["len"].astype(np.int64)
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    head = np.flatnonzero(new).tolist()
    of = {(d, t): (lo, hi) for d, t, lo, hi in zip(doc[head].tolist(), tag[head].tolist(), head, [*head[1:], len(doc)])}
    out = []
    for i, t, blob in zip(texts["id"], texts["tag"], texts["blob"]):
        raw = _text(blob)
        lo, hi = of.get((i, t), (0, 0))
        kept, at, removed, runs = [], 0, 0, 0
        for a, b in zip(start[lo:hi].tolist(), end[lo:hi].tolist()):
            if a > at or runs == 0:
                kept.append(raw[at:a])
                runs += 1
                at = a
            if b > at:
                removed += b - at
                at = b
        kept.append(raw[at:])
        out.append((None if i == NULL_ID else i, len(raw), removed, runs, finish(b"".join(kept))))
    return pd.DataFrame({"doc_id": pd.array([x[0] for x in out], dtype="Int64"), "n_bytes": [x[1] for x in out], "n_removed": [x[2] for x in out],
                         "n_spans": [x[3] for x in out], name: [x[4] for x in out]})


def _kept(texts: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    return _remove(texts, spans, "kept", bytes)


def _digests(texts: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    return _remove(texts, spans, "kept_sha256", lambda rest: hashlib.sha256(rest).hexdigest())


def id_batches(docs: DataFrame, batches: int) -> Tuple[List[DataFrame], int]:
    """((id, text) split into ranges of rising id, null ids first; the bytes of all texts)."""
    at, size = docs.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)] or [1.0]),
                        F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    cuts = sorted(set(at or [])) if batches > 1 else []
    edges = [None, *cuts, None]
    out = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        part = docs
        if lo is not None:
            part = part.where(F.col("id") > lo)
        if hi is not None:
            part = part.where(F.col("id").isNull() | (F.col("id") <= hi)) if lo is None else part.where(F.col("id") <= hi)
        out.append(part)
    return out, size


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 3, digest: bool = False,
                   task_bytes: int = 0) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), one row per input row; kept: the remaining bytes.

    ``task_bytes``: see TASK_BYTES, the default; ``digest`` gives kept_sha256 (lowercase hex) instead of kept."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts, text_bytes = id_batches(src, batches)
    index = SuffixIndex(text_bytes, task_bytes)
    for i, part in enumerate(parts):
        index.ingest(part, last=i == len(parts) - 1)
    spans = index.spans(src)
    texts = src.mapInArrow(_texts(index.buckets), "part int, id long, tag long, blob binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary")
    return index.together(texts, spans).applyInPandas(_digests if digest else _kept, schema)
