"""Operator 5 — benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, digits and non-ASCII bytes, A-Z lower-cased.  A
mask hashes the marked tokens of a span and ignores the rest, so a substituted
token under an ignored position leaves the hash unchanged.  ``MASKS`` find
every stretch of ``WINDOW`` tokens with at most two substitutions (tested over
all 78 placements).  An item shorter than WINDOW is also hashed whole, once for
every placement of its allowed substitutions that MASKS would miss
(``whole_masks``), so items of every length are searched as sparsely as they
are compared.

1. Benchmark items are hashed under every mask, at every position.
2. Training documents are hashed alike in numpy over whole Arrow batches; a
   bitmap lets pass the positions whose hash the benchmark may hold, each with
   the tokens around it.  Its size follows the number of benchmark hashes (16
   bits each, at least 2 MB), up to 32 MB for 16 million of them; a larger
   benchmark fills it more, which costs shuffled positions, not results.
   Places of one text with the same hash and the same tokens around them are
   one place, on both sides: whatever repeats inside a text is sent and
   compared once, not once per pair of places.
3. Both sides join on the hash (a plain equi-join: nothing is broadcast by
   hint, and adaptive execution splits a hash that many documents share).
4. Around each hit the aligned tokens are compared: a pair is an overlap if
   some stretch of WINDOW tokens (the whole item, if shorter) agrees in at
   least ``SIMILARITY`` of them.

Defined results: null or empty texts and items have no tokens and match
nothing; texts of any length are searched whole; items of fewer than ``MIN_ITEM`` tokens overlap only where all their
tokens do (0.8 of them allows no substitution); repeated rows and ties give one
row per (document, item) with the best count; a null document id is kept as
null; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil
from typing import Iterator, List, NamedTuple, Sequence, Tuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, Rolling, batches_of, byte_values, mix64, stage_table, token_bounds, utf8_view

MASKS = ("1101111", "111100011")
WINDOW, SIMILARITY, MIN_ITEM = 13, 0.8, 5
_SIDE = WINDOW - 1
_WIDTH = _SIDE + WINDOW + _SIDE
_LEAST_BITS, _MOST_BITS, _SEGMENT_BITS = 24, 28, 15

_VALUES = byte_values(5)
_PLACES = np.random.default_rng(55).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tokens(data: np.ndarray, starts: np.ndarray) -> Tuple[np.ndarray, np.ndarray]:
    """(token hashes, first): the tokens of text i are first[i]:first[i + 1]."""
    begin, end, first = token_bounds(data, starts)
    if len(begin) == 0:
        return np.zeros(0, np.uint64), first
    return mix64(Rolling(LOWER_BYTES[data], _VALUES).of(begin, end)), first


def mask_hashes(tok: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash of the marked tokens at every position where the span fits into the array."""
    n = len(tok) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, salt, np.uint64)
    for o, marked in enumerate(mask):
        if marked == "1":
            h += tok[o: o + n] * _PLACES[o]
    return mix64(h)


class Mask(NamedTuple):
    marks: str
    salt: int
    whole: bool  # only for items of that very length


def whole_masks(n: int) -> List[str]:
    """Whole-length masks of an item of n < WINDOW tokens: one for each placement of as many
    substitutions as SIMILARITY allows that no mask of MASKS survives at any position."""
    spare = n - ceil(SIMILARITY * n - 1e-9)
    spans = [{at + o for o, marked in enumerate(m) if marked == "1"} for m in MASKS for at in range(n - len(m) + 1)]
    return ["".join("0" if o in bad else "1" for o in range(n))
            for bad in combinations(range(n), spare) if all(s & set(bad) for s in spans)]


def contexts(tok: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(len(at), _WIDTH) 32-bit tokens from at - _SIDE on; 0 outside first:last of the text."""
    where = at[:, None] + np.arange(-_SIDE, _WIDTH - _SIDE)[None, :]
    inside = (where >= first[:, None]) & (where < last[:, None])
    short = (tok >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return np.where(inside, short[np.clip(where, 0, max(len(tok) - 1, 0))], np.uint32(0))


class _Places:
    """Tells the first place of each (text, hash, context) of a batch."""

    def __init__(self):
        self._seen = set()

    def new(self, row: np.ndarray, h: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        whole = np.ascontiguousarray(np.concatenate((row[:, None].view(np.uint32), h[:, None].view(np.uint32), ctx), axis=1))
        keys, at = np.unique(whole.view(np.dtype((np.void, whole.shape[1] * 4)))[:, 0], return_index=True)
        fresh = [i for key, i in zip(keys.tolist(), at.tolist()) if key not in self._seen]
        self._seen.update(keys.tolist())
        return np.array(sorted(fresh), np.int64)


def _seeds(masks: Sequence[Mask], bitmap=None, slot_bits: int = 0):
    """Arrow function (id, text) -> (h, id, context, n_tokens) of items; with a bitmap of documents: only hashes it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8) if bitmap is not None else None
        for big in batches:
            for b in batches_of(big, 1 << 21):
                tok, first = tokens(*utf8_view(b.column(1)))
                if len(tok) == 0:
                    continue
                row = np.repeat(np.arange(b.num_rows), np.diff(first))
                end = first[1:][row]
                for mask, salt, whole in masks:
                    h = mask_hashes(tok, mask, salt)
                    at = np.arange(len(h))
                    ok = at + len(mask) <= end[: len(h)]
                    if whole and bits is None:
                        ok &= (end - first[:-1][row] == len(mask))[: len(h)]
                    if bits is not None:
                        slot = (h >> np.uint64(64 - slot_bits)).astype(np.int64)
                        ok &= (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1) != 0
                    at = at[ok]
                    if whole and "0" not in mask and len(at):  # no context decides: one place of a text is enough
                        order = np.lexsort((at, h[at], row[at]))
                        r, g = row[at][order], h[at][order]
                        at = at[order[np.concatenate(([True], (r[1:] != r[:-1]) | (g[1:] != g[:-1])))]]
                    places = _Places()
                    for lo in range(0, len(at), 65536):
                        some = at[lo: lo + 65536]
                        ctx = contexts(tok, first[:-1][row[some]], first[1:][row[some]], some)
                        new = places.new(row[some], h[some], ctx)
                        some, ctx, r = some[new], ctx[new], row[some][new]
                        ctx_col = pa.FixedSizeBinaryArray.from_buffers(
                            pa.binary(_WIDTH * 4), len(some), [None, pa.py_buffer(np.ascontiguousarray(ctx))]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h[some].view(np.int64)), b.column(0).take(pa.array(r)), ctx_col,
                             pa.array((first[1:] - first[:-1])[r].astype(np.int32))], ["h", "id", "ctx", "n"])

    return run


def _segment(pdf: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(1 << _SEGMENT_BITS, np.uint8)
    slot = pdf["slot"].to_numpy()
    bits[slot & ((1 << _SEGMENT_BITS) - 1)] = 1
    return pd.DataFrame({"segment": [int(slot[0]) >> _SEGMENT_BITS], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def _slot_bits(hashes: int) -> int:
    """The bitmap has 2^bits bits: 16 for each hash, between 2 MB and 32 MB."""
    return min(_MOST_BITS, max(_LEAST_BITS, (16 * hashes).bit_length()))


def _bitmap(seeds: DataFrame, bits: int) -> bytes:
    """2^bits bits, one per leading ``bits`` bits of a benchmark hash: at most 2^(bits - 15) rows of 4 KB come to the driver."""
    slots = seeds.select(F.shiftrightunsigned("h", 64 - bits).alias("slot")).distinct()
    rows = (slots.withColumn("segment", F.shiftright("slot", _SEGMENT_BITS))
            .groupBy("segment").applyInPandas(_segment, "segment long, bits binary").collect())
    size = (1 << _SEGMENT_BITS) // 8
    out = bytearray((1 << bits) // 8)
    for r in rows:
        out[r["segment"] * size: (r["segment"] + 1) * size] = r["bits"]
    return bytes(out)


def best_window(doc: np.ndarray, item: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Most equal tokens in any aligned stretch of ``length`` tokens that lies inside both contexts."""
    both = (doc != 0) & (item != 0)
    same = np.cumsum(np.pad(both & (doc == item), ((0, 0), (1, 0))), axis=1)
    there = np.cumsum(np.pad(both, ((0, 0), (1, 0))), axis=1)
    best = np.zeros(len(doc), np.int64)
    for n in np.unique(length):
        of = length == n
        full = (there[of, n:] - there[of, :-n]) == n
        best[of] = np.where(full, same[of, n:] - same[of, :-n], 0).max(axis=1)
    return best


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 8192):
            s = b.slice(lo, 8192)
            doc, item = (np.frombuffer(utf8_view(s.column(i))[0], np.uint32).reshape(-1, _WIDTH) for i in (1, 3))
            length = np.minimum(s.column(4).to_numpy(), WINDOW).astype(np.int64)
            best = best_window(doc, item, length)
            ok = pa.array(best >= np.ceil(SIMILARITY * length - 1e-9))
            out = [s.column(0), s.column(2), pa.array(best.astype(np.int32)), pa.array(length.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([x.filter(ok) for x in out], ["doc_id", "item_id", "matched", "of_tokens"])


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, of_tokens): one row per document and item that overlap."""
    return _overlaps(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), "long", benchmark, item_col, item_text_col)


def _overlaps(docs: DataFrame, id_type: str, benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """The overlaps of docs (id, text), whose id may be of any type that can be grouped."""
    spark = docs.sparkSession
    masks = [Mask(m, i + 1, False) for i, m in enumerate(MASKS)]
    masks += [Mask(m, 100 + i, True) for i, m in enumerate(m for n in range(1, WINDOW) for m in whole_masks(n))]
    seed_schema = "h long, id {}, ctx binary, n int"
    items = benchmark.select(F.col(item_col).cast("long"), F.col(item_text_col).cast("string"))
    seeds = stage_table(items.mapInArrow(_seeds(masks), seed_schema.format("long")), "benchmark-seeds")  # read four times
    lengths = {r["n"] for r in seeds.where(F.col("n") < WINDOW).select("n").distinct().collect()}  # below 13 values
    used = [m for m in masks if not m.whole or len(m.marks) in lengths]
    bits = _slot_bits(seeds.count())
    bitmap = spark.sparkContext.broadcast(_bitmap(seeds, bits))
    hits = docs.mapInArrow(_seeds(used, bitmap, bits), seed_schema.format(id_type))
    pairs = (hits.select("h", F.col("id").alias("doc_id"), F.col("ctx").alias("doc_ctx"))
             .join(seeds.select("h", F.col("id").alias("item_id"), F.col("ctx").alias("item_ctx"), "n"), "h")
             .select("doc_id", "doc_ctx", "item_id", "item_ctx", "n"))
    found = pairs.mapInArrow(_verify, f"doc_id {id_type}, item_id long, matched int, of_tokens int")
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("of_tokens").alias("of_tokens"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item.

    Rows that share an id are one document and go together; a row without an id is a document of its own and
    goes by its own text (known again by a 64-bit hash)."""
    own = F.when(docs[id_col].isNull(), F.xxhash64(docs[text_col].cast("string")))
    keyed = docs.select(F.struct(docs[id_col].cast("long").alias("id"), own.alias("own")), docs[text_col].cast("string"))
    dirty = (_overlaps(keyed, "struct<id: long, own: long>", benchmark, "item_id", "text")
             .select(F.col("doc_id.id").alias("_dirty"), F.col("doc_id.own").alias("_own")).distinct())
    return docs.join(dirty, docs[id_col].eqNullSafe(dirty["_dirty"]) & own.eqNullSafe(dirty["_own"]), "left_anti")
