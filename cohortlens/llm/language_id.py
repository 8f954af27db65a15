"""Operator 6 — language identification by interpolated Kneser-Ney character models.

Text is reduced to lower-cased letters and the marks that combine with them, as
whole code points, with one blank between words.  For each language a character
model of order ``ORDER`` is estimated with interpolated Kneser-Ney smoothing
(absolute discounts per order, continuation counts below the top).  n-grams are
64-bit hashes (two of a language's n-grams collide with a chance of 10^-6 at
10^7 of them).  ``BLOCK`` languages share one sorted array of hashes per order,
found through a directory of leading hash bits; a hit gives the final
log-probabilities of the block's languages, a miss adds the context's back-off
weights and looks one order down.  A text's language has the lowest
cross-entropy per character.

The score is that language's share in a softmax of -entropy x sqrt(characters):
characters depend on their neighbours, so a text carries less evidence than as
many independent draws, and the full length would give 1 for every text of a line.

Rejection is calibrated on labelled rows that trained no model: a language's
limit is the smallest of their cross-entropies that a further row of that
language exceeds with a chance of at most ``REJECT`` (rank ceil((m + 1)(1 -
REJECT)) of m rows; no limit below 1 / REJECT - 1 rows).  A text above the limit
of its language is ``rejected``.

Learning uses a bounded sample of the labelled rows outside the held-out fold,
drawn by a hash of id and text: of each language about ``SAMPLE_DOCS`` whole
texts train (at most ``TRAIN_SHARE`` of its rows), about ``CALIBRATION_DOCS``
others calibrate; a language of fewer than ``FEW`` rows trains on all and has no
limit.  n-gram counts are summed by Spark; the driver receives the sample's
distinct n-grams, and the model's size is that number times ``BLOCK``, however
many languages there are.  Prediction covers every whole text and never reads
lang, source or the id.

Defined results: a null text or one without a letter is ``und`` with score 0;
without any labelled row every text is ``und``; texts of any length are scored
whole, in linear time; ties go to the language that sorts first; repeated rows
are scored alike; rows without a language or a text do not train; an empty table
gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import unicodedata
from typing import Dict, Iterator, List, Optional, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, held_out, mix64

ORDER, BLOCK = 5, 8
SAMPLE_DOCS, CALIBRATION_DOCS, TRAIN_SHARE, FEW = 600, 1000, 0.7, 50
REJECT = 0.01
_EDGE = 1  # code of the mark between texts
_MARK = "\x01" * (ORDER - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE: List[np.ndarray] = []


def _tables() -> List[np.ndarray]:
    """Per code point: its code (0 for what is no letter or mark, else the lower-cased code point), and whether it is
    a letter."""
    if not _TABLE:
        code, letter = np.zeros(0x110000, np.int32), np.zeros(0x110000, bool)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                code[cp], letter[cp] = ord(c.lower()[0]), True
            elif unicodedata.category(c)[0] == "M":
                code[cp] = cp
        _TABLE.extend((code, letter))
    return _TABLE


def characters(texts: List[str]) -> Tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, first, letters): text i is codes[first[i]:first[i + 1]] after its leading marks; letters per text."""
    code, letter = _tables()
    points = np.frombuffer("".join(_MARK + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum([0] + [len(t) + len(_MARK) for t in texts])
    n_letters = np.add.reduceat(np.concatenate((letter[points], [False])).astype(np.int64), begin[:-1]) if texts else np.zeros(0, int)
    raw = code[points]
    raw[(begin[:-1, None] + np.arange(len(_MARK))).ravel()] = _EDGE
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 0) | (raw[:-1] != 0)
    first = np.concatenate(([0], np.cumsum(keep)))[begin]
    return raw[keep], first, n_letters


def windows(values: np.ndarray, order: int = ORDER) -> np.ndarray:
    """(positions, order): the characters of the n-gram that ends at every position from order - 1 on."""
    if len(values) < order:
        return np.zeros((0, order), values.dtype)
    return np.lib.stride_tricks.sliding_window_view(values, order)


def spread(codes: np.ndarray) -> np.ndarray:
    """A 64-bit value per code, the terms of n-gram hashes."""
    return mix64(codes.astype(np.uint64) + np.uint64(1))


def gram_hash(grams: np.ndarray) -> np.ndarray:
    """Hash of every row of spread codes."""
    out = np.zeros(len(grams), np.uint64)
    for j in range(grams.shape[1]):
        out = out * _BASE + grams[:, j]
    return out


class HashTable:
    """Sorted 64-bit hashes with a directory of leading bits; row numbers of keys, -1 where absent."""

    def __init__(self, keys: np.ndarray):
        h = mix64(keys)
        self.order = np.argsort(h)
        self.hashes = np.concatenate((h[self.order], [np.uint64(2**64 - 1)]))
        self.bits = max(1, int(len(keys) * 2).bit_length())
        edges = np.arange((1 << self.bits) + 1, dtype=np.float64) * 2.0 ** (64 - self.bits)
        self.start = np.searchsorted(self.hashes[:-1], np.concatenate((edges[:-1].astype(np.uint64), [np.uint64(2**64 - 1)])))
        self.longest = int(np.diff(self.start).max(initial=0)) + 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        h = mix64(keys)
        at = self.start[h >> np.uint64(64 - self.bits)]
        low = self.hashes[at] < h
        for _ in range(self.longest):
            if not low.any():
                break
            some = np.flatnonzero(low)
            at[some] = np.minimum(at[some] + 1, len(self.hashes) - 1)
            low[some] = self.hashes[at[some]] < h[some]
        found = (self.hashes[at] == h) & (at < len(self.order))
        return np.where(found, at, -1)


class Model:
    """Interpolated Kneser-Ney for a block of languages; build from (language, n-gram, count) of the top order.

    ``grams`` has a row of ``ORDER`` codes per n-gram; ``vocabulary`` is the number of characters that all blocks share."""

    def __init__(self, langs: List[str], lang_of: np.ndarray, grams: np.ndarray, counts: np.ndarray, vocabulary: Optional[int] = None):
        self.langs = langs
        n_langs = len(langs)
        self.tables: Dict[int, Tuple[HashTable, np.ndarray]] = {}  # order -> n-grams, log-probabilities
        self.backoff: Dict[int, Tuple[HashTable, np.ndarray]] = {}  # order -> contexts of order - 1, log weights
        # counts per order: the top's own, below it the number of distinct one-longer n-grams
        level = {ORDER: (lang_of, spread(grams), counts.astype(np.float64))}
        for n in range(ORDER - 1, 0, -1):
            lg, g, _ = level[n + 1]
            short = gram_hash(g[:, 1:])
            _, at, types = np.unique(np.stack([lg.astype(np.uint64), short], 1), axis=0, return_index=True, return_counts=True)
            level[n] = (lg[at], g[at, 1:], types.astype(np.float64))
        size = vocabulary or vocabulary_size(grams)
        self.floor = np.full(n_langs, -np.log(size), np.float32)
        for n in range(1, ORDER + 1):
            lg, g, c = level[n]
            every, at, row = np.unique(gram_hash(g), return_index=True, return_inverse=True)
            unique = g[at]
            count = np.zeros((len(every), n_langs))
            count[row, lg] = c
            discount = np.array([self._discount(c[lg == l]) for l in range(n_langs)])
            contexts, of = np.unique(gram_hash(unique[:, :-1]), return_inverse=True)
            total = np.zeros((len(contexts), n_langs))
            kinds = np.zeros((len(contexts), n_langs))
            np.add.at(total, of, count)
            np.add.at(kinds, of, count > 0)
            seen = total > 0
            weight = np.where(seen, discount * kinds / np.where(seen, total, 1), 1.0)
            lower = np.exp(self._logp(unique, n - 1)) if n > 1 else np.full((len(every), n_langs), 1.0 / size)
            p = np.where(seen[of], np.maximum(count - discount, 0) / np.where(seen, total, 1)[of], 0) + weight[of] * lower
            table, context_table = HashTable(every), HashTable(contexts)
            self.tables[n] = (table, np.log(p)[table.order].astype(np.float32))
            self.backoff[n] = (context_table, np.log(weight)[context_table.order].astype(np.float32))

    @staticmethod
    def _discount(c: np.ndarray) -> float:
        ones, twos = (c == 1).sum(), (c == 2).sum()
        return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones else 0.5

    def _logp(self, grams: np.ndarray, order: int) -> np.ndarray:
        """(rows, languages) log-probability of each row's last character after the order - 1 before it."""
        if order == 0:
            return np.tile(self.floor, (len(grams), 1))
        own = grams[:, grams.shape[1] - order:]
        table, logp = self.tables[order]
        at = table.find(gram_hash(own))
        out = logp[at]  # row -1 is replaced below
        miss = np.flatnonzero(at < 0)
        if len(miss):
            contexts, weight = self.backoff[order]
            rest = own[miss]
            c = contexts.find(gram_hash(rest[:, :-1]))
            out[miss] = np.where((c >= 0)[:, None], weight[c], 0) + self._logp(rest, order - 1)
        return out


def vocabulary_size(grams: np.ndarray) -> int:
    """Distinct last characters of n-grams, and one for all others."""
    return max(2, len(np.unique(grams[:, -1])) + 1)


class Models:
    """All languages, in blocks that share their arrays."""

    def __init__(self, langs: List[str], lang_of: np.ndarray, grams: np.ndarray, counts: np.ndarray):
        self.langs = langs
        size = vocabulary_size(grams)
        self.blocks = []
        for lo in range(0, len(langs), BLOCK):
            own = (lang_of >= lo) & (lang_of < lo + BLOCK)
            self.blocks.append(Model(langs[lo: lo + BLOCK], lang_of[own] - lo, grams[own], counts[own], size))

    def cross_entropy(self, texts: List[str]) -> Tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entropies per text and language, scored characters, letters)."""
        codes, first, letters = characters(texts)
        total = np.zeros((len(texts), len(self.langs)))
        if not texts:
            return total, np.zeros(0), letters
        g = windows(spread(codes))
        size = np.diff(first) - (ORDER - 1)  # a text's characters, after its marks
        start = first[:-1]  # gram i ends at i + ORDER - 1: a text's first character's gram is at its first mark
        some = size > 0
        for lo in range(0, len(g), 1 << 18):
            part = np.concatenate([m._logp(g[lo: lo + (1 << 18)], ORDER) for m in self.blocks], axis=1)
            a = np.clip(start - lo, 0, len(part))
            b = np.clip(start + size - lo, 0, len(part))
            sums = np.concatenate((np.zeros((1, part.shape[1])), np.cumsum(part, axis=0, dtype=np.float64)))
            total[some] += sums[b[some]] - sums[a[some]]
        return -total / np.maximum(size, 1)[:, None], size, letters


_GRAM = [f"c{j}" for j in range(ORDER)]


def _count(lang_at: Dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in batches_of(big, 1 << 22):
                langs = np.array([lang_at.get(x, -1) for x in b.column(0).to_pylist()])
                texts = b.column(1).to_pylist()
                for l in np.unique(langs[langs >= 0]):
                    codes, _, _ = characters([t or "" for t, x in zip(texts, langs) if x == l])
                    g = windows(codes)
                    g = g[g[:, -1] != _EDGE]
                    _, at, n = np.unique(gram_hash(spread(g)), return_index=True, return_counts=True)
                    cols = [pa.array(np.ascontiguousarray(c)) for c in g[at].T]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), l, np.int32)), *cols, pa.array(n.astype(np.int64))],
                                                     ["l", *_GRAM, "n"])

    return run


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int,
                    calibration_docs: int) -> Tuple[List[str], DataFrame]:
    """Languages, and (lang, text, trains) of about ``sample_docs`` training and ``calibration_docs`` other rows of each."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    rows = rows.where(~held_out(F.col("id")))
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(per)
    if not langs:
        return [], rows
    train_share = {lang: 1.0 if n < FEW else min(TRAIN_SHARE, sample_docs / n) for lang, n in per.items()}
    # two numbers per learnt language, looked up in the scan: no text is shuffled
    limits = []
    for lang, share in train_share.items():
        either = min(1.0, share + calibration_docs / per[lang])
        limits += [F.lit(lang), F.struct(F.lit(int(share * (1 << 30))).alias("train"), F.lit(int(either * (1 << 30))).alias("either"))]
    draw = F.pmod(F.xxhash64("id", "text", F.lit("language sample")), F.lit(1 << 30))
    drawn = rows.withColumn("limit", F.create_map(*limits)[F.col("lang")]).withColumn("draw", draw).where("draw < limit.either")
    return langs, drawn.select("lang", "text", F.expr("draw < limit.train").alias("trains"))


def rejection_limit(entropies: np.ndarray) -> float:
    """What a further row of the language exceeds with a chance of at most ``REJECT``; infinite where too few rows tell."""
    rank = int(np.ceil((len(entropies) + 1) * (1 - REJECT)))
    return float(np.sort(entropies)[rank - 1]) if rank <= len(entropies) else float("inf")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS, calibration_docs: int = CALIBRATION_DOCS):
    """(models, rejection limit per language); (None, {}) without labelled rows."""
    langs, sample = labelled_sample(docs, id_col, text_col, lang_col, sample_docs, calibration_docs)
    if not langs:
        return None, {}
    at = {l: i for i, l in enumerate(langs)}
    counted = (sample.where("trains").select("lang", "text")
               .mapInArrow(_count(at), "l int, " + ", ".join(f"{c} int" for c in _GRAM) + ", n long")
               .groupBy("l", *_GRAM).agg(F.sum("n").alias("n")).toPandas())
    if not len(counted):
        return None, {}
    models = Models(langs, counted["l"].to_numpy().astype(np.int64), counted[_GRAM].to_numpy().astype(np.int64),
                    counted["n"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def entropies(batches):
        for big in batches:
            for b in batches_of(big, 1 << 22):
                names = np.array([at[x] for x in b.column(0).to_pylist()], np.int64)
                h, size, letters = shared.value.cross_entropy(b.column(1).to_pylist())
                ok = letters > 0
                yield pa.RecordBatch.from_arrays([pa.array(names[ok].astype(np.int32)), pa.array(h[np.arange(len(h)), names][ok])], ["l", "h"])

    # two numbers for each of about calibration_docs rows a language
    cal = sample.where("not trains").select("lang", "text").mapInArrow(entropies, "l int, h double").toPandas()
    l, h = cal["l"].to_numpy(), cal["h"].to_numpy(dtype=np.float64)
    return shared, {i: rejection_limit(h[l == i]) for i in range(len(langs))}


def predict(docs: DataFrame, trained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, cross_entropy, rejected), one row per input row."""
    shared, limits = trained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in batches_of(big, 1 << 22):
                texts = ["" if t is None else t for t in b.column(1).to_pylist()]
                if shared is None:
                    n = len(texts)
                    out = [["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)]
                else:
                    model = shared.value
                    h, size, letters = model.cross_entropy(texts)
                    best = h.argmin(axis=1)
                    lowest = h[np.arange(len(h)), best]
                    gap = (h - lowest[:, None]) * np.sqrt(np.maximum(size, 1))[:, None]
                    ok = letters > 0
                    score = np.where(ok, 1 / np.exp(-gap).sum(axis=1), 0.0)
                    limit = np.array([limits[i] for i in range(len(model.langs))])
                    out = [[model.langs[i] if k else "und" for i, k in zip(best, ok)], score,
                           np.where(ok, lowest, 0.0), ~ok | (lowest > limit[best])]
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)],
                                                 [id_col, "lang_pred", "score", "cross_entropy", "rejected"])

    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")
