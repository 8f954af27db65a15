"""Operator 9 — line deduplication with once-seen and twice-seen Bloom filters.

A line's key is the line stripped of white space and lower-cased (A-Z).  Keys
of at least ``min_chars`` code points found in at least ``min_docs`` documents
lose all their lines except in the document with the largest id that holds
them.

1. Every document's long keys are hashed (64 bits) and digested (SHA-256), once,
   in the scan.  Each map task collapses the hashes' repeats and sends, per hash
   shard, one packed block: eight bytes per distinct hash, marked if the task met
   it in two documents.
2. A shard task passes its blocks through a once-seen Bloom filter into a
   twice-seen one, then tests the same hashes against the twice-seen filter.
   The filters' size follows the shard's own count of hashes; the number of
   shards follows the count of all hashes (``SHARD_HASHES``).
3. Only lines whose hash is suspected are confirmed: their distinct documents
   are counted per SHA-256 of the key, which stands for the key itself, and the
   largest id is taken.  A false positive of the filters, or two keys of one
   64-bit hash, cost a row, never a wrong result.
4. The places of the lines to drop are gathered per text and joined to it: the
   only time that texts shuffle.  Until then 32 bytes stand for each line.

Lines are looked up by their place in the text all along, so the work is linear
in the lines of a text, however many of them are suspected or dropped.

Hot keys: a hash leaves a map task at most twice; (key, document) pairs are
made distinct before they are counted, and both key joins are equi-joins of
small rows that adaptive execution splits.

Defined results: a null text counts as empty, one empty line; an empty text
stays one empty line; a text of any length is split whole; rows that share an
id are one document for counting, and a key they keep stays in all of them; a
row without an id is a document of its own, known by its text (equal ones are
one), smaller than all that have an id, and among such rows the one with the
largest hash of its text keeps the line; repeated rows give equal rows; an empty
table gives an empty table; other columns pass through ``drop_lines`` untouched
whatever their names.
"""

from __future__ import annotations

from typing import Iterator, Tuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE_CHARS, UPPER, mix64, stage_table

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_HASHES = 2_000_000
_TRIM = "concat(" + ", ".join(f"chr({ord(c)})" for c in SPACE_CHARS) + ")"


def key_sql(line: str) -> str:
    return f"translate(btrim({line}, {_TRIM}), '{UPPER}', '{LOWER}')"


def lines_sql(text: str) -> str:
    return f"split(coalesce({text}, ''), '\\n', -1)"


def _pack(shards: int, hashes) -> Iterator[pa.RecordBatch]:
    """One block per shard of a task's hashes, each hash at most once; twice: those met more often."""
    parts = [np.asarray(b.column(0), dtype=np.int64).view(np.uint64) for b in hashes]
    if not parts:
        return
    h, n = np.unique(np.concatenate(parts), return_counts=True)
    shard = (mix64(h) >> np.uint64(32)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
    ids, once, twice = [], [], []
    for s in range(shards):
        at = order[cuts[s]: cuts[s + 1]]
        if len(at):
            ids.append(s)
            once.append(h[at].tobytes())
            twice.append(h[at][n[at] > 1].tobytes())
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
        ["shard", "hashes", "again"])


class Bloom:
    """A Bloom filter over 64-bit hashes: 16 bits a hash, four probes (about 0.2 % false positives)."""

    def __init__(self, expected: int, bits_per_hash: int = 16, probes: int = 4):
        self.mask = np.uint64((1 << max(10, int(expected * bits_per_hash).bit_length())) - 1)
        self.bits = np.zeros((int(self.mask) + 1) // 8, np.uint8)
        self.probes = probes

    def _at(self, h: np.ndarray) -> Iterator[Tuple[np.ndarray, np.ndarray]]:
        a, b = mix64(h), mix64(~h) | np.uint64(1)
        for i in range(self.probes):
            bit = (a + np.uint64(i) * b) & self.mask
            yield (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8)

    def add(self, h: np.ndarray) -> None:
        for byte, bit in self._at(h):
            np.bitwise_or.at(self.bits, byte, bit)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for byte, bit in self._at(h):
            found &= (self.bits[byte] & bit) != 0
        return found


def _suspects(pdf: pd.DataFrame) -> pd.DataFrame:
    """Hashes of one shard that the twice-seen filter holds."""
    blocks = [np.frombuffer(b, np.uint64) for b in pdf["hashes"]]
    once = Bloom(sum(map(len, blocks)))
    twice = Bloom(sum(map(len, blocks)))
    for block, again in zip(blocks, pdf["again"]):
        twice.add(np.frombuffer(again, np.uint64))
        twice.add(block[once.has(block)])
        once.add(block)
    found = [block[twice.has(block)] for block in blocks]
    return pd.DataFrame({"h": np.unique(np.concatenate(found)).view(np.int64)})


def suspected_hashes(keys: DataFrame, shards: int) -> DataFrame:
    """Distinct hashes (column h) seen in two documents, and the filters' false positives."""
    blocks = keys.select("h").mapInArrow(lambda it: _pack(shards, it), "shard int, hashes binary, again binary")
    return blocks.groupBy("shard").applyInPandas(_suspects, "h long")


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _same(left: DataFrame, id_col: str, tag_col: str) -> Column:
    """Rows of ``left`` and those of a (pid, ptag) table that stand for the same text."""
    return left[id_col].eqNullSafe(F.col("pid")) & (left[tag_col] == F.col("ptag"))


def drop_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(pid, ptag, gone): an id, the hash of a text under it, and the places (from 0) of the lines that the text loses."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _text_hash(text_col).alias("tag"))
    keys = f"transform({lines_sql('text')}, l -> {key_sql('l')})"
    names = f"transform({keys}, k -> if(char_length(k) >= {int(min_chars)}, struct(xxhash64(k) as h, unhex(sha2(k, 256)) as key), null))"
    # 40 bytes a line; the hashes are read twice, the digests once
    hashed = stage_table(src.select("id", "tag", F.expr(names).alias("lines")), "line-hashes")
    count = hashed.agg(F.sum(F.size("lines.h"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // SHARD_HASHES))
    distinct = hashed.select(F.expr("explode(array_distinct(filter(lines.h, h -> h is not null)))").alias("h"))
    suspects = stage_table(suspected_hashes(distinct, shards), "line-suspects")
    found = hashed.select(F.col("id").alias("pid"), F.col("tag").alias("ptag"), F.posexplode("lines").alias("pos", "line")).where("line is not null")
    pairs = stage_table(found.select("pid", "ptag", "pos", "line.h", "line.key").join(suspects, "h").drop("h"), "line-pairs")
    # written, so that both sides of the join are exchanges and a hot key of ``pairs`` can be split
    holders = pairs.select("key", F.col("pid").alias("last"), F.expr("if(pid is null, ptag, null)").alias("last_tag")).distinct()
    repeated = stage_table(holders.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("last").alias("last"), F.max("last_tag").alias("last_tag"))
                           .where(F.col("docs") >= min_docs).drop("docs"), "line-repeated")
    keeps = F.expr("if(last is null, pid is null and ptag = last_tag, coalesce(pid = last, false))")
    return pairs.join(repeated, "key").where(~keeps).groupBy("pid", "ptag").agg(F.collect_set("pos").alias("gone"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: Tuple[str, str] = ()) -> DataFrame:
    """The input with ``text_col`` rewritten; ``counts`` names optional columns for lines before and lines dropped."""
    drops = drop_places(docs, id_col, text_col, min_chars, min_docs)
    base = docs.select(F.col(id_col).alias("_id"), _text_hash(text_col).alias("_tag"),
                       F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("_row"), F.col(text_col).alias("_text"))
    lines = base.join(drops, _same(base, "_id", "_tag"), "left").withColumn("_lines", F.expr(lines_sql("_text")))
    # Set difference and look-up by place: linear, where a test per line against a list would not be.
    kept = "if(gone is null, _lines, transform(array_except(sequence(0, size(_lines) - 1), gone), i -> _lines[i]))"
    split = lines.select("_row", "gone", "_text", F.expr("cast(size(_lines) as bigint)").alias("_n"), F.expr(kept).alias("_kept"))
    text = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n"))
    out = [(text if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns]
    if counts:
        out += [F.col("_n").alias(counts[0]), (F.col("_n") - F.size("_kept")).alias(counts[1])]
    return split.select(*out)
