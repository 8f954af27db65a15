"""Helpers shared by the training-data operators.

``stage_table`` cuts lineage with a Parquet table in the folder that
``spark.checkpoint.dir`` names (shared by driver and executors, so a lost
executor loses nothing).  The folder is read from the session; only where a
local session names none is a scratch folder set.  The Arrow helpers view a
batch's strings as one byte array, for numpy work inside tasks.
"""

from __future__ import annotations

import tempfile
import uuid
from typing import Iterator, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the word and line contracts, as a Java character class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a scratch folder only for a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlens-llm-", dir="/tmp"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it reread (a durable cut of the lineage)."""
    path = f"{work_dir(df.sparkSession).rstrip('/')}/cohortlens-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character unchanged."""
    return F.translate(text, UPPER, LOWER)


def held_out(id_col: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves remainder 0; rows without an id are held out too."""
    return F.coalesce(F.crc32(id_col.cast("string")) % F.lit(folds) == 0, F.lit(True))


def batches_of(batch: pa.RecordBatch, max_bytes: int, text_at: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``max_bytes`` (a longer single text stays whole)."""
    text = batch.column(text_at)
    if batch.num_rows == 0:
        return
    sizes = np.diff(_offsets(text))
    step = (np.cumsum(sizes) - sizes) // max_bytes
    cuts = np.flatnonzero(np.diff(step)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(int(lo), int(hi - lo))


def _offsets(col) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    raw = np.frombuffer(col.buffers()[1], dtype=kind)
    return raw[col.offset: col.offset + len(col) + 1].astype(np.int64)


def utf8_view(col) -> Tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): the column's texts as one UTF-8 byte array, row i in starts[i]:starts[i+1].

    Null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = _offsets(col)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def byte_values(seed: int) -> np.ndarray:
    """256 fixed odd 64-bit values, one per byte."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (murmur3's), elementwise."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Polynomial prefix hash modulo 2^64 over one byte array; any substring's hash in O(1)."""

    _base = np.uint64(0x9E3779B97F4A7C15)
    _inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

    def __init__(self, data: np.ndarray, values: np.ndarray):
        n = len(data)
        self._down = self._powers(self._inverse, n + 1)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * self._powers(self._base, n), out=self._sum[1:])

    _cache: dict = {}

    @classmethod
    def _powers(cls, base: np.uint64, n: int) -> np.ndarray:
        have = cls._cache.get(int(base))
        if have is None or len(have) < n:
            size = max(1 << 16, 1 << int(n).bit_length())
            have = np.full(size, base, np.uint64)
            have[0] = 1
            with np.errstate(over="ignore"):
                have = np.cumprod(have)
            cls._cache[int(base)] = have
        return have[:n]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self._sum[end] - self._sum[start]) * self._down[start]


LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
_IS_TOKEN = np.zeros(256, bool)
_IS_TOKEN[48:58] = _IS_TOKEN[65:91] = _IS_TOKEN[97:123] = _IS_TOKEN[128:] = True


def token_bounds(data: np.ndarray, starts: np.ndarray) -> Tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, first) of the tokens of all texts: runs of letters, digits and non-ASCII bytes.

    Those of text i are first[i]:first[i + 1]."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    is_token = _IS_TOKEN[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.concatenate(([False], is_token[:-1])) & ~edge[:-1]
    after = np.concatenate((is_token[1:], [False])) & ~edge[1:]
    begin = np.flatnonzero(is_token & ~before)
    return begin, np.flatnonzero(is_token & ~after) + 1, np.searchsorted(begin, starts)
