"""Operator 10 — SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits: bit b is 1 if over half of the text's word-shingle
hashes (XXH64, seed 42) have it.  Texts link at ``max_bits`` or fewer differing
bits, and a class is a connected component of those links.

Candidates: split the bits into m parts and give part i a threshold t_i, with
sum(t_i) = max_bits - m + 1 and t_i >= -1 (-1: the part is not probed).  Two
fingerprints within max_bits then agree within t_i on some part i.  Correlated
bits share a part, so that a skewed part can be left out; the thresholds come
from a dynamic programme over estimated candidate counts; every collision is
verified on all 64 bits.  All statistics cover all distinct fingerprints.

Copies collapse first: only distinct fingerprints are probed.  A bucket's
members are compared in numpy and the bucket sends on a spanning forest of its
verified links, so a group of n near copies costs at most n - 1 links per
bucket, never all its pairs.  Components are found by alternating large-star
and small-star joins, each round written to the shared folder.

Defined results: a null or empty text, or one of white space, has fingerprint
zero and links like any other; fewer words than a shingle: the whole sequence
is hashed; texts of any length are hashed whole; repeated rows fall into one class; a class's id is the smallest
non-null doc id (null if it has none); an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from math import comb
from typing import Iterator, List, Sequence, Tuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table

SHINGLE, MAX_BITS, SEED = 4, 4, 42
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, as an unsigned integer."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[: len(words) - shingle] + 1)).tolist()
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())], np.uint64)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes; eight byte-wide counters at a time, at most 255 hashes each."""
    cuts = np.arange(0, len(h), 255)
    bits = 0
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, cuts)
        for byte in range(8):
            count = int(((lanes >> np.uint64(8 * byte)) & np.uint64(255)).sum())
            bits |= (2 * count > len(h)) << (8 * byte + k)
    return bits


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 hashed: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; ``hashed`` adds th, a 64-bit hash of the text."""
    extra = ["th"] if hashed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], ["doc_id", "fp", *extra])

    th = [F.xxhash64(text_col) for _ in extra]
    return docs.select(F.col(id_col).cast("long"), F.col(text_col), *th).mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", "fp", *extra]))


# --- partitions and thresholds ------------------------------------------------

def part_count(n: int, max_bits: int, bits: int = 64) -> int:
    """Parts m with the least expected rows: probes, and collisions of n spread fingerprints."""

    def cost(m: int) -> float:
        width, spare = bits / m, max_bits - m + 1
        t = [spare // m + (i < spare % m) for i in range(m)]
        ball = sum(comb(int(width), d) for ti in t for d in range(ti + 1))
        return n * ball + n * n * ball / 2.0 ** width

    return min(range(1, max_bits + 2), key=cost)


def group_bits(ones: np.ndarray, both: np.ndarray, n: int, m: int) -> List[List[int]]:
    """m parts of the 64 bits; each part grows by the bit most correlated with its members."""
    p = ones / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, parts = list(range(64)), []
    for i in range(m):
        size = 64 // m + (i < 64 % m)
        part = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < size:
            nxt = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(nxt)
            left.remove(nxt)
        parts.append(sorted(part))
    return parts


def thresholds(widths: Sequence[int], pairs: Sequence[float], n: int, max_bits: int) -> List[int]:
    """t_i >= -1 with sum max_bits - m + 1 and the least estimated cost (dynamic programme).

    pairs[i]: pairs equal on part i.  Within t bits they are estimated as pairs x the ball's volume;
    probing costs n x the volume."""
    total = max_bits + 1  # of t_i + 1 over all parts
    best = {0: (0.0, [])}
    for w, c in zip(widths, pairs):
        step = {}
        for used, (cost, ts) in best.items():
            for t1 in range(total - used + 1):
                ball = sum(comb(w, d) for d in range(t1))
                new = (cost + ball * (n + c), ts + [t1 - 1])
                if used + t1 not in step or new[0] < step[used + t1][0]:
                    step[used + t1] = new
        best = step
    return best[total][1]


def part_values(fp: np.ndarray, part: Sequence[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for j, b in enumerate(part):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def _ball(width: int, radius: int) -> List[np.ndarray]:
    """XOR masks of 1..radius bits."""
    from itertools import combinations
    return [np.uint64(sum(1 << b for b in c)) for d in range(1, radius + 1) for c in combinations(range(width), d)]


def _fp(batch: pa.RecordBatch, at: int = 0) -> np.ndarray:
    return np.asarray(batch.column(at)).astype(np.int64, copy=False).view(np.uint64)


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64), np.int64)
    for b in batches:
        fp = _fp(b)
        for lo in range(0, len(fp), 65536):
            x = np.unpackbits(fp[lo:lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.int64)
    i, j = np.divmod(np.arange(4096), 64)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())],
                                     ["i", "j", "n"])


def plan_parts(fps: DataFrame, max_bits: int = MAX_BITS) -> Tuple[List[List[int]], List[int]]:
    """Parts and thresholds for a table of distinct fingerprints (column fp).

    To the driver come 64 x 64 bit counts and one number per part."""
    both = np.zeros((64, 64), np.int64)
    for r in fps.select("fp").mapInArrow(_bit_counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r["i"], r["j"]] = r["n"]
    n = fps.count()
    m = part_count(n, max_bits)
    parts = group_bits(np.diag(both), both, n, m)

    def values(batches):
        for b in batches:
            fp = _fp(b)
            for i, part in enumerate(parts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fp), i, np.int32)), pa.array(part_values(fp, part).view(np.int64))], ["i", "v"])

    same = {r["i"]: r["c"] for r in fps.select("fp").mapInArrow(values, "i int, v long").groupBy("i", "v")
            .agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy("i").agg(F.sum(F.expr("k * (k - 1) / 2")).alias("c")).collect()}
    return parts, thresholds([len(p) for p in parts], [same.get(i, 0.0) for i in range(m)], n, max_bits)


# --- probing and verifying ----------------------------------------------------

def _probes(parts, radii):
    balls = [_ball(len(p), t) if t > 0 else [] for p, t in zip(parts, radii)]

    def run(batches):
        for b in batches:
            fp = _fp(b)
            for lo in range(0, len(fp), 4096):
                some = fp[lo:lo + 4096]
                for i, part in enumerate(parts):
                    if radii[i] < 0:
                        continue
                    v = part_values(some, part) | np.uint64(i << 59) if len(part) < 59 else part_values(some, part)
                    masks = np.array([0, *balls[i]], np.uint64)
                    key = (v[None, :] ^ masks[:, None]).ravel()
                    probe = np.repeat(masks != 0, len(some))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(np.tile(some, len(masks)).view(np.int64)), pa.array(probe)],
                        ["key", "fp", "probe"])

    return run


def _forest(fp: np.ndarray, max_bits: int) -> Tuple[List[int], List[int]]:
    """Spanning links of the verified links among some fingerprints."""
    a, b = [], []
    left = fp
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        root = front[0]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= max_bits
            if near.any():
                found = left[near]
                left = left[~near]
                front.extend(found)
                a.extend([root] * len(found))
                b.extend(found)
    return a, b


def _links(max_bits: int, small: int = 12):
    """Stream buckets (sorted by key) and yield links; a bucket may span batches."""

    def buckets(key, fp, probe, out_a, out_b):
        cuts = np.flatnonzero(np.diff(key)) + 1
        start = np.concatenate(([0], cuts))
        size = np.diff(np.concatenate((start, [len(key)])))
        has_index = np.add.reduceat((~probe).astype(np.int64), start) > 0
        live = has_index & (size > 1)
        for s in range(1, small):  # small buckets: every member with the s-th after it, all buckets at once
            some = live & (size > s) & (size <= small)
            if not some.any():
                break
            lo = np.concatenate([np.arange(x, x + n - s) for x, n in zip(start[some].tolist(), size[some].tolist())])
            near = np.bitwise_count(fp[lo] ^ fp[lo + s]) <= max_bits
            out_a.append(fp[lo[near]])
            out_b.append(fp[lo[near] + s])
        for k in np.flatnonzero(live & (size > small)):
            a, b = _forest(np.unique(fp[start[k]: start[k] + size[k]]), max_bits)
            out_a.append(np.array(a, np.uint64))
            out_b.append(np.array(b, np.uint64))

    def emit(a, b):
        a, b = np.concatenate(a), np.concatenate(b)
        low, high = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
        pairs = np.unique(np.stack([low, high], 1)[low != high], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches):
        rest: list = []  # batches of the bucket that is still open
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key, fp, probe = np.asarray(batch.column(0)), _fp(batch, 1), batch.column(2).to_numpy(zero_copy_only=False)
            last = np.flatnonzero(key != key[-1])
            first_open = int(last[-1]) + 1 if len(last) else 0
            if first_open == 0 and rest and rest[-1][0][-1] == key[-1]:
                rest.append((key, fp, probe))
                continue
            head = (key[:first_open], fp[:first_open], probe[:first_open])
            done = [np.concatenate(x) for x in zip(*rest, head)] if rest else list(head)
            rest = [(key[first_open:], fp[first_open:], probe[first_open:])]
            if len(done[0]):
                a: list = [np.zeros(0, np.uint64)]
                b: list = [np.zeros(0, np.uint64)]
                buckets(*done, a, b)
                yield emit(a, b)
        if rest:
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            buckets(*[np.concatenate(x) for x in zip(*rest)], a, b)
            yield emit(a, b)

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Verified links (a < b) whose components are those of all pairs within ``max_bits``."""
    parts, radii = plan_parts(fps, max_bits)
    partitions = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fps.select("fp").mapInArrow(_probes(parts, radii), "key long, fp long, probe boolean")
    dealt = rows.repartition(partitions, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links(max_bits), "a long, b long").distinct()


def components(edges: DataFrame, name: str = "simhash") -> DataFrame:
    """(node, root): the smallest node of each component of the edges (a, b); alternating star joins."""
    now = stage_table(edges.select("a", "b"), f"{name}-edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        # large star: every neighbour above a node is hung on the node's smallest neighbour (or itself)
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: a node and its smaller neighbours are hung on the smallest of them
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")
        now = stage_table(hung.union(least.select(F.col("m"), F.col("u"))).distinct(), f"{name}-edges")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row."""
    return _classes(fingerprints(docs, id_col, text_col, shingle), max_bits, ["doc_id", "fp", "component_id"])


def _classes(fp: DataFrame, max_bits: int, columns: List[str]) -> DataFrame:
    """The rows of ``fingerprints`` with their class: component_id, and root (one fingerprint of the class)."""
    fp = stage_table(fp, "simhash-fp")
    nodes = stage_table(fp.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    roots = components(links(nodes, max_bits))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of = stage_table(rooted.join(lows, "root").select(F.col("fp").alias("nfp"), *[c for c in ("component_id", "root") if c in columns]),
                     "simhash-components")
    return fp.join(of, F.col("fp") == F.col("nfp")).select(*columns)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class is kept: the one with the class's id.

    The choice is by class and row, so a row stays for its own class whatever other text its id has; of several
    rows of a class with its id the one with the smallest text stays.  A row without an id cannot be chosen by it:
    of those of a class the one with the smallest text stays too."""
    fp = fingerprints(docs, id_col, text_col, shingle, hashed=True)
    near = _classes(fp, max_bits, ["doc_id", "th", "component_id", "root"])
    able = stage_table(near.where("doc_id is null or doc_id = component_id").select(
        "root", "th", F.coalesce("doc_id", F.lit(0)).alias("k"), F.isnull("doc_id").alias("unnamed")).distinct(), "simhash-able")
    key = F.col(id_col).cast("long")
    row = docs.select(F.coalesce(key, F.lit(0)).alias("k"), F.isnull(key).alias("unnamed"), F.xxhash64(text_col).alias("th"),
                      F.col(text_col).alias("_text"), F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    place = ["root", "k", "unnamed"]
    count = able.groupBy(*place).agg(F.min("th").alias("th"), F.count(F.lit(1)).alias("n"))
    chosen = count.where("n = 1").select("k", "unnamed", "th")
    many = count.where("n > 1").select(*place)
    if not many.isEmpty():  # texts of one class and id: only these are compared
        least = F.min_by("th", F.struct("_text")).alias("th")  # in a struct, a null text is the smallest
        tied = row.select("k", "unnamed", "th", "_text").join(able.join(many, place), ["k", "unnamed", "th"])
        chosen = chosen.union(tied.groupBy(*place).agg(least).select("k", "unnamed", "th"))
    # an inner join, as a semi-join would be moved below the aggregate, which is to collapse copies in the map tasks
    one = row.groupBy("k", "unnamed", "th").agg(F.first("_row").alias("_row"))
    return one.join(chosen, ["k", "unnamed", "th"]).select("_row.*")
