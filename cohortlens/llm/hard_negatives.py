"""Operator 13 — hard-negative mining by length buckets and coordinate pruning.

For every anchor row: its positives are the first rows of its own label by
inner product, and for each positive the hard negatives are the first rows of
other labels whose score lies in a band below the positive's score.

Vectors are scaled and floored to integers, so scores are exact.  The search
runs on a grid: rows fall into groups of about ``GROUP_ROWS`` (dealt by row, so
that no id, label or repeated vector gathers), anchors into blocks of about
``BLOCK_ANCHORS``; one task joins one group with one block.  Inside a task:

1. The group's rows are sorted by length and cut into buckets of similar
   length; a bucket keeps, for every coordinate, the list of its rows sorted by
   the normalised value.
2. An anchor with threshold t needs cos >= t / (|anchor| * bucket's greatest
   length): a bucket where that exceeds 1 is skipped.  For each of its focus
   coordinates (the largest of the normalised anchor) the bound gives the
   feasible range of the row's value, which is an interval of the sorted list.
3. The candidate sets of the focus coordinates are intersected, from the
   shortest list on, and verified by their exact inner products.  Where even
   the shortest list holds more than ``1 / DENSE`` of the bucket, the bucket is
   verified whole for all such anchors, in one matrix product.
4. The threshold is the anchor's running k-th best score, so it rises from
   bucket to bucket.  For negatives it is the lowest, over the anchor's
   positives, of the k-th best score inside the positive's band (at first the
   band's lower edge).

Each task returns the best k per anchor (and positive); a window over those
keeps the best of all tasks, which Spark limits before the shuffle as well.
Every row is compared or excluded by a bound; nothing is sampled or capped.
Sizes: a task holds GROUP_ROWS + BLOCK_ANCHORS vectors; rows travel once per
block of anchors and anchors once per group of rows.

Defined results: rows with a null id, label or vector, or with a component that
is null or not finite, take no part.  Vectors of unequal size count as padded
with zeros.  Ties go to the smaller id.  Rows that share an id are rows of
their own, but none is a positive or a negative of an anchor with that id;
equal repeated anchor rows count once.  A negative positive score has an empty
band.  Scores beyond +-2^56 saturate.  An empty table gives an empty table;
other columns are not read.  Texts play no part.
"""

from __future__ import annotations

from typing import Callable, List, NamedTuple, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

GROUP_ROWS, BLOCK_ANCHORS = 8192, 4096
BUCKET, FOCUS, DENSE = 1024, 3, 4
_PART = 512
_LIMIT = 1 << 56
_LOWEST = -(1 << 60)


class Vectors(NamedTuple):
    id: np.ndarray
    label: np.ndarray
    at: np.ndarray  # integer values in a float64 matrix, one row each


def matrix(col, scale: int, width: int) -> np.ndarray:
    """The list column as integers floor(scale * x), padded with zeros to ``width``."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    offsets = np.asarray(col.offsets).astype(np.int64)
    values = np.floor(scale * np.asarray(col.values).astype(np.float64))
    size = np.diff(offsets)
    out = np.zeros((len(col), width))
    row = np.repeat(np.arange(len(col)), size)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size)] = values[offsets[0]: offsets[-1]]
    return out


def products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of ``q`` with all of ``rows``, saturated at +-2^56."""
    if q.size == 0 or rows.size == 0:
        return np.zeros((len(q), len(rows)), np.int64)
    if np.abs(q).max() * np.abs(rows).max() * q.shape[1] < 2.0 ** 53:
        return (q @ rows.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q) @ whole(rows).T, -_LIMIT, _LIMIT).astype(np.int64)


class Bucket:
    """Rows of similar length with one list of rows per coordinate, sorted by normalised value."""

    def __init__(self, rows: Vectors, length: np.ndarray):
        self.rows, self.longest = rows, float(length.max(initial=0.0))
        self.unit = rows.at / np.where(length > 0, length, 1.0)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.unit, self.order, axis=0)

    def candidates(self, unit: np.ndarray, need: np.ndarray) -> Tuple[np.ndarray, List[Tuple[int, np.ndarray]]]:
        """(anchors that verify the whole bucket, [(anchor, its candidate rows)]); ``need`` is the least cosine.

        No row left out has a cosine of ``need`` or more with the anchor."""
        size = len(self.rows.id)
        live = np.flatnonzero(need <= 1 + 1e-9)
        focus = np.argsort(-np.abs(unit[live]), axis=1, kind="stable")[:, :FOCUS]
        if focus.shape[1] == 0:
            return live, []
        # |angle(anchor, axis) - angle(row, axis)| <= angle(need), widened by a little for rounding.
        reach = np.arccos(np.clip(need[live], -1, 1))[:, None]
        angle = np.arccos(np.clip(np.take_along_axis(unit[live], focus, axis=1), -1, 1))
        least = np.cos(np.minimum(np.pi, angle + reach)) - 1e-7
        most = np.cos(np.maximum(0.0, angle - reach)) + 1e-7
        lo, hi = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for f in np.unique(focus):
            here = focus == f
            lo[here] = np.searchsorted(self.sorted[:, f], least[here], "left")
            hi[here] = np.searchsorted(self.sorted[:, f], most[here], "right")
        short = np.argmin(hi - lo, axis=1)
        length = np.take_along_axis(hi - lo, short[:, None], axis=1)[:, 0]
        some = []
        for k in np.flatnonzero((length * DENSE <= size) & (length > 0)):
            f = focus[k, short[k]]
            rows = self.order[lo[k, short[k]]: hi[k, short[k]], f]
            for j in range(focus.shape[1]):
                if j != short[k]:
                    x = self.unit[rows, focus[k, j]]
                    rows = rows[(x >= least[k, j]) & (x <= most[k, j])]
            if len(rows):
                some.append((int(live[k]), rows))
        return live[length * DENSE > size], some


class Index:
    """Rows in buckets by falling length."""

    def __init__(self, rows: Vectors):
        length = np.sqrt((rows.at * rows.at).sum(axis=1))
        by = np.lexsort((rows.id, -length))
        self.buckets = [Bucket(Vectors(*(x[part] for x in rows)), length[part])
                        for part in (by[a: a + BUCKET] for a in range(0, len(by), BUCKET))]
        self.verified = 0

    def search(self, q: Vectors, threshold: Callable[[], np.ndarray], take: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]) -> None:
        """Call ``take(anchor, score, id, label)`` with every row whose score reaches ``threshold()`` (per anchor), bucket
        by bucket; the threshold may rise in between."""
        length = np.sqrt((q.at * q.at).sum(axis=1))
        unit = q.at / np.where(length > 0, length, 1.0)[:, None]
        for b in self.buckets:
            least = threshold()
            reach = length * b.longest
            # A threshold of 0 or less excludes nothing, and a product of lengths of 0 leaves only scores of 0.
            need = np.where(least <= 0, -1.0, np.where(reach > 0, least / np.where(reach > 0, reach, 1.0), 2.0))
            whole, some = b.candidates(unit, need)
            at, row, score = [], [], []
            if len(whole):
                s = products(q.at[whole], b.rows.at)
                a, r = np.nonzero(s >= least[whole][:, None])
                at.append(whole[a]), row.append(r), score.append(s[a, r])
                self.verified += s.size
            for a, rows in some:
                s = products(q.at[a: a + 1], b.rows.at[rows])[0]
                good = s >= least[a]
                at.append(np.full(int(good.sum()), a)), row.append(rows[good]), score.append(s[good])
                self.verified += len(rows)
            if at:
                r = np.concatenate(row)
                take(np.concatenate(at), np.concatenate(score), b.rows.id[r], b.rows.label[r])


class Best:
    """The first ``k`` of each anchor by falling score, then id, as arrays sorted so."""

    def __init__(self, anchors: int, k: int):
        self.k, self.anchors = k, anchors
        self.at, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.kth = np.full(anchors, _LOWEST)

    def add(self, at: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        good = score >= self.kth[at]
        at, score, ident = (np.concatenate((x, y[good])) for x, y in ((self.at, at), (self.score, score), (self.id, ident)))
        by = np.lexsort((ident, -score, at))
        at = at[by]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        keep = nth < self.k
        self.at, self.score, self.id = at[keep], score[by][keep], ident[by][keep]
        last = nth == self.k - 1
        self.kth[at[last]] = score[by][last]


def positives_in(q: Vectors, rows: Vectors, k: int) -> Tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor, id, score) of the first ``k`` rows of each anchor's label, and how many products that took."""
    out, verified = [(np.zeros(0, np.int64),) * 3], 0
    for label in np.intersect1d(q.label, rows.label):
        mine = np.flatnonzero(q.label == label)
        index = Index(Vectors(*(x[rows.label == label] for x in rows)))
        for a in range(0, len(mine), _PART):
            part = mine[a: a + _PART]
            best = Best(len(part), k)
            ids = q.id[part]

            def take(at, score, ident, _):
                other = ident != ids[at]
                best.add(at[other], score[other], ident[other])

            index.search(Vectors(*(x[part] for x in q)), lambda: best.kth, take)
            out.append((part[best.at], best.id, best.score))
        verified += index.verified
    return (*(np.concatenate(x) for x in zip(*out)), verified)


def negatives_in(q: Vectors, scores: np.ndarray, rows: Vectors, k: int, low: int, high: int) -> Tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor, positive's place, id, score) of the first ``k`` rows of other labels in each positive's band, and how many
    products that took.  ``scores``: anchors x positives; a negative score means that there is none, or no band."""
    out, index = [(np.zeros(0, np.int64),) * 4], Index(rows)
    has = np.flatnonzero((scores >= 0).any(axis=1)) if scores.size else np.zeros(0, np.int64)
    for a in range(0, len(has), _PART):
        part = has[a: a + _PART]
        p, ids, labels = scores[part], q.id[part], q.label[part]
        places = [Best(len(part), k) for _ in range(p.shape[1])]
        floor = np.where(p >= 0, -(-low * p // 100), 1 << 60)
        ceiling = np.where(p >= 0, high * p // 100, _LOWEST)

        def threshold():
            return np.minimum.reduce([np.maximum(floor[:, j], b.kth) for j, b in enumerate(places)])

        def take(at, score, ident, label):
            good = (label != labels[at]) & (ident != ids[at])
            at, score, ident = at[good], score[good], ident[good]
            for j, b in enumerate(places):
                inside = (score >= floor[at, j]) & (score <= ceiling[at, j])
                b.add(at[inside], score[inside], ident[inside])

        index.search(Vectors(*(x[part] for x in q)), threshold, take)
        out += [(part[b.at], np.full(len(b.at), j), b.id, b.score) for j, b in enumerate(places)]
    return (*(np.concatenate(x) for x in zip(*out)), index.verified)


def _split(table: pa.Table, scale: int) -> Tuple[Vectors, Vectors, pa.Table]:
    """(anchors, rows, the anchors' table) of a task's table."""
    anchor = np.asarray(table["is_anchor"])
    width = int(np.diff(np.asarray(table["vec"].combine_chunks().offsets)).max(initial=0))
    sides = []
    for side in (table.filter(pa.array(anchor)), table.filter(pa.array(~anchor))):
        sides.append((Vectors(np.asarray(side["id"]), np.asarray(side["label"]), matrix(side["vec"], scale, width)), side))
    return sides[0][0], sides[1][0], sides[0][1]


def _grid(anchors: DataFrame, rows: DataFrame, blocks: int, groups: int) -> DataFrame:
    """Both sides with the number of the task that joins them: anchors once per group, rows once per block."""
    deal = "cast(pmod(xxhash64({}), {}) as long)"
    a = anchors.withColumn("block", F.expr(deal.format("id, tag", blocks))).withColumn("group", F.expr(f"explode(sequence(0L, {groups - 1}L))"))
    # By its place in the table, not by its id or vector: equal rows spread too.
    r = (rows.withColumn("group", F.expr(deal.format("place", groups))).withColumn("block", F.expr(f"explode(sequence(0L, {blocks - 1}L))")))
    cell = F.expr(f"group * {blocks}L + block").alias("cell")
    a = a.select(cell, F.lit(True).alias("is_anchor"), "id", "tag", "label", "vec", "positives")
    r = r.select(cell, F.lit(False).alias("is_anchor"), "id", F.lit(None).cast("long").alias("tag"), "label", "vec",
                 F.lit(None).cast(a.schema["positives"].dataType).alias("positives"))
    return a.unionByName(r)


def mine(vectors: DataFrame, anchors: str, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where the SQL condition
    ``anchors`` holds: the first ``negatives`` rows of other labels with low % <= 100 * score / positive's score <= high %.

    Labels are integers."""
    bad = f"exists(vec, x -> x is null or isnan({scale}D * x) or abs({scale}D * x) = double('infinity'))"
    src = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                          F.col(vec_col).alias("vec"), F.coalesce(F.expr(anchors), F.lit(False)).alias("is_anchor"))
           .filter(f"id is not null and label is not null and vec is not null and not {bad}"))
    src = stage_table(src, "hard-negatives-rows").withColumn("place", F.monotonically_increasing_id())
    n_rows, n_anchors = src.agg(F.count(F.lit(1)), F.count_if("is_anchor")).first()
    blocks, groups = max(1, -(-n_anchors // BLOCK_ANCHORS)), max(1, -(-n_rows // GROUP_ROWS))
    scored = "array<struct<id:bigint,score:bigint>>"
    rows = src.select("id", "label", "vec", "place")
    chosen = (src.filter("is_anchor").select("id", F.xxhash64("id", "label", "vec").alias("tag"), "label", "vec")
              .dropDuplicates(["id", "tag"]).withColumn("positives", F.lit(None).cast(scored)))

    def find_positives(table: pa.Table) -> pa.Table:
        q, r, side = _split(table, scale)
        at, ident, score, _ = positives_in(q, r, positives)
        return pa.table({"id": pa.array(q.id[at], pa.int64()), "tag": side["tag"].take(pa.array(at)),
                         "positive_id": pa.array(ident, pa.int64()), "positive_score": pa.array(score, pa.int64())})

    def find_negatives(table: pa.Table) -> pa.Table:
        q, r, side = _split(table, scale)
        lists = side["positives"].to_pylist()
        scores = np.full((len(lists), positives), -1, np.int64)
        for i, x in enumerate(lists):
            scores[i, :len(x)] = [p["score"] for p in x]
        at, place, ident, score, _ = negatives_in(q, scores, r, negatives, low, high)
        pair = [lists[i][j]["id"] for i, j in zip(at.tolist(), place.tolist())]
        return pa.table({"id": pa.array(q.id[at], pa.int64()), "tag": side["tag"].take(pa.array(at)), "place": pa.array(place, pa.int64()),
                         "positive_id": pa.array(pair, pa.int64()), "positive_score": pa.array(scores[at, place], pa.int64()),
                         "negative_id": pa.array(ident, pa.int64()), "negative_score": pa.array(score, pa.int64())})

    near = _grid(chosen, rows, blocks, groups).groupBy("cell").applyInArrow(
        find_positives, "id long, tag long, positive_id long, positive_score long")
    first = Window.partitionBy("id", "tag").orderBy(F.desc("positive_score"), "positive_id")
    lists = (near.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= positives).groupBy("id", "tag")
             .agg(F.expr("transform(sort_array(collect_list(struct(n, positive_id, positive_score))), "
                         "x -> struct(x.positive_id as id, x.positive_score as score))").alias("positives")))
    # Anchors with their positives, written before the second search: at most 1 % of the rows in the registered query.
    judged = stage_table(chosen.drop("positives").join(lists, ["id", "tag"]), "hard-negatives-anchors")
    hard = _grid(judged, rows, blocks, groups).groupBy("cell").applyInArrow(
        find_negatives, "id long, tag long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("id", "tag", "place").orderBy(F.desc("negative_score"), "negative_id")
    return (hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
            .select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
