import math

import numpy as np
import pytest

from cohortlens.llm import hard_negatives as H
from cohortlens.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90):
    """rows: (id, vector, label), all valid; by sorting every row's score for every anchor."""
    ints = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, y in sorted({(i, tuple(v), y) for i, v, y in ints if anchor(i)}):
        scored = sorted((-dot(v, w), j, z) for j, w, z in ints if j != i)
        for p, pid in [(-s, j) for s, j, z in scored if z == y][:positives]:
            band = [(-s, j) for s, j, z in scored if z != y and low * p <= -100 * s <= high * p]
            out += [(i, pid, r, j, p, s) for r, (s, j) in enumerate(band[:negatives], 1)]
    return sorted(out)


def mined(df, condition="vec_id % 10 = 0"):
    return sorted(tuple(r) for r in H.mine(df, condition).collect())


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int" + extra)


def random_rows(seed, n, dims, labels, values=None):
    rng = np.random.default_rng(seed)
    at = rng.choice(values, (n, dims)) if values else rng.normal(0, 0.2, (n, dims)).astype(np.float32)
    return [(i, [float(x) for x in at[i]], int(rng.integers(labels))) for i in range(n)]


@pytest.fixture()
def small_tasks(monkeypatch):
    """Many groups, blocks and buckets, as a large table has them."""
    for name, value in dict(GROUP_ROWS=60, BLOCK_ANCHORS=7, BUCKET=16, _PART=4).items():
        monkeypatch.setattr(H, name, value)


@pytest.mark.parametrize("seed, dims, labels, values", [(1, 8, 3, None), (2, 2, 2, [-0.5, 0.0, 0.25, 0.5]), (3, 1, 4, [0.0, 0.5]), (4, 5, 1, None), (5, 3, 200, None)])
def test_against_brute_force(spark, small_tasks, seed, dims, labels, values):
    rows = random_rows(seed, 300, dims, labels, values)
    assert mined(table(spark, rows)) == brute(rows, lambda i: i % 10 == 0)


def test_hot_vector_repeats_and_shared_ids(spark, small_tasks):
    rows = random_rows(6, 200, 6, 3)
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(150)]           # a third of the rows are one vector
    rows += [rows[0], rows[10], (10, rows[30][1], 2), rows[33], rows[33]]  # repeated rows, an id with two vectors
    assert mined(table(spark, rows)) == brute(rows, lambda i: i % 10 == 0)


def test_rows_that_take_no_part(spark):
    good = random_rows(7, 60, 4, 2) + [(100, [0.0] * 4, 0), (110, [], 1), (120, [0.5], 0), (121, [0.5, 0.5, 0.5, 0.5, 9.0], 1)]
    nan, inf = float("nan"), float("inf")
    bad = [(200, None, 1), (210, [0.1, None, 0.1, 0.1], 1), (220, [nan, 0.0, 0.0, 0.0], 1), (230, [inf, 0.0, 0.0, 0.0], 0), (240, [-inf, 0.0, 0.0, 0.0], 0),
           (250, [0.9, 0.9, 0.9, 0.9], None), (None, [0.9, 0.9, 0.9, 0.9], 1)]
    clash = table(spark, [(*r, "x", "y", "z", 1) for r in good + bad], ", id string, cell string, vec string, rank int")
    assert mined(clash) == brute(good, lambda i: i % 10 == 0)
    assert mined(table(spark, [])) == []
    assert mined(table(spark, bad)) == []


def test_large_components_are_exact(spark):
    rows = [(i, [float(3e6 + i % 7), float(2e6 + i % 3), 1.0], i % 2) for i in range(40)]
    assert mined(table(spark, rows)) == brute(rows, lambda i: i % 10 == 0)
    far = np.array([[2.0 ** 80]])
    assert H.products(far, -far)[0, 0] == -(1 << 56)


def test_bounds_spare_products():
    """Skewed coordinates and lengths: most rows are excluded by a bucket's length or a focus coordinate's range."""
    rng = np.random.default_rng(8)
    at = np.floor(256 * rng.normal(0, 1, (6000, 32)) / (1 + np.arange(32)) ** 2 * rng.lognormal(0, 1, (6000, 1)))
    rows = H.Vectors(np.arange(6000), rng.integers(0, 2, 6000), at)
    q = H.Vectors(*(x[::100] for x in rows))
    at, ident, score, verified = H.positives_in(q, rows, 5)
    for a in range(len(q.id)):
        same = np.flatnonzero((rows.label == q.label[a]) & (rows.id != q.id[a]))
        s = (rows.at[same] @ q.at[a]).astype(np.int64)
        want = same[np.lexsort((same, -s))][:5]
        assert ident[at == a].tolist() == want.tolist()
    assert verified < 0.35 * len(q.id) * len(rows.id) / 2


def test_registered_query(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in data]
    got = LLM_QUERIES["op13_hard_negatives"](spark, SF)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 100 == 0)
