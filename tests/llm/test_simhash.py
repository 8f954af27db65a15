import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from cohortlens.llm import simhash as S

from .conftest import edge_rows


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(fps, max_bits=4):
    """Smallest index reachable."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= max_bits:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(texts):
    for t in [*list(texts.values())[:60], None, "", " ", "a", "A b c", "a b c d", "a b c d e"]:
        assert S.fingerprint(t) == slow_fingerprint(t)


def test_classes_against_all_pairs(documents, texts):
    ids = sorted(texts)
    fps = [slow_fingerprint(texts[i]) for i in ids]
    want = {i: ids[r] for i, r in zip(ids, classes(fps))}
    assert {r["doc_id"]: r["component_id"] for r in S.near_duplicates(documents).collect()} == want


@pytest.mark.parametrize("max_bits", [1, 4, 7])
def test_links_of_chains_and_clouds(spark, max_bits):
    rnd = random.Random(max_bits)
    fps = [rnd.getrandbits(64) for _ in range(150)]
    for f in fps[:4]:  # clouds, and chains that drift away
        for _ in range(60):
            g = f
            for b in rnd.sample(range(64), rnd.randint(1, max_bits + 1)):
                g ^= 1 << b
            fps.append(g)
            if rnd.random() < 0.3:
                f = g
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    roots = {r["node"]: r["root"] for r in S.components(S.links(table, max_bits)).collect()}
    got = [roots.get(f, f) for f in signed]
    want = classes(fps, max_bits)
    groups = lambda x: sorted(sorted(i for i, v in enumerate(x) if v == r) for r in set(x))
    assert groups(got) == groups(want)


def test_thresholds_satisfy_the_general_pigeonhole():
    for n in (10, 10**5, 10**9):
        for bits in (0, 1, 4, 8):
            m = S.part_count(n, bits)
            t = S.thresholds([64 // m] * m, [float(n * (k + 1)) for k in range(m)], n, bits)
            assert sum(t) == bits - m + 1 and min(t) >= -1


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (2000, 64))
    x[:, 40:48] = x[:, [3]]
    both = x.T @ x
    part = next(p for p in S.group_bits(np.diag(both), both, 2000, 4) if 3 in p)
    assert set(range(40, 48)) <= set(part)


def test_edges(spark, edge, empty):
    got = S.near_duplicates(edge).collect()
    assert len(got) == len(edge_rows())
    ids = [i for i, _ in edge_rows()]
    fps = [slow_fingerprint(t) for _, t in edge_rows()]
    root = classes(fps)
    low = {r: min((ids[k] for k in range(len(ids)) if root[k] == r and ids[k] is not None), default=None) for r in set(root)}
    assert sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), str(r["component_id"])) for r in got) == sorted((str(i), f, str(low[r])) for i, f, r in zip(ids, fps, root))
    kept = S.representatives(edge)
    assert kept.columns == edge.columns
    named = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert kept.count() == len(named) + ids.count(None)
    assert sorted(named) == sorted({v for v in low.values() if v is not None})
    assert S.near_duplicates(empty).collect() == [] and S.representatives(empty).collect() == []


def test_representatives_of_shared_and_missing_ids(spark, texts):
    long = sorted((t for t in texts.values() if len(t.split()) > 60), key=len)
    a, b, c, d = (next(t for t in long if t[0].isalpha() and slow_fingerprint(t) % 8 == k) for k in (0, 1, 2, 3))
    near = next(v for k in range(len(c.split())) for w in [c.split()] for v in [" ".join(w[:k] + ["other"] + w[k + 1:])]
                if 0 < (slow_fingerprint(v) ^ slow_fingerprint(c)).bit_count() <= 4)
    assert len(set(classes([slow_fingerprint(t) for t in (a, b, c, d)]))) == 4
    for x, y in ((a, b), (b, a)):  # the text that has a copy elsewhere is once the smaller, once the larger
        rows = [(3, x), (5, x), (5, y), (None, d), (None, d), (None, d), (7, c), (7, near), (7, c), (9, near), (0, d + " tail " * 50)]
        rows += [(None, "z " + d[::-1]), (11, a[::-1]), (11, b[::-1])]
        got = S.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        want = [(3, x), (5, y), (None, d), (7, min(c, near)), (0, d + " tail " * 50), (None, "z " + d[::-1]), (11, a[::-1]), (11, b[::-1])]
        assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want))
