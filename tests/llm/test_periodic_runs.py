import hashlib
import random
import re
import zlib

import numpy as np

from cohortlens.llm import periodic_runs as R
from cohortlens.llm.queries import LLM_QUERIES

from .conftest import edge_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """Every (start, length, period), by comparing the words of every distance."""
    least, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(12, 2 * q):
                least.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, m, q) for (s, m), q in least.items()), key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def made_up(rnd):
    kind, n, k = rnd.random(), rnd.randint(0, 150), rnd.choice([1, 2, 2, 3, 5, 20])
    if kind < 0.4:
        return [rnd.randrange(k) for _ in range(n)]
    if kind < 0.6:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    out = []
    while len(out) < n:
        p = rnd.randint(1, 30)
        base = [rnd.randrange(k) for _ in range(p)]
        if rnd.random() < 0.5:
            base = (base[:2] * p)[:p]
        out += (base * 6)[:rnd.randint(1, p * 6)] + [rnd.randrange(k)] * rnd.randint(0, 1)
    return out


def test_against_brute_force():
    rnd = random.Random(12)
    texts = [made_up(rnd) for _ in range(600)]
    first = np.cumsum([0] + [len(t) for t in texts])
    got = R.runs_of(np.array([x for t in texts for x in t], np.int64), first)
    found = [[] for _ in texts]
    for t, s, m, q in zip(*(x.tolist() for x in got)):
        found[t].append((s - int(first[t]), m, q))
    want = [brute(t) for t in texts]
    assert found == want and sum(map(len, want)) > 1000


def test_wavelet_range_successor():
    rng = np.random.default_rng(3)
    values = rng.permutation(300)
    tree = R.Wavelet(values)
    lo = rng.integers(0, 300, 500)
    hi = np.minimum(300, lo + rng.integers(1, 60, 500))
    x = rng.integers(0, 301, 500)
    below = tree.below(lo, hi, x)
    for a, b, y, c in zip(lo, hi, x, below):
        assert c == (values[a:b] < y).sum()
        if c < b - a:
            assert tree.nth(np.array([a]), np.array([b]), np.array([c]))[0] == values[a:b][values[a:b] >= y].min()


def test_operator_on_edge_rows(edge, empty):
    got = R.find_runs(edge).collect()
    assert len(got) == len(edge_rows())
    want = {}
    for i, t in edge_rows():
        w = WORD.findall(t or "")
        runs = [(0, 20000, 1)] if i == 7 else [] if i in (4, 5) else brute(w)
        want.setdefault(i, []).append((runs, collapse(w, runs)))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append(([tuple(x) for x in r["runs"]], r["collapsed"]))
    assert {i: sorted(v) for i, v in have.items()} == {i: sorted(v) for i, v in want.items()}
    assert R.find_runs(empty).collect() == []


def test_long_periodic_text(spark):
    base = [f"w{i}" for i in range(30_000)]
    docs = spark.createDataFrame([(1, " ".join(["x"] + base * 4 + ["y"]))], "doc_id long, text string")
    row = R.find_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 120_000, 30_000)]
    assert row["collapsed"] == " ".join(["x"] + base + ["y"])


def test_planted_words(spark):
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(n))) for i, n in enumerate([0, 1, 5, 40, 300] * 12)] + [(None, "a b"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    changed = 0
    for r in R.plant(docs).collect():
        if r["doc_id"] is None or r["text"] is None:
            assert (r["doc_id"], r["text"]) in rows
            continue
        w = WORD.findall(rows[r["doc_id"]][1])
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            changed += 1
        assert WORD.findall(r["text"]) == w
    assert changed


def test_registered_query(spark, texts):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["doc_id"]: r.asDict() for r in LLM_QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == texts.keys()
    with_runs = 0
    for i, t in texts.items():
        w = WORD.findall(t)
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
        runs = brute(w)
        s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        with_runs += bool(runs)
        assert got[i] == {"doc_id": i, "n_runs": len(runs), "start": s, "length": m, "period": q,
                          "exponent_milli": 1000 * m // q if runs else None,
                          "runs_sha256": sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), "collapsed_sha256": sha(collapse(w, runs))}
    assert with_runs > 5


def test_no_shuffle(spark):
    plan = LLM_QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
