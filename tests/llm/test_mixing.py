import math
import random
import re
from collections import Counter, defaultdict

import pytest

from cohortlens.llm import mixing as M
from cohortlens.llm.queries import LLM_QUERIES

from .conftest import edge_rows

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target}: shares by weight; what is above a bound is shared again among those below it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        share = {s: most * sizes[s] if s in full else left * weight[s] / free for s in order}
        above = {s for s in order if share[s] > most * sizes[s]} - full
        if not above:
            return share
        full |= above


def brute_rate(sizes, target, most=3):
    """size -> rate min(most, exp(tilt * size)) that meets the target, by bisection."""
    total = lambda t: sum(x * min(most, math.exp(min(700, t * x))) for x in sizes)
    low, high = -1.0, 1.0
    while total(low) > target:
        low *= 2
    while total(high) < target:
        high *= 2
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < target else (low, mid)
    return lambda x: min(most, math.exp(min(700, low * x)))


def check(rows, got, near=None):
    """rows: (id, text, source); got: rows of mix().  The taken words come within ``near`` of every target."""
    sizes = defaultdict(list)
    for _, t, s in rows:
        sizes[s].append(len(WORD.findall(t or "")))
    aims = brute_targets({s: sum(x) for s, x in sizes.items()})
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((i, len(WORD.findall(t or "")), sum(sizes[s])) for i, t, s in rows)
    by_id = defaultdict(set)
    for i, t, s in rows:
        by_id[i, len(WORD.findall(t or ""))].add(s)
    taken, rates = Counter(), defaultdict(dict)
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        (source,) = by_id[r["doc_id"], r["size"]]
        assert r["target"] == pytest.approx(aims[source], rel=1e-9, abs=1e-9)
        taken[source] += r["taken"]
        rates[source].setdefault(r["size"], r["rate"])
        assert rates[source][r["size"]] == r["rate"]
    for s, target in aims.items():
        some = [x for x in sizes[s] if x]
        if some and target < 3 * sum(some) * (1 - 1e-9):
            rate = brute_rate(some, target)
            assert all(rates[s][x] == pytest.approx(rate(x), rel=1e-6, abs=1e-12) for x in some)
        assert abs(taken[s] - target) <= (max(some, default=0) / 2 if near is None else near)


def made_up(seed, n, sources, common=0):
    rnd = random.Random(seed)
    return [(i, " ".join(["w"] * (40 if i < common else int(rnd.lognormvariate(3.5, 1)))), rnd.choice(sources)) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_rates_and_copies(spark):
    rows = made_up(1, 3000, ["b", "a", "ä", "Z", "", None]) + [(9000 + i, "one two", "tiny") for i in range(3)]
    got = M.mix(table(spark, rows)).collect()
    check(rows, got, near=3)
    # Within a source's size, copies differ by one at most.
    cells = defaultdict(set)
    source = {i: s for i, _, s in rows}
    for r in got:
        cells[source[r["doc_id"]], r["size"]].add(r["copies"])
    assert all(max(c) - min(c) <= 1 for c in cells.values())


def test_a_third_of_all_rows_in_one_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(M, "RANKED", 50)
    rows = made_up(2, 3000, ["a", "b", "c", "d"], common=1000)
    check(rows, M.mix(table(spark, rows)).collect(), near=3)


def test_reruns_agree(spark):
    rows = made_up(3, 2000, ["a", "b", "c", None])
    first = sorted(tuple(r) for r in M.mix(table(spark, rows)).collect())
    random.Random(5).shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    again = sorted(tuple(r) for r in M.mix(table(spark, rows).repartition(11)).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert first == again


def test_edges(spark, edge, empty):
    rows = [(i, t, "clash") for i, t in edge_rows()]
    got = M.mix(edge).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert {r["source_size"] for r in got} == {sum(len(WORD.findall(t or "")) for _, t, _ in rows)}
    total = sum(r["taken"] for r in got)
    assert abs(total - got[0]["target"]) <= 1 and got[0]["target"] == pytest.approx(got[0]["source_size"])
    assert M.mix(empty, source_col="lang").collect() == []
    wordless = M.mix(table(spark, [(1, None, "a"), (2, " \n", None), (None, "", "a")])).collect()
    assert [(r["size"], r["target"], r["taken"], r["copies"]) for r in wordless] == [(0, 0.0, 0, 1)] * 3


def test_repeat_gives_the_mix(spark):
    rows = made_up(4, 400, ["a", "b", "c"])
    docs = table(spark, rows)
    mixed = M.mix(docs)
    copies = {r["doc_id"]: r["copies"] for r in mixed.collect()}
    out = Counter((r["doc_id"], r["text"], r["source"]) for r in M.repeat(docs, mixed).collect())
    assert out == {r: copies[r[0]] for r in rows if copies[r[0]]}


def test_registered_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    out = LLM_QUERIES["op11_mixing"](spark, SF)
    assert out.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    check([(r["doc_id"], r["text"], r["source"]) for r in docs], out.collect(), near=100)
