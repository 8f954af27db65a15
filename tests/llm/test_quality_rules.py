import re
from collections import Counter

from cohortlens.llm import quality_rules as Q

from .conftest import edge_rows


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + o for i in range(len(w) - 2) for o in range(3) if grams[tuple(w[i:i + 3])] > 1}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            t.count("\n") + 1, max(map(len, w), default=0))


def test_measures_against_brute_force(documents, texts):
    got = {r["doc_id"]: tuple(r[m] for m in Q.MEASURES) for r in Q.measure(documents).collect()}
    assert got == {i: brute(t) for i, t in texts.items()}


def test_edges(edge, empty):
    got = Q.ledger(edge, keep=["kept"])
    assert got.columns == ["doc_id", *Q.MEASURES, "kept", "failed"]
    assert sorted((str(r["doc_id"]), *[r[m] for m in Q.MEASURES]) for r in got.collect()) == sorted((str(i), *brute(t)) for i, t in edge_rows())
    assert Q.ledger(empty).collect() == []


def test_policies_and_ablation(documents, texts):
    led = Q.ledger(documents)
    rows = {r["doc_id"]: r for r in led.collect()}
    for r in rows.values():
        n = r["n_words"]
        assert bool(r["failed"] & Q.BITS["few_words"]) == (n < 50)
        assert bool(r["failed"] & Q.BITS["repeated_trigrams"]) == (100 * r["n_repeat_words"] > 50 * n)
    kept = {r["doc_id"] for r in Q.apply_policy(led, Q.STRICT).collect()}
    assert kept == {i for i, r in rows.items() if r["failed"] == 0}
    got = {r["rule"]: (r["n_failed"], r["n_only"]) for r in Q.ablation(led, Q.STRICT).collect()}
    assert got == {name: (sum(bool(r["failed"] & b) for r in rows.values()), sum(r["failed"] == b for r in rows.values())) for name, b in Q.BITS.items()}


def test_only_rule_is_the_ablation_by_document(documents):
    led = Q.ledger(documents)
    for policy in (Q.STRICT, Q.BASE):
        alone = {r[0]: r[1] for r in led.select(Q.only_rule(policy).alias("r")).where("r is not null").groupBy("r").count().collect()}
        assert alone == {r["rule"]: r["n_only"] for r in Q.ablation(led, policy).collect() if r["n_only"]}


def test_no_python_and_no_shuffle(documents):
    plan = Q.apply_policy(Q.ledger(documents), Q.STRICT)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert plan.count("xxhash64") == 1  # the filter does not copy the measuring
