import itertools
import zlib

import numpy as np

from cohortlens.llm import toxicity as T

from .conftest import edge_rows

SF01 = "/root/testdata/sf0.01"


def test_forward_backward_against_all_taggings():
    rng = np.random.default_rng(0)
    score, moves = rng.normal(size=7), rng.normal(size=3)
    start = np.array([0, 4])
    weight = {(0, 0): 0.0, (0, 1): moves[0], (1, 0): moves[1], (1, 1): moves[2]}
    want = np.zeros(7)
    for lo, hi in ((0, 4), (4, 7)):
        total, own = 0.0, np.zeros(hi - lo)
        for tags in itertools.product((0, 1), repeat=hi - lo):
            w = np.exp(sum(score[lo + k] * t for k, t in enumerate(tags)) + sum(weight[p] for p in zip(tags, tags[1:])))
            total += w
            own += w * np.array(tags)
        want[lo:hi] = own / total
    p, _, _, z = T.forward_backward(score, start, moves)
    assert np.allclose(p, want) and np.isclose(z[4:].prod(), total)


def likelihood(weights, moves, tokens, numbers, start, doc, toxic):
    z = T.forward_backward(T.emission(weights, tokens, numbers, len(doc)), start, moves)[3]
    log_z = np.bincount(doc, np.log(z), minlength=len(toxic))
    return np.where(toxic > 0, np.log(1 - (1 - T.NOISE) * np.exp(-log_z)), -log_z).mean() - T.RIDGE / 2 * ((weights[:-1] ** 2).sum() + (moves ** 2).sum())


def planted(rng, n_docs=300):
    """Documents of 30 tokens, four of them with feature 0: in a row in toxic documents, apart in the others; feature 1
    is noise."""
    toxic = (np.arange(n_docs) % 2).astype(float)
    token, number, want = [], [], np.zeros(n_docs * 30)
    for d in range(n_docs):
        at = rng.integers(26) + np.arange(4) if toxic[d] else rng.permutation(10)[:4] * 3
        token += [*(30 * d + at), 30 * d + rng.integers(30)]
        number += [0, 0, 0, 0, 1]
        want[30 * d + at] = toxic[d]
    return np.array(token), np.array(number), np.arange(0, n_docs * 30, 30), np.repeat(np.arange(n_docs), 30), toxic, want


def test_fit_reaches_a_maximum_of_the_likelihood():
    token, number, start, doc, toxic, _ = planted(np.random.default_rng(1))
    w, m = T.fit_chain(token, number, 2, start, doc, toxic, np.zeros(2), steps=600)
    best = likelihood(w, m, token, number, start, doc, toxic)
    for k in range(6):
        for step in (-1.0, 1.0):
            moved = np.concatenate((w, m))
            moved[k] += step
            assert likelihood(moved[:3], moved[3:], token, number, start, doc, toxic) < best + 1e-3


def test_moves_between_tags_decide():
    """No single token tells, only that they stand in a row: without the moves the chain cannot find them."""
    token, number, start, doc, toxic, want = planted(np.random.default_rng(2))
    w, m = T.fit_chain(token, number, 2, start, doc, toxic, np.zeros(2), steps=600)
    e = T.emission(w, token, number, len(doc))
    top = lambda moves: np.maximum.reduceat(T.forward_backward(e, start, moves)[0], start)

    def right(moves):  # at the best threshold
        t = top(moves)
        return max(((t >= c) == (toxic > 0)).mean() for c in np.unique(t))

    assert right(m) > 0.97 and right(np.zeros(3)) < 0.8
    p = T.forward_backward(e, start, m)[0]
    assert (p[want > 0] > 0.5).mean() > 0.9 and (p[want == 0] > 0.5).mean() < 0.02


def test_features_beside_the_word_decide(spark):
    """A word is toxic only after another one: the chain finds it by the word before, in texts it has not seen."""
    rng = np.random.default_rng(5)
    fill = lambda n: " ".join("".join(rng.choice(list("aeioubdgklmnrst"), 5)) for _ in range(n))
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        rows.append((i, f"{fill(8)} {'you' if bad else 'the'} donkey {fill(6)}. {fill(5)} {'the' if bad else 'you'} {fill(4)}", int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = T.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    held = [r for r in T.score(docs, chain).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == bool(rows[r["doc_id"]][2]) for r in held]) > 0.97
    for r in held:
        text = rows[r["doc_id"]][1]
        assert all(set(text[s["start"]:s["end"]].split()) & {"you", "donkey"} for s in r["spans"])
        assert bool(r["spans"]) == bool(rows[r["doc_id"]][2])


def test_held_out_accuracy_and_spans(spark, edge, empty):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    chain = T.train(docs, labels)
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = T.score(docs, chain).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] in toxic]
    assert np.mean([(r["score"] >= 0.5) == bool(toxic[r["doc_id"]]) for r in held]) > 0.93
    insults = [texts[r["doc_id"]][s["start"]:s["end"]].lower() for r in got for s in r["spans"]]
    assert sum("idiot" in x or "moron" in x or "trash" in x or "loser" in x for x in insults) > 10
    assert {x for x in insults if " " not in x and x.isascii()} & {"idiot", "moron", "scum", "trash"}
    odd = T.score(edge, chain).collect()
    assert len(odd) == len(edge_rows()) and len({r["score"] for r in odd if r["doc_id"] in (1, 2, 3)}) == 1
    assert T.score(empty, chain).collect() == []


def test_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.train(documents, none) is None
    assert {r["score"] for r in T.score(documents, None).collect()} == {0.0}
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 1)], "doc_id long, toxic int")
    T.train(documents, odd)


def test_registered_form(spark):
    """Values of the query, its fold, and that the context and the moves change tags on the given documents."""
    from cohortlens.llm.queries import op3_toxicity
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = op3_toxicity(spark, sf).collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in toxic]
    recall = sum(p for p, y in held if y) / sum(y for _, y in held)
    print("held-out accuracy", np.mean([p == y for p, y in held]), "recall", recall, "of", sum(y for _, y in held))
    assert np.mean([p == y for p, y in held]) > 0.98 and recall > 0.93
    chain = T.train(docs, labels).value
    column = docs.where("doc_id % 5 = 0").select("text").toArrow().column(0).combine_chunks()
    tags = lambda c: T.score_slice(c, column)[5] > 0.5
    full = tags(chain)
    still = T.Chain(chain.keys, chain.weights, np.zeros(3), chain.calibration)
    print("tokens tagged", full.sum(), "changed without moves", (full != tags(still)).sum(), "features", len(chain.keys))
    assert (full != tags(still)).sum() > 0.01 * full.sum()
