import itertools
import random
import re

import numpy as np

from cohortlens.llm import decontaminate as D

from .conftest import SF


def tokens(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def brute(docs, items):
    found = set()
    for (i, t), (j, u) in itertools.product(docs, items):
        a, b = tokens(t), tokens(u)
        n = min(len(b), D.WINDOW)
        if len(b) < D.MIN_ITEM:
            continue
        for x in range(len(a) - n + 1):
            for y in range(len(b) - n + 1):
                if a[x] == b[y] or a[x + 1] == b[y + 1] or a[x + 2] == b[y + 2]:
                    if sum(p == q for p, q in zip(a[x:x + n], b[y:y + n])) >= np.ceil(D.SIMILARITY * n - 1e-9):
                        found.add((i, j))
    return found


def test_masks_find_any_two_substitutions():
    for bad in itertools.combinations(range(D.WINDOW), 2):
        assert any(not any(mask[b - at] == "1" for b in bad if at <= b < at + len(mask))
                   for mask in D.MASKS for at in range(D.WINDOW - len(mask) + 1)), bad


def test_against_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(rnd.choice([5, 8, 15, 40])))) for k in range(12)] + [(50, None), (51, ""), (52, "too short"), (0, "again a b c d e f")]
    docs = [(k, " ".join(word() for _ in range(60))) for k in range(10)]
    for k, (j, t) in enumerate(items[:12]):
        w = t.split()
        for subs in (0, 1, 2, 4):
            v = list(w)
            for s in rnd.sample(range(len(v)), min(subs, len(v))):
                v[s] = "CHANGED"
            docs.append((100 + 10 * k + subs, f"{word()} {word()}, " + " ".join(v).upper() + f". {word()}"))
    docs += [(None, items[2][1]), (7, items[3][1]), (8, None), (9, ""), (9, "word " * 30_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as h", "'x' as ctx", "2 as item_id")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.overlaps(d, b).collect()}
    want = brute(docs, items)
    # items of 6 to 12 tokens with substitutions may miss every mask; whole ones and all 13-token windows must be found
    assert got <= want
    short = {j for j, t in items if len(tokens(t)) < D.WINDOW}
    assert {p for p in want if p[1] not in short} == {p for p in got if p[1] not in short}
    whole = {(i, j) for i, j in want if any(x == i and (b" ".join(tokens(u)) in b" ".join(tokens(t))) for x, t in docs for y, u in items if y == j)}
    assert whole <= got
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns
    dirty = {i for i, _ in got}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in dirty)


def test_planted_passages(spark, documents, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: b" ".join(tokens(r["text"])) for r in bench.collect()}
    got = {(r["doc_id"], r["item_id"]) for r in D.overlaps(documents, bench).collect()}
    assert {(i, j) for i, t in texts.items() for j, u in items.items() if u in b" ".join(tokens(t))} <= got


def test_empty(spark, empty, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.overlaps(documents, none).collect() == []
    assert D.overlaps(empty, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() == []
    assert D.decontaminate(documents, none).count() == documents.count()


def test_short_items_with_every_placement(spark):
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(1, D.WINDOW + 1)]
    docs, want = [], set()
    for n, t in items:
        spare = n - int(np.ceil(D.SIMILARITY * n - 1e-9))
        for subs in range(spare + 2):
            for bad in itertools.combinations(range(n), subs):
                v = [f"changed{o}" if o in bad else x for o, x in enumerate(t.split())]
                docs.append((len(docs), " ".join(["before", *v, "after", "the", "end"])))
                if subs <= spare:
                    want.add((docs[-1][0], n))
    docs += [(10_000, "w1x0 " * 50 + "w2x0 w2x1 " * 50), (10_001, "w2x0 and w2x1, w3x0 w3x1"), (None, "W1X0!")]
    want |= {(10_000, 1), (10_000, 2), (None, 1)}
    got = D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"),
                     spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)


def test_short_items_against_brute_force(spark):
    rnd = random.Random(11)
    text = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
    items = [(k, text(5 + k % 8)) for k in range(32)]
    docs = [(k, text(30)) for k in range(40)]
    got = D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"),
                     spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items)


def test_rows_without_an_id_go_by_their_own_text(spark):
    leak = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(None, leak), (None, f"Again: {leak}!"), (None, leak), (None, "clean text of the first row"), (None, "clean too"),
            (None, "clean too"), (None, None), (None, ""), (1, "clean"), (2, leak), (0, "zero is an id")]
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, _dirty string, own string")
    kept = D.decontaminate(d, spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert kept.columns == d.columns
    want = [r for r in docs if "twelve" not in (r[1] or "")]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, want))


def test_repeated_words_on_both_sides(spark, monkeypatch):
    """A word that a long document and an item repeat: what is compared does not grow with the product of their lengths."""
    real = D._verify

    def counted(batches):
        for b in batches:
            compared_rows.add(b.num_rows)
            yield from real(iter([b]))

    compared_rows = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(D, "_verify", counted)
    docs = spark.createDataFrame([(1, "na " * 8_000), (2, "la na " * 4_000), (3, "clean words only, none of them repeated here")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "na " * 300), (8, "la la na " * 100)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in D.overlaps(docs, items).collect()}
    assert got == {(1, 7): 13}
    assert 0 < compared_rows.value < 100_000


def test_bitmap_size_follows_the_benchmark():
    assert [D._slot_bits(n) for n in (0, 1 << 20, 1 << 21, 1 << 23, 1 << 40)] == [24, 25, 26, 28, 28]
