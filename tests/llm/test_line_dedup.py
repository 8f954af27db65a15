import time
from collections import defaultdict

import numpy as np

from cohortlens.llm import line_dedup as D

from .conftest import edge_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\f\r").translate(LOWER)


def brute(rows):
    """A row without an id is a document by its text; among rows with ids the largest keeps a repeated line."""
    name = lambda i, t: ("text", t or "") if i is None else ("id", i)
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                docs[key(line)].add(name(i, t))
    last = {k: max((n[1] for n in v if n[0] == "id"), default=None) for k, v in docs.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def got(docs):
    return sorted((str(r["doc_id"]), r["lines_before"], r["lines_gone"], r["text"] or "") for r in D.drop_lines(docs, counts=("lines_before", "lines_gone")).collect())


def test_against_brute_force(documents, texts):
    assert got(documents) == brute(list(texts.items()))


def test_edges(edge, empty):
    assert got(edge) == brute(edge_rows())
    assert D.drop_lines(edge).columns == edge.columns
    assert D.drop_lines(empty).collect() == []


def test_hot_line(spark):
    rows = [(i, f"A line that a third of all rows share\nown line number {i:012d}" if i % 3 == 0 else f"own line number {i:012d}") for i in range(600)]
    rows += [(None, "a LINE that a third of all rows share")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(docs) == brute(rows)


def test_rows_without_an_id_are_documents(spark):
    """Three such rows share a line: two of them lose it, whatever the hash says which."""
    line = "A line that three rows without an id have in common"
    docs = spark.createDataFrame([(None, f"{line}\nrow {i}") for i in range(3)] + [(None, f"{line}\nrow 0")], "doc_id long, text string")
    texts = [r["text"] for r in D.drop_lines(docs).collect()]
    keepers = {t for t in texts if line in t}
    assert len(texts) == 4 and len(keepers) == 1 and {t.split("\n")[-1] for t in texts} == {"row 0", "row 1", "row 2"}
    docs = spark.createDataFrame([(None, line), (None, f"{line}\nrow"), (4, line)], "doc_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in D.drop_lines(docs).collect()} == {(None, ""), (None, "row"), (4, line)}


def test_texts_shuffle_once(spark, monkeypatch, tmp_path):
    """Only the hashes are written from the texts: what confirms the suspects never reads a text again, and the last join carries it once."""
    rows = [(i, f"A line that all of these rows have in common\nrow {i}", "en") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path := f"{tmp_path}/documents")
    staged = []
    monkeypatch.setattr(D, "stage_table", lambda df, name, stage=D.stage_table: staged.append((name, df)) or stage(df, name))
    out = D.drop_lines(spark.read.parquet(path))
    assert sorted(r["text"] for r in out.collect()) == sorted(["row 0", "row 1", "row 2", "row 3", "row 4", rows[5][1]])
    assert [name for name, df in staged if any(path in f for f in df.inputFiles())] == ["line-hashes"]
    assert not any(f.dataType.simpleString() == "string" for _, df in staged for f in df.schema)
    joined = out._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(doc_id," in joined and ", text, text#" not in joined


def test_keys_alike_but_not_equal(spark):
    """Keys that differ in their first or last character only, or in a letter that A-Z lower-casing leaves, are counted apart."""
    stem = "a line of text that many rows nearly share"
    rows = [(i, f"{c}{stem}\n{stem}{c}") for i, c in enumerate("xxyyyzzzzÉÉéé")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_linear_in_the_lines_of_a_text(spark):
    """Three copies of one long text lose nearly all of its lines; twice the lines take about twice the time, not four times."""
    def seconds(n):
        text = "\n".join(f"line number {i:012d} of a long text" for i in range(n))
        docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
        start = time.perf_counter()
        got = {r["doc_id"]: (r["b"], r["g"]) for r in D.drop_lines(docs, counts=("b", "g")).collect()}
        assert got == {0: (n, n), 1: (n, n), 2: (n, 0)}
        return time.perf_counter() - start

    seconds(4_000)
    assert seconds(64_000) < 3 * seconds(32_000)


def test_bloom_has_no_false_negative():
    h = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    bloom = D.Bloom(len(h) // 2)
    bloom.add(h[:10_000])
    assert bloom.has(h[:10_000]).all()
    assert bloom.has(h[10_000:]).mean() < 0.02
