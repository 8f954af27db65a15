
import __spark_entry__
import corpus_pipeline

from . import test_decontaminate, test_line_dedup, test_quality_rules, test_simhash
from .conftest import SF


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [(i, t) for i, t in rows for m in [test_quality_rules.brute(t)] if not (
        m[0] < 50 or 100 * m[4] > 50 * m[0] or 10 * m[2] > 3 * m[0] or (m[3] >= 5 and 10 * m[3] > 3 * m[5])
        or (m[0] and not 2 * m[0] <= m[1] <= 20 * m[0]) or m[6] > 1000)]
    rows = sorted((int(i), t) for i, _, _, t in test_line_dedup.brute(rows))
    keep = test_simhash.classes([test_simhash.slow_fingerprint(t) for _, t in rows])
    rows = [r for k, r in enumerate(rows) if keep[k] == k]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i, _ in test_decontaminate.brute(rows, items)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {i for i, _ in rows if i not in dirty}
    assert all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in got.values())


def test_stages_keep_columns_and_bear_edges(spark, edge, empty):
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns in (edge.columns, empty.columns), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_registered_queries_and_oracles():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert set(range(1, 14)) == {int(x[2:].split("_")[0]) for x in names if x.startswith("op")}


def test_sql_oracles(spark, duck):
    from cohortlens.llm.queries import LLM_ORACLE, LLM_QUERIES

    for table in ("documents", "pages", "embeddings"):
        duck.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    for name, sql in LLM_ORACLE.items():
        got, want = LLM_QUERIES[name](spark, SF), duck.execute(sql)
        cols, names = sorted(got.columns), [d[0] for d in want.description]
        assert cols == sorted(names)
        rows = sorted((tuple(r[names.index(c)] for c in cols) for r in want.fetchall()), key=repr)
        assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == rows, name
