"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from typing import Callable, Dict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, language_id, line_dedup, mixing, periodic_runs, pii, quality_rules, sentencepiece_codec, simhash, suffix_dedup, toxicity, url_filter
from .common import held_out, read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), digest=True)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read_table(spark, sf_dir, "documents"))
    base = "filter(spans, s -> s.kind in (" + ", ".join(f"'{k}'" for k in pii.BASE_KINDS) + "))"
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS],
        F.expr(f"sha2({joined.format(base)}, 256)").alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
        F.expr("array_join(transform(spans, s -> format_number(s.score, '0.00')), ',')").alias("scores"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (doc_id, item_id) whose texts overlap."""
    return decontaminate.overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ids counted and digested, and whether they decode to the very text."""
    tokens = sentencepiece_codec.encode(read_table(spark, sf_dir, "documents"), decoded_col="decoded")
    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>"))
    return tokens.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("exact"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(read_table(spark, sf_dir, "documents"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes(quality_rules.BASE)).alias("base_failed"),
        (quality_rules.passes(quality_rules.BASE) & quality_rules.passes(quality_rules.STRICT)).alias("kept"),
        # the ledger itself: failure bits, the policy judged by, and the rule without which it would keep the document
        "failed", F.lit(quality_rules.STRICT.version).alias("policy"), quality_rules.only_rule(quality_rules.STRICT).alias("only_rule"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                                counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document with its planted period: the number of runs, the longest, and digests of all runs and the rest."""
    found = periodic_runs.find_runs(periodic_runs.plant(read_table(spark, sf_dir, "documents")))
    # The greatest length, then the smallest start, then the smallest period.
    best = F.array_max(F.expr("transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period))"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.expr("sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, chr(10))), ''), 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; every seventh row has a wrong label."""
    wrong = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings").withColumn("label", wrong), "vec_id % 100 = 0")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


LLM_QUERIES: Dict[str, Query] = {f.__name__: f for f in (
    op1_suffix_dedup, op2_url_filters, op3_toxicity, op4_pii, op5_benchmark_decontamination, op6_language_id,
    op7_sentencepiece, op8_quality_rules, op9_line_dedup, op10_simhash, op11_mixing, op12_periodic_runs, op13_hard_negatives, pipeline)}


_HOST_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2_SQL = f"""
WITH u AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_HOST_LOWER}) AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p
      FROM (VALUES {', '.join(f"('{v}', '{r}')" for v, r in url_filter.RULES)}) AS t(verdict, rule)),
best AS (SELECT page_id, rule, verdict FROM u JOIN r
         ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
         QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
SELECT u.page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host || path, '(?s)^[^/]*spam[^/]*/.*$|/ads/|/tracker/|\\.exe$')
                              THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (page_id)
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)),
                              lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM d),
windows AS (SELECT doc_id, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g
            FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows WHERE g IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
             len(string_split(t, chr(10))) AS n_lines,
             coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest
      FROM d LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR (n_dup_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines)
            OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)) OR longest > 1000) AS kept,
       failed, 'v1' AS policy,
       CASE failed WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_trigrams' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines'
                   WHEN 16 THEN 'mean_word_length' WHEN 32 THEN 'huge_word' END AS only_rule
FROM (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
                     + 8 * (n_dup_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines)::INT
                     + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))::INT
                     + 32 * (longest > 1000)::INT AS BIGINT) AS failed FROM b)
"""

_KEY = ("translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),"
        " 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

OP9_SQL = f"""
WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
               FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, {_KEY} AS k FROM lines),
gone AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, i, line, last IS NOT NULL AND last <> doc_id AS drop FROM keyed LEFT JOIN gone USING (k))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (drop) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT drop), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# Words q apart that are equal form islands; an island of m such pairs is a run of m + q words.  crc32 goes bit by bit.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(CAST(4294967295 AS BIGINT), list_reduce(
        list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
            lambda c: list_concat([CAST(ascii(c) AS BIGINT)], [CAST(-1 AS BIGINT) FOR i IN range(8)])))),
        lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, (s & 1) * 3988292384) END)) AS h FROM documents),
a AS (SELECT *, CAST(len(w) AS BIGINT) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
words AS (SELECT r, u.i AS i, CASE WHEN h % 10 = 0 AND u.i >= a THEN w[a + (u.i - a) % p + 1] ELSE w[u.i + 1] END AS x
          FROM p, unnest(range(n)) AS u(i)),
same AS (SELECT f.r, s.i - f.i AS q, f.i FROM words f JOIN words s ON f.r = s.r AND f.x = s.x AND f.i < s.i),
islands AS (SELECT r, q, min(i) AS start, count(*) AS m
            FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM same) GROUP BY r, q, g),
runs AS (SELECT r, start, m + q AS length, min(q) AS period FROM islands WHERE m + q >= greatest(12, 2 * q) GROUP BY ALL),
lists AS (SELECT r, count(*) AS n_runs, first(struct_pack(s := start, l := length, p := period) ORDER BY length DESC, start, period) AS best,
                 string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, i FROM runs, unnest(range(start + period, start + length)) AS u(i)),
kept AS (SELECT words.r, string_agg(x, ' ' ORDER BY words.i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY words.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length,
       CAST(best.p AS BIGINT) AS period, CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN lists USING (r) LEFT JOIN kept USING (r)
"""

OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
             CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, p.other_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""

LLM_ORACLE: Dict[str, str] = {"op2_url_filters": OP2_SQL, "op8_quality_rules": OP8_SQL, "op9_line_dedup": OP9_SQL,
                              "op12_periodic_runs": OP12_SQL, "op13_hard_negatives": OP13_SQL}
