"""Operator 8 — quality rules as a bitmask ledger (DataFrame functions only).

``ledger`` measures every text once and evaluates every rule once: the
measurements and one long of failure bits per document.  A policy is a
versioned bit mask over that ledger; ``apply_policy`` keeps the documents none
of whose masked bits is set, and ``ablation`` reads, from counts per distinct
bit pattern, what each rule rejects and what it alone rejects.  Nothing is
shuffled but those pattern counts.

Defined results: a null or empty text has no words, so all measurements are 0
and the length rule fails; texts of any length are measured whole; ties and repeated rows are judged row by row; an
empty table gives an empty ledger; other columns of the input are not read, so
their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Dict, Sequence, Tuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "longest_word")

# name -> SQL over the measurements, true where the rule fails; the position is the bit.
RULES: Tuple[Tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_dup_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines"),
    ("mean_word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    ("huge_word", "longest_word > 1000"),
)
BITS: Dict[str, int] = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document is rejected if any of them failed."""

    version: str
    rules: Tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in set(self.rules))


BASE = Policy("base", ("few_words", "repeated_trigrams"))
STRICT = Policy("v1", tuple(BITS))

_SPACES = SPACE_CHARS.replace("\\", "")
_SPLIT = r"[\\x20\\x09-\\x0D]+"


def _sql_space() -> str:
    return "concat(" + ", ".join(f"chr({ord(c)})" for c in _SPACES) + ")"


def _once(sql: str):
    """Evaluate ``sql`` in its own projection.  The optimizer moves a filter below a projection by copying the
    projected expressions into it; it leaves those alone that are marked as non-deterministic, as this is.  Without
    it a filter on the ledger would measure every text several times over."""
    return F.expr(f"if(monotonically_increasing_id() < 0, null, {sql})")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row: the id, ``keep`` columns, and ``MEASURES``.

    Words in a repeated three-word window are found inside the row: each
    window's 64-bit hash is sorted with its position in the low bits (as many
    bits as the text's word count needs), neighbours are compared on the full
    hash, and the covered words are the union of the repeated windows."""
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
                      *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)])
    # array(x) -> transform binds x once: Spark would otherwise evaluate it again inside each lambda.
    words = f"filter(split(_text, '{_SPLIT}'), x -> x != '')"
    lines = f"filter(split(_text, '\\n'), x -> btrim(x, {_sql_space()}) != '')"
    sized = f"""
      transform(array({words}), w -> struct(
        cast(size(w) as bigint) as n_words,
        aggregate(w, 0L, (a, x) -> a + char_length(x)) as word_chars,
        cast(coalesce(array_max(transform(w, x -> char_length(x))), 0) as bigint) as longest_word,
        if(size(w) < 3, cast(array() as array<bigint>),
           transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))) as h))[0]"""
    # position in the low bits; a document of n windows needs ceil(log2(n + 1)) of them
    repeats = """
      transform(array(cast(ceil(log2(size(h) + 1)) as int)), s ->
        transform(array(sort_array(transform(h, (x, i) -> shiftleft(shiftrightunsigned(x, s), s) | cast(i as bigint)))), p ->
          transform(array(transform(p, x -> cast(x & (shiftleft(1L, s) - 1) as int))), at ->
            sort_array(filter(transform(at, (i, k) ->
              if((k > 0 AND h[i] = h[at[greatest(k - 1, 0)]]) OR (k < size(at) - 1 AND h[i] = h[at[least(k + 1, size(at) - 1)]]), i, -1)),
              i -> i >= 0)))[0])[0])[0]"""
    covered = ("aggregate(transform(rep, (i, k) -> if(k < size(rep) - 1, least(3, rep[least(k + 1, size(rep) - 1)] - i), 3)),"
               " 0L, (a, x) -> a + x)")
    hashed = src.select("*", _once(sized).alias("m"), _once(
        f"transform(array({lines}), l -> struct(cast(size(l) - size(array_distinct(l)) as bigint) as dup))[0].dup").alias("n_dup_lines"))
    opened = hashed.select("*", F.col("m.h").alias("h"))
    # most texts repeat no window: the sort runs only where the distinct hashes are fewer
    marked = opened.select("*", _once(
        f"if(size(array_distinct(h)) = size(h), cast(array() as array<int>), {repeats})").alias("rep"))
    return marked.select(
        F.col("_id").alias(id_col),
        F.col("m.n_words").alias("n_words"),
        F.col("m.word_chars").alias("word_chars"),
        F.expr("cast(char_length(_text) - char_length(translate(_text, '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
        "n_dup_lines",
        F.expr(covered).alias("n_repeat_words"),
        F.expr("cast(char_length(_text) - char_length(translate(_text, '\\n', '')) + 1 as bigint)").alias("n_lines"),
        F.col("m.longest_word").alias("longest_word"),
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)],
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Measurements and ``failed``: bit i set where rule i fails."""
    bits = " | ".join(f"if({rule}, {BITS[name]}L, 0L)" for name, rule in RULES)
    return measure(docs, id_col, text_col, keep).withColumn("failed", _once(bits))


def passes(policy: Policy):
    """Column over a ledger: true where the policy keeps the document."""
    return F.expr(f"(failed & {policy.mask}L) = 0")


def apply_policy(led: DataFrame, policy: Policy) -> DataFrame:
    return led.where(passes(policy))


def only_rule(policy: Policy):
    """Column over a ledger: the one rule of the policy that rejects the document, NULL where none or several do."""
    names = " ".join(f"when {BITS[r]} then '{r}'" for r in policy.rules)
    return F.expr(f"case failed & {policy.mask}L {names} end")


def ablation(led: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: documents it fails, and documents only it rejects.

    One aggregate over the distinct bit patterns (at most 2^rules rows), then
    bit arithmetic on those."""
    patterns = led.groupBy(F.expr(f"failed & {policy.mask}L").alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = ", ".join(f"struct('{r}' as rule, {BITS[r]}L as bit)" for r in policy.rules)
    return (patterns.select("bits", "n", F.expr(f"inline(array({rules}))"))
            .groupBy("rule")
            .agg(F.expr("coalesce(sum(n) filter (where bits & bit != 0), 0)").alias("n_failed"),
                 F.expr("coalesce(sum(n) filter (where bits = bit), 0)").alias("n_only"))
            .select(F.lit(policy.version).alias("policy"), "rule", "n_failed", "n_only"))
