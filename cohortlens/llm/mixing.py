"""Operator 11 — mixing sources to target weights by entropy balancing [native].

Every source gets a token target; documents get rates that meet the targets
with the least relative entropy to taking each document once, and rates become
whole copies.  DataFrame functions only.

1. Sizes: words per document.  Documents are counted per (source, size) before
   anything else, so a source or a group of copies that holds a third of all
   rows is a few cells; a source has at most as many cells as its longest text
   has words.
2. Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and
   share the corpus's words; a target stops at ``MOST`` times its source's
   size and the excess is shared again by weight (one aggregate a round).
3. Balancing: least sum of r ln r - r over the documents, with sum of
   size * r = target per source and r <= MOST, has the exponentially tilted
   rates r = min(MOST, exp(lambda * size / scale)).  The convex dual in lambda is solved
   by Newton iterations: each is one aggregate over the cells (gradient and
   curvature per source) and one step per source, on the logarithm of the
   target and inside a bracket, which makes it safe for any start.  Sums are
   decimals, so that neither row order nor partitioning changes a bit of them.
4. Copies: along a source's sizes, from the largest down, the running sum of
   the rates is rounded, which leaves at most half the largest text; a few
   single copies, added or taken where that helps most, close the rest.  Within
   a cell, whose documents have one rate, copies go round equally, and the
   documents with the smallest hash of id and text take the odd ones.  Cells
   beyond ``RANKED`` documents are split by that hash, each part with its share.

Defined results: a null or text without a word has size 0 and rate 1 (one
copy, no words); a source without words has the target 0.  Rows are judged by
row: repeated rows count each, rows of one id too, and equal rows may take
different numbers of copies.  A null id or source is a value of its own.  A
text counts whole, however long.  An empty table gives an empty table; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import with_position
from .common import SPACE_CHARS, stage_table

WEIGHTS = (5, 2, 1)
MOST = 3
RANKED = 1000
_REPAIRS = 6
_ITERATIONS = 200
# A source whose target reaches this share of MOST times its size takes every text MOST times.
_FULL = 1 - 1e-9


def size_of(text: Column) -> Column:
    """The number of words of a text (null: 0)."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (key, source_size) with ``target``: shares of all sizes by the weight of the source's place."""
    cycle = "element_at(array({}), cast((position - 1) % {} + 1 as int))".format(", ".join(f"{w}D" for w in weights), len(weights))
    placed = stage_table(with_position(sources, ["key"]).withColumn("weight", F.expr(cycle)), "mixing-weights")
    share, capped = 0.0, -1
    while True:
        # share is the words per unit of weight; capped sources keep their bound and leave the rest to the others.
        bound = F.lit(float(most)) * F.col("source_size")
        full = F.col("weight") * F.lit(share) > bound
        row = placed.agg(F.sum("source_size").alias("all"), F.count_if(full).alias("n"), F.sum(F.when(full, bound).otherwise(0.0)).alias("kept"),
                         F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if row["n"] == capped or not row["all"] or not row["free"]:
            break
        capped, share = row["n"], (row["all"] - row["kept"]) / row["free"]
    return placed.select("key", "source_size", F.least(F.col("weight") * F.lit(share), F.lit(float(most)) * F.col("source_size")).alias("target"))


def _exact_sum(x: Column) -> Column:
    return F.sum(x.cast("decimal(38,12)")).cast("double")


def balance(cells: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` with the ``tilt`` and ``scale`` of the rates min(most, exp(tilt * size / scale)); null tilt: all ``most``.

    ``cells``: (key, size, n); ``sources``: (key, source_size, target, n).  Newton on the dual, one aggregate a step."""
    full = F.col("target") >= F.lit(_FULL * most) * F.col("source_size")
    state = stage_table(
        sources.select("key", "source_size", "target", (F.col("source_size") / F.col("n")).alias("scale"),
                       F.when(F.col("source_size") == 0, 0.0).when(full, F.lit(None)).otherwise(0.0).cast("double").alias("tilt"),
                       F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
                       ((F.col("source_size") == 0) | full).alias("done")), "mixing-dual")
    for _ in range(_ITERATIONS):
        if state.filter("not done").isEmpty():
            return state.select("key", "source_size", "target", "scale", "tilt")
        x = F.col("size") / F.col("scale")
        rate = F.least(F.lit(float(most)), F.exp(F.col("tilt") * x))
        words = F.col("n") * F.col("size") * rate
        sums = (cells.join(state.filter("not done").select("key", "scale", "tilt"), "key").groupBy("key")
                .agg(_exact_sum(words).alias("got"), _exact_sum(F.when(rate < most, words * x).otherwise(0.0)).alias("slope")))
        moved = state.join(sums, "key", "left").selectExpr(
            "key", "source_size", "target", "scale", "tilt", "done", "got",
            "case when done then low when got < target then tilt else low end as low",
            "case when done then high when got < target then high else tilt end as high",
            "done or abs(got - target) <= 1e-12 * target as hit",
            "if(got > 0 and slope > 0, tilt + ln(target / got) * got / slope, null) as newton")
        step = ("case when hit then tilt when newton is not null and coalesce(newton >= low, true) and coalesce(newton <= high, true) then newton "
                "when low is null then 2 * high - 1 when high is null then 2 * low + 1 else (low + high) / 2 end")
        state = stage_table(moved.withColumn("next", F.expr(step)).selectExpr(
            "key", "source_size", "target", "scale", "next as tilt", "low", "high",
            "hit or abs(next - tilt) <= 1e-14 * (1 + abs(tilt)) as done"), "mixing-dual")
    raise RuntimeError(f"the dual did not converge in {_ITERATIONS} iterations")


def round_copies(cells: DataFrame, most: int = MOST) -> DataFrame:
    """``cells`` (key, size, n, target, rate) with the whole number of ``copies`` of each cell's documents together."""
    source = Window.partitionBy("key")
    down = source.orderBy(F.desc("size"))
    upto = F.sum(F.col("n") * F.col("rate")).over(down)
    out = (cells.withColumn("upto", F.floor(upto + 0.5)).withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0)))
           .drop("upto"))
    for _ in range(_REPAIRS):
        # One copy more or less in the cell that leaves the least distance to the target, if it lessens it at all.
        out = out.withColumn("short", F.round("target") - F.sum(F.col("copies") * F.col("size")).over(source))
        useful = f"size > 0 and size < 2 * abs(short) and if(short > 0, copies < {most} * n, copies > 0)"
        out = out.withColumn("best", F.min(F.expr(f"if({useful}, struct(abs(abs(short) - size) as left, size as size), null)")).over(source))
        out = out.withColumn("copies", F.expr("if(size = best.size, copies + cast(signum(short) as bigint), copies)")).drop("short", "best")
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(id_col, size, source_size, target, taken, copies, rate), one row per input row.

    ``target`` is the source's; ``copies`` is how often the mix takes the document, ``taken`` the words of them."""
    # Code points sort as UTF-8 bytes do; the first character puts null last.
    key = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))
    narrow = stage_table(docs.select(F.col(id_col).alias("id"), key.alias("key"), size_of(F.col(text_col)).alias("size"),
                                     F.xxhash64(F.col(id_col), F.col(text_col)).alias("tag")), "mixing-sizes")
    cells = stage_table(narrow.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "mixing-cells")
    sources = stage_table(cells.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n")), "mixing-sources")
    aimed = targets(sources.drop("n"), weights, most).join(sources.select("key", "n"), "key")
    tilts = balance(cells.filter("size > 0"), aimed, most)
    rated = cells.join(tilts, "key").withColumn(
        "rate", F.expr(f"case when size = 0 then 1D when tilt is null then {float(most)}D else least({float(most)}D, exp(tilt * size / scale)) end"))
    whole = round_copies(rated.filter("size > 0"), most).unionByName(rated.filter("size = 0").withColumn("copies", F.col("n")))
    dealt = stage_table(whole.selectExpr(
        "key", "size", "source_size", "target", "rate", "n", "copies div n as each", "copies % n as odd",
        f"cast(ceil(n / {float(RANKED)}D) as bigint) as parts"), "mixing-copies")
    # The odd copies go to the smallest hashes of each part; where more than half the documents take one, the rule
    # chooses those that do not, so that a part is never short of documents.
    part = Window.partitionBy("key", "size", "part").orderBy("tag", "id")
    few = "if(2 * odd > n, n - odd, odd)"
    spread = (narrow.join(dealt, ["key", "size"])
              .withColumn("part", F.expr("pmod(xxhash64(tag), parts)"))
              .withColumn("quota", F.expr(f"(part + 1) * {few} div parts - part * {few} div parts"))
              .withColumn("chosen", F.row_number().over(part) <= F.col("quota")))
    copies = F.col("each") + (F.col("chosen") != F.expr("2 * odd > n")).cast("long")
    return (spread.withColumn("copies", copies)
            .select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate"))


def repeat(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: every document (ids must be unique) as often as ``mixed`` says."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"))
    counts = mixed.select(F.col(id_col).alias("other"), "copies").filter("copies > 0")
    return (row.join(counts, F.col("id").eqNullSafe(F.col("other")))
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*"))
