"""Operator 3 — toxicity by a linear-chain conditional random field.

Every token has features: its word, its first and last bytes, its word together
with the one before and with the one after it in the sentence, its shape (capitals, digits, other scripts,
length) and whether it opens the sentence.  From a bounded sample of labelled
documents Spark counts, for every feature, the toxic and the other documents
that hold it; features whose log-odds stand out on either side get a weight.

Documents carry labels, tokens do not: the tags of tokens are latent.  A clean
document has no toxic token, a toxic one has at least one, so a document is
toxic with probability 1 - P(all tags clean) = 1 - 1/Z under the two-tag chain
(``NOISE`` allows for wrong labels).
Weights of features, with their log-odds as the prior's mean, and of the moves
between tags are fitted together to this likelihood by gradient; the expected tags of a toxic document, given that there
is one, label its tokens anew in every step, as in expectation maximisation.

Scoring: forward-backward over every sentence of every whole text gives each
token's marginal.  A document's score is a logistic function, fitted on the
sample, of its largest marginal, their sum, and their sum per token; runs of tokens
with a marginal above one half are the offending spans (code points, end
exclusive).  All sentences of an Arrow slice advance in lockstep.

The samples: labelled rows outside the held-out fold whose id hash falls below
the fraction that gives about ``SAMPLE_DOCS`` documents per class count features
and calibrate; of these about ``CHAIN_DOCS`` per class fit the chain.  All tokens
of their whole texts take part; for fitting alone, sentences of over
``CHAIN_TOKENS`` tokens are parted into several, which ignores one move in
``CHAIN_TOKENS``.

Defined results: a null or empty text has the score of a text without evidence
and no spans; texts of any length are scored whole; without a toxic or without a
clean labelled row every score is 0; an id labelled both ways counts as toxic;
repeated rows score alike; rows without id do not train; an empty table gives an
empty table; columns other than id, text and label are not read, whatever their
names; labels, lang, source and id are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator, List, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, Rolling, batches_of, byte_values, held_out, mix64, token_bounds, utf8_view

SAMPLE_DOCS, CHAIN_DOCS = 4000, 400
CHAIN_TOKENS = 64
PREFIXES, SUFFIXES = (4, 5, 6, 7), (3, 4)  # bytes
MIN_SUPPORT, MIN_ODDS, RIDGE = 4, 2.0, 1e-3
NOISE = 0.02  # share of documents without a toxic token that are labelled toxic all the same
_VALUES = byte_values(3)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in "\n.!?"]] = True


def features(data: np.ndarray, begin: np.ndarray, end: np.ndarray, heads: np.ndarray) -> List[np.ndarray]:
    """Hashes of every token's features, one array per kind; 0 where a token has none of that kind.

    ``heads`` are the first tokens of sentences."""
    roll = Rolling(LOWER_BYTES[data], _VALUES)
    size = end - begin
    salt = lambda h, kind: mix64(h + np.uint64(kind * 0x9E3779B9))
    word = mix64(roll.of(begin, end))
    out = [word]
    for n in PREFIXES:
        out.append(np.where(size > n, salt(roll.of(begin, np.minimum(begin + n, end)), n), np.uint64(0)))
    for n in SUFFIXES:
        out.append(np.where(size > n, salt(roll.of(np.maximum(end - n, begin), end), 10 + n), np.uint64(0)))
    opens = np.zeros(len(begin) + 1, bool)
    opens[heads] = True
    opens[len(begin)] = True
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    out.append(np.where(opens[:-1], np.uint64(0), salt(word ^ salt(before, 20), 21)))
    out.append(np.where(opens[1:], np.uint64(0), salt(word ^ salt(after, 22), 23)))
    has = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[np.stack([begin, end])], axis=0)[0]
    upper, digit, other = has((data >= 65) & (data <= 90)), has((data >= 48) & (data <= 57)), has(data >= 128)
    shape = (upper > 0) + 2 * (upper == size) + 4 * (digit > 0) + 8 * (other > 0) + 16 * np.minimum(size, 15) + 256 * opens[:-1]
    out.append(salt(shape.astype(np.uint64), 30))
    return out


@dataclass
class Chain:
    """The fitted features, chain and calibration."""

    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray  # of the features, and the bias last
    moves: np.ndarray  # log weights O->T, T->O, T->T (O->O is 0)
    calibration: np.ndarray  # weights of _summary's columns

    def active(self, data, begin, end, heads) -> Tuple[np.ndarray, np.ndarray]:
        """(token, feature number) of every feature of the model that occurs."""
        tokens, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(self.keys) and len(begin):
            # a 2^16 table of leading bits answers most tokens: their feature is not in the model
            if not hasattr(self, "_maybe"):
                self._maybe = np.zeros(1 << 16, bool)
                self._maybe[(self.keys >> np.uint64(48)).astype(np.int64)] = True
            for f in features(data, begin, end, heads):
                some = np.flatnonzero(self._maybe[(f >> np.uint64(48)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, f[some]), len(self.keys) - 1)
                hit = self.keys[at] == f[some]
                tokens.append(some[hit])
                numbers.append(at[hit])
        return np.concatenate(tokens), np.concatenate(numbers)

    def emit(self, tokens: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
        """Log weight of the toxic tag of each of n tokens."""
        return emission(self.weights, tokens, numbers, n)


def emission(weights: np.ndarray, tokens: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
    return np.clip(weights[-1] + np.bincount(tokens, weights[numbers], minlength=n), -30, 30)


def sequences(data, begin, end, first) -> np.ndarray:
    """Index of every sentence's first token; sentences end at line ends and . ! ? and with the text."""
    stops = np.concatenate(([0], np.cumsum(_STOP[data])))
    new = np.ones(len(begin), bool)
    if len(begin):
        new[1:] = stops[begin[1:]] != stops[end[:-1]]
        new[first[:-1][first[:-1] < len(begin)]] = True
    return np.flatnonzero(new)


def forward_backward(score: np.ndarray, start: np.ndarray, moves: np.ndarray) -> Tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(marginal of the toxic tag, forward share, backward ratio, normaliser) of every token.

    forward share: of the toxic tag given the tokens so far; backward ratio: weight of what follows a toxic tag over
    that of what follows the other; the product of a sentence's normalisers is its Z."""
    n = len(score)
    size = np.diff(np.concatenate((start, [n])))
    order = np.argsort(-size, kind="stable")
    size, at = size[order], start[order]
    e = np.exp(score)
    ot, to, tt = np.exp(moves)
    f, r, z = np.zeros(n), np.ones(n), np.ones(n)
    alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    share = None
    for pos, k in enumerate(alive.tolist()):
        i = at[:k] + pos
        if share is None:
            toxic, other = e[i], 1.0
        else:
            share = share[:k]
            toxic, other = (share * tt + (1 - share) * ot) * e[i], share * to + (1 - share)
        z[i] = toxic + other
        share = toxic / z[i]
        f[i] = share
    for pos in range(len(alive) - 2, -1, -1):
        k = int(alive[pos + 1])
        i = at[:k] + pos
        next_ = e[i + 1] * r[i + 1]
        r[i] = (tt * next_ + to) / (ot * next_ + 1)
    return f * r / (f * r + (1 - f)), f, r, z


def fit_chain(tokens: np.ndarray, numbers: np.ndarray, n_features: int, start: np.ndarray, doc: np.ndarray, toxic: np.ndarray,
              first_guess: np.ndarray, steps: int = 200) -> Tuple[np.ndarray, np.ndarray]:
    """(weights with the bias last, moves) by gradient ascent (Adam) on the documents' mean likelihood less
    ``RIDGE`` / 2 times the squared distances from the first guess (of all but the bias).

    ``doc`` is every token's document, ``toxic`` every document's label.  With c = 1 - ``NOISE``: log P(clean) is log c -
    log Z, whose gradient is minus the expected features; log P(toxic) = log(1 - c / Z), whose gradient is the expected
    features over Z / c - 1."""
    n, k = len(doc), n_features + 1
    prior = np.concatenate((first_guess, [-7.0], np.zeros(3)))
    theta = prior.copy()
    ridge = np.full(k + 3, RIDGE)
    ridge[n_features] = 0
    mean, square = np.zeros(k + 3), np.zeros(k + 3)
    inner = np.ones(n, bool)
    inner[start] = False
    b = np.flatnonzero(inner)  # tokens with one before them in the sentence
    a = b - 1
    for t in range(1, steps + 1):
        score = emission(theta[:k], tokens, numbers, n)
        p, f, r, z = forward_backward(score, start, theta[k:])
        log_z = np.bincount(doc, np.log(z), minlength=len(toxic))
        pull = np.where(toxic > 0, 1 / (np.exp(np.minimum(log_z, 500)) / (1 - NOISE) - 1), -1.0)[doc]
        ot, to, tt = np.exp(theta[k:])
        next_ = np.exp(score[b]) * r[b]
        pair = np.stack([(1 - f[a]) * ot * next_, f[a] * to, f[a] * tt * next_])
        pair /= pair.sum(axis=0) + (1 - f[a])
        own = p * pull
        grad = np.concatenate((np.bincount(numbers, own[tokens], minlength=n_features), [own.sum()], (pair * pull[b]).sum(axis=1)))
        grad = grad / max(len(toxic), 1) - ridge * (theta - prior)
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad ** 2
        theta = theta + 0.1 * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.99 ** t)) + 1e-12)
    return theta[:k], theta[k:]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w = w + np.linalg.solve(hess, x.T @ (y - p) - 1e-2 * w)
    return w


def _summary(top: np.ndarray, total: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Per text: 1, log of the largest marginal, log of their sum, and log of their sum per hundred tokens."""
    return np.stack([np.ones(len(top)), np.log(top + 1e-3), np.log1p(total), np.log1p(100 * total / np.maximum(tokens, 1))], 1)


def _per_text(values: np.ndarray, first: np.ndarray, how) -> np.ndarray:
    """how.reduceat over each text's tokens; 0 for a text without any."""
    out = np.zeros(len(first) - 1)
    some = np.diff(first) > 0
    if some.any():
        out[some] = how.reduceat(values, first[:-1][some])
    return out


def score_slice(chain: Chain, column):
    """(top marginal, sum of marginals, first token, begin, end, marginal, data, starts) of a column of texts."""
    data, starts = utf8_view(column)
    begin, end, first = token_bounds(data, starts)
    heads = sequences(data, begin, end, first)
    p = forward_backward(chain.emit(*chain.active(data, begin, end, heads), len(begin)), heads, chain.moves)[0]
    return _per_text(p, first, np.maximum), _per_text(p, first, np.add), first, begin, end, p, data, starts


# --- training -----------------------------------------------------------------

def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for b in batches_of(big, 1 << 22):
            data, starts = utf8_view(b.column(1))
            begin, end, first = token_bounds(data, starts)
            if len(begin) == 0:
                continue
            row = np.repeat(np.arange(b.num_rows), np.diff(first)).astype(np.uint64)
            toxic = np.asarray(b.column(0)).astype(bool)
            for f in features(data, begin, end, sequences(data, begin, end, first)):
                once = np.unique(mix64(f + row * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]  # once a document
                once = once[f[once] != 0]
                key, which = np.unique(f[once], return_inverse=True)
                t = np.bincount(which, weights=toxic[row[once].astype(np.int64)], minlength=len(key)).astype(np.int64)
                n = np.bincount(which, minlength=len(key))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(t), pa.array(n - t)], ["f", "t", "o"])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_docs: int):
    """(toxic rows, other rows, sample): sample is (toxic, text, draw) of about ``sample_docs`` rows per class."""
    want = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    want = want.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    per = {r["toxic"]: r["n"] for r in want.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("toxicity sample")), F.lit(1 << 30))
    keep = F.lit(False)
    for toxic, n in per.items():
        keep = keep | ((F.col("toxic") == toxic) & (draw < int(min(1.0, sample_docs / n) * (1 << 30))))
    chosen = want.where(keep).select("id", "toxic", draw.alias("draw"))
    texts = docs.select(F.col(id_col).alias("did"), F.col(text_col).cast("string").alias("text"))
    # about sample_docs rows of three numbers per class, whatever the tables' size: broadcast, so no text is shuffled
    sample = texts.join(F.broadcast(chosen), F.col("id") == F.col("did")).select("toxic", "text", "draw")
    return per.get(1, 0), per.get(0, 0), sample


_PART = ["token", "number", "head", "doc", "label"]  # the sample of the chain, as 32-bit numbers


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample_docs: int = SAMPLE_DOCS):
    """A broadcast ``Chain``, or None without toxic labelled rows."""
    toxic, other, sample = labelled_sample(docs, labels, id_col, text_col, label_col, sample_docs)
    if toxic == 0 or other == 0:
        return None
    sample = sample.persist()
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        sample.unpersist()
        return None
    counted = (sample.select("toxic", "text").mapInArrow(_count_features, "f long, t long, o long")
               .groupBy("f").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
               .withColumn("odds", F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("o") + 0.5) / (n_other + 1.0)))
               .where(((F.col("t") >= MIN_SUPPORT) & (F.col("odds") >= MIN_ODDS)) | ((F.col("o") >= MIN_SUPPORT) & (F.col("odds") <= -MIN_ODDS)))
               .select("f", "odds").toPandas())
    keys = counted["f"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, guess = keys[order], counted["odds"].to_numpy()[order].astype(np.float64)
    chain = Chain(keys, np.zeros(len(keys) + 1), np.zeros(3), np.zeros(4))
    share = {1: min(1.0, CHAIN_DOCS / n_toxic), 0: min(1.0, CHAIN_DOCS / n_other)}
    drawn = F.pmod(F.xxhash64("draw"), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, int(share[1] * (1 << 20))).otherwise(int(share[0] * (1 << 20)))
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def chains(batches):
        for big in batches:
            for b in batches_of(big, 1 << 22):
                data, starts = utf8_view(b.column(1))
                begin, end, first = token_bounds(data, starts)
                heads = sequences(data, begin, end, first)
                tokens, numbers = shared.value.active(data, begin, end, heads)
                is_head = np.zeros(len(begin), np.int8)
                is_head[heads] = 1
                since = np.arange(len(begin)) - heads[np.cumsum(is_head) - 1] if len(begin) else np.zeros(0, int)
                is_head[since % CHAIN_TOKENS == 0] = 1
                doc = np.repeat(np.arange(b.num_rows), np.diff(first))
                parts = (tokens, numbers, is_head, doc, np.asarray(b.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in parts], _PART)

    got = sample.where(drawn).select("toxic", "text").mapInArrow(chains, ", ".join(f"{c} binary" for c in _PART)).toPandas()
    parts = {c: [np.frombuffer(x, np.int32).astype(np.int64) for x in got[c]] for c in _PART}
    sizes = {c: np.cumsum([0] + [len(x) for x in parts[c]]) for c in _PART}
    if len(got) and sizes["doc"][-1]:
        # tokens and documents are numbered within a slice: shift them by what the slices before hold
        shifted = {c: np.concatenate([x + d for x, d in zip(parts[c], sizes[by])]) for c, by in (("token", "doc"), ("doc", "label"))}
        number, head, label = (np.concatenate(parts[c]) for c in ("number", "head", "label"))
        chain.weights, chain.moves = fit_chain(shifted["token"], number, len(keys), np.flatnonzero(head), shifted["doc"], label, guess)
    fitted = docs.sparkSession.sparkContext.broadcast(chain)

    def summaries(batches):
        for big in batches:
            for b in batches_of(big, 1 << 22):
                top, total, first, *_ = score_slice(fitted.value, b.column(1))
                label = np.asarray(b.column(0)).astype(np.float64)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (label, top, total, np.diff(first)))), ["y", "top", "total", "n"])

    s = sample.select("toxic", "text").mapInArrow(summaries, "y double, top double, total double, n long").toPandas()
    sample.unpersist()
    chain.calibration = _logistic(_summary(s["top"].to_numpy(), s["total"].to_numpy(), s["n"].to_numpy()), s["y"].to_numpy())
    return docs.sparkSession.sparkContext.broadcast(chain)


# --- scoring --------------------------------------------------------------------

_SPANS = "array<struct<start:int,end:int>>"


def _spans(p, first, begin, end, data, starts):
    """Runs of tokens above one half within a text, as an Arrow list column of code-point offsets."""
    hot = np.concatenate(([False], p > 0.5, [False]))
    head = np.zeros(len(p) + 1, bool)
    head[first] = True
    prev = hot[:-2] & ~head[:-1]  # the token before, in the same text, is hot
    nxt = hot[2:] & ~head[1:]
    here = hot[1:-1]
    a, b = np.flatnonzero(here & ~prev), np.flatnonzero(here & ~nxt)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    text = np.searchsorted(first, a, side="right") - 1
    base = chars[starts[text]]
    values = pa.StructArray.from_arrays([pa.array((chars[begin[a]] - base).astype(np.int32)), pa.array((chars[end[b]] - base).astype(np.int32))], ["start", "end"])
    offsets = np.searchsorted(a, first).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def score(docs: DataFrame, chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, spans), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in batches_of(big, 1 << 22):
                if chain is None:
                    out = [np.zeros(b.num_rows), pa.array([[]] * b.num_rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                else:
                    top, total, first, begin, end, p, data, starts = score_slice(chain.value, b.column(1))
                    z = np.clip(_summary(top, total, np.diff(first)) @ chain.value.calibration, -30, 30)
                    out = [1 / (1 + np.exp(-z)), _spans(p, first, begin, end, data, starts)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0]), out[1]], [id_col, "score", "spans"])

    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, score double, spans {_SPANS}")
