"""Operator 7 — SentencePiece encoding and decoding by Aho-Corasick and Viterbi.

An Aho-Corasick automaton over the model's pieces reads a word's bytes once;
at each position its output links name all pieces that end there, and each
relaxes the best score of the position (the sum of piece scores; of equal
scores the longer last piece stays).  A character that no piece covers costs
ten less than the worst piece and becomes byte pieces.  Words are advanced in
lockstep as numpy arrays, and a bounded memo keeps words already segmented.

Text is cut into words where no piece can reach across (before a space that
follows a non-space, and around line feeds); both are checked against the
model, so the cut never changes the result.  As usual for such models a space
is put before the text; decoding takes it away, and decode(encode(x)) is x for
every text: a literal U+2581 goes to byte pieces rather than becoming a space.

The model file is read on the driver and sent as a broadcast; it is a fixed
vocabulary (32,000 pieces, 0.5 MB), independent of the data.

Defined results: a null text has null ids and decodes to null; an empty text
has no ids; texts of any length are encoded whole; every row gives one row, repeated or not; an empty table gives an
empty table; columns are chosen by the caller, other names cannot clash.
"""

from __future__ import annotations

import re
from collections import deque
from typing import Dict, Iterator, List, Sequence, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MEMO_WORDS = 100_000
_SPACE = "▁"

Vocabulary = Tuple[List[bytes], List[float], List[int], List[int]]


def load_vocabulary(path: str = DEFAULT_MODEL) -> Vocabulary:
    """(pieces as bytes with real spaces, scores, kinds, ids of the 256 byte pieces); kind 0: normal, 1: byte, 2: other."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, kinds, by_byte = [], [], [], [0] * 256
    for i in range(m.get_piece_size()):
        text = m.id_to_piece(i)
        kind = 1 if m.is_byte(i) else 2 if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else 0
        if kind == 1:
            by_byte[int(text[3:5], 16)] = i
        pieces.append(bytes([int(text[3:5], 16)]) if kind == 1 else text.replace(_SPACE, " ").encode() if kind == 0 else b"")
        scores.append(m.get_score(i))
        kinds.append(kind)
    return pieces, scores, kinds, by_byte


class Automaton:
    """Aho-Corasick over bytes: a full transition table, and output links to the pieces that end in a state."""

    def __init__(self, vocabulary: Vocabulary):
        self.pieces, scores, kinds, self.by_byte = vocabulary
        children: List[Dict[int, int]] = [{}]
        piece = [-1]
        for i, (p, kind) in enumerate(zip(self.pieces, kinds)):
            if kind or not p:
                continue
            if re.search(rb"[^ ] |\n", p):
                raise ValueError(f"piece {p!r} reaches across a word's edge")
            at = 0
            for byte in p:
                if byte not in children[at]:
                    children[at][byte] = len(children)
                    children.append({})
                    piece.append(-1)
                at = children[at][byte]
            if piece[at] < 0 or scores[i] > scores[piece[at]]:
                piece[at] = i
        n = len(children)
        self.goto = np.zeros((n, 256), np.uint16 if n <= 1 << 16 else np.int32)  # 29 MB for 32,000 pieces
        self.piece = np.array(piece, np.int32)
        self.link = np.zeros(n, np.int32)  # the state itself or its nearest suffix that is a piece; 0: none
        self.after = np.zeros(n, np.int32)  # the next one after the state itself
        queue, fail = deque([0]), [0] * n
        while queue:
            s = queue.popleft()
            if s:
                self.goto[s] = self.goto[fail[s]]
                self.after[s] = self.link[fail[s]]
                self.link[s] = s if piece[s] >= 0 else self.after[s]
            for byte, c in children[s].items():
                fail[c] = int(self.goto[s, byte]) if s else 0
                self.goto[s, byte] = c
                queue.append(c)
        used = np.maximum(self.piece, 0)
        self.length = np.array([len(p) for p in self.pieces], np.int32)[used]
        self.score = np.array(scores, np.float64)[used]
        normal = [s for s, k in zip(scores, kinds) if k == 0]
        self.unknown = min((s for s in normal if s > -1e8), default=0.0) - 10.0
        self.memo: Dict[bytes, bytes] = {}

    _word = re.compile(rb" *[^ \n]+|\n| +")

    def words(self, text: str) -> List[bytes]:
        return self._word.findall(b" " + text.encode()) if text else []

    def segment(self, words: Sequence[bytes]) -> List[bytes]:
        """Ids of each word, packed as 32-bit integers."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        out: List[bytes] = [b""] * len(words)
        lo = 0
        while lo < len(order):
            width = len(words[order[lo]])
            some = order[lo: lo + max(1, (1 << 21) // max(width, 1))]
            for i, ids in zip(some, self._lockstep([words[i] for i in some])):
                out[i] = ids
            lo += len(some)
        return out

    def _lockstep(self, words: List[bytes]) -> List[bytes]:
        """Words sorted by falling length; all of them advance one byte at a time."""
        size = np.array([len(w) for w in words])
        n, width = len(words), int(size[0])
        chars = np.zeros((width + 1, n), np.uint8)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        chars[np.arange(len(flat)) - np.repeat(start, size), np.repeat(np.arange(n), size)] = flat
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((width + 1, n), np.int32)  # state of the last piece, or minus the bytes of an uncovered character
        state = np.zeros(n, np.int32)
        char_start = np.zeros(n, np.int64)
        alive = np.searchsorted(-size, -np.arange(width), side="left")  # words longer than pos
        rows = np.arange(n)
        for pos in range(width):
            k = int(alive[pos])
            byte = chars[pos, :k]
            at = self.goto[state[:k], byte].astype(np.int32)
            state[:k] = at
            now, was = best[pos + 1], back[pos + 1]
            who, end = rows[:k], self.link[at]
            while True:
                some = end > 0
                if not some.all():
                    who, end = who[some], end[some]
                if not len(who):
                    break
                score = best[pos + 1 - self.length[end], who] + self.score[end]
                better = score > now[who]
                won = who[better]
                now[won] = score[better]
                was[won] = end[better]
                end = self.after[end]
            lead = (byte & 0xC0) != 0x80
            char_start[:k][lead] = pos
            whole = (chars[pos + 1, :k] & 0xC0) != 0x80  # zero past the end
            who = rows[:k][whole & np.isneginf(now[:k])]
            if len(who):
                now[who] = best[char_start[who], who] + self.unknown
                was[who] = char_start[who] - pos - 1
        # walk back, all words at once
        at, who, steps = size.copy(), rows, []
        while len(who):
            s = back[at[who], who]
            steps.append((who, s))
            at[who] -= np.where(s > 0, self.length[s], -s)
            who = who[at[who] > 0]
        owner = np.concatenate([w for w, _ in steps][::-1])
        states = np.concatenate([s for _, s in steps][::-1])
        by_word = np.argsort(owner, kind="stable")
        states, counts = states[by_word], np.bincount(owner, minlength=n)
        ids = np.where(states > 0, self.piece[np.maximum(states, 0)], states).astype(np.int32)
        cut = np.concatenate(([0], np.cumsum(counts)))
        packed, result = ids.tobytes(), []
        uncovered = np.add.reduceat(ids < 0, cut[:-1]) > 0
        for i, w in enumerate(words):
            got = packed[4 * cut[i]: 4 * cut[i + 1]]
            result.append(self._bytes(w, ids[cut[i]: cut[i + 1]]) if uncovered[i] else got)
        return result

    def _bytes(self, word: bytes, ids: np.ndarray) -> bytes:
        """Byte pieces in place of uncovered characters."""
        out, at = [], 0
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
                at += len(self.pieces[i])
            else:
                out.extend(self.by_byte[b] for b in word[at: at - i])
                at -= i
        return np.array(out, np.int32).tobytes()

    def encode(self, texts: Sequence) -> List:
        """Packed ids per text; None for None."""
        split = [None if t is None else self.words(t) for t in texts]
        wanted = set().union(*[s for s in split if s])
        new = [w for w in wanted if w not in self.memo]
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = list(wanted)
        self.memo.update(zip(new, self.segment(new)))
        of = self.memo.__getitem__
        return [None if s is None else b"".join(map(of, s)) for s in split]


def decode_ids(pieces: Sequence[bytes], ids: Sequence[int]) -> str:
    """The text of some ids, without the space that encoding put before it."""
    text = b"".join(map(pieces.__getitem__, ids))
    return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


_AUTOMATA: Dict[str, Automaton] = {}


def _worker_automaton(key: str, shared) -> Automaton:
    """One automaton per worker process and model."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = Automaton(shared.value)
    return _AUTOMATA[key]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL,
           decoded_col: str = "") -> DataFrame:
    """(id_col, text_col, ids): ids is array<int>.  ``decoded_col`` adds the text decoded from those ids, in the same task."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))
    names = [id_col, text_col, "ids"] + [decoded_col] * bool(decoded_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _worker_automaton(model, shared)
        for big in batches:
            for b in batches_of(big, 1 << 20):
                packed = auto.encode(b.column(1).to_pylist())
                sizes = [0 if p is None else len(p) // 4 for p in packed]
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32),
                                   mask=np.array([p is None for p in packed] + [False]))
                values = pa.array(np.frombuffer(b"".join(p or b"" for p in packed), np.int32))
                out = [b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, values)]
                if decoded_col:
                    out.append(pa.array([None if p is None else decode_ids(auto.pieces, np.frombuffer(p, np.int32).tolist())
                                         for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names)

    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    kind = src.schema[0].dataType.simpleString()
    more = f", `{decoded_col}` string" if decoded_col else ""
    return src.mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string, ids array<int>{more}")


def decode(tokens: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str = DEFAULT_MODEL) -> DataFrame:
    """The input with ``out_col``: the text of its ids."""
    vocabulary = load_vocabulary(model)
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary[0])

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        return pd.Series([None if x is None else decode_ids(shared.value, x.tolist()) for x in ids], dtype=object)

    return tokens.withColumn(out_col, text(F.col(ids_col)))
