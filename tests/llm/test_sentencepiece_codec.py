import numpy as np
import pytest

from cohortlens.llm import sentencepiece_codec as C

from .conftest import edge_rows


@pytest.fixture(scope="module")
def auto():
    return C.Automaton(C.load_vocabulary())


def best_score(auto, scores, word):
    """Best sum of scores over all segmentations, by trying every piece at every place."""
    by_piece = {}
    for i, p in enumerate(auto.pieces):
        if p and scores[2][i] == 0:
            by_piece[p] = max(by_piece.get(p, -np.inf), scores[1][i])
    best = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - 70), end):
            if word[start:end] in by_piece:
                best[end] = max(best[end], best[start] + by_piece[word[start:end]])
        if best[end] == -np.inf and (end == len(word) or word[end] & 0xC0 != 0x80):
            start = end - 1
            while word[start] & 0xC0 == 0x80:
                start -= 1
            best[end] = best[start] + auto.unknown
    return best[-1]


def test_viterbi_is_optimal(auto, texts):
    vocabulary = C.load_vocabulary()
    words = sorted({w for t in list(texts.values())[:40] for w in auto.words(t)})[:1500] + [b" \xe2\x96\x81x", "日本\U0001F600".encode(), b"    ", b"a" * 300]
    for w, packed in zip(words, auto.segment(words)):
        ids = np.frombuffer(packed, np.int32).tolist()
        assert b"".join(auto.pieces[i] for i in ids) == w
        cost, at = 0.0, 0
        while at < len(ids):
            if vocabulary[2][ids[at]] == 1:  # byte pieces of one uncovered character
                size = len(bytes(b for i in ids[at:at + 4] for b in auto.pieces[i]).decode(errors="ignore")[:1].encode())
                cost, at = cost + auto.unknown, at + size
            else:
                cost, at = cost + vocabulary[1][ids[at]], at + 1
        assert abs(cost - best_score(auto, vocabulary, w)) < 1e-3, w


def test_same_segmentation_score_as_the_library(auto, texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(C.DEFAULT_MODEL, "rb").read())
    proto.trainer_spec.model_type = 1  # the library's own Viterbi over the same pieces
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    score = [p.score for p in proto.pieces]
    for t in [x[:60].split("\n")[0].strip() for x in texts.values()][:150]:
        if t and t.isascii() and "  " not in t:
            ours = np.frombuffer(auto.encode([t])[0], np.int32).tolist()
            theirs = library.encode(t)
            assert sum(score[i] for i in ours) >= sum(score[i] for i in theirs) - 1e-6 * abs(sum(score[i] for i in theirs)) - 0.5


def test_round_trip(documents, edge, empty):
    for docs, n in ((documents, documents.count()), (edge, len(edge_rows()))):
        tokens = C.encode(docs)
        both = C.decode(tokens).collect()
        assert len(both) == n
        assert all(r["decoded"] == r["text"] for r in both)
        assert all((r["ids"] is None) == (r["text"] is None) for r in both)
        one_pass = C.encode(docs, decoded_col="decoded").collect()
        assert all(r["decoded"] == r["text"] for r in one_pass)
    assert C.decode(C.encode(empty)).collect() == []


def test_memo_bound(auto, monkeypatch):
    monkeypatch.setattr(C, "MEMO_WORDS", 5)
    few = C.Automaton(C.load_vocabulary())
    text = "one two three four five six seven eight nine ten"
    assert few.encode([text, text, None, ""])[0] == auto.encode([text])[0]


def test_pieces_across_words_are_refused():
    with pytest.raises(ValueError):
        C.Automaton(([b"a b"], [0.0], [0], [0] * 256))
