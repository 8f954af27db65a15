import hashlib

import numpy as np
import pytest

from cohortlens.llm import suffix_dedup as S

from .conftest import edge_rows


def brute(docs):
    """{(id, text): (bytes, removed, runs, sha)}; rows of one id form one document, identical rows count once."""
    seen, out = {}, {}
    rows = sorted({(i, t or "") for i, t in docs}, key=lambda x: (x[0] is not None, x[0] or 0))
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(t)
    for i in by_id:
        raws = sorted((t.encode() for t in by_id[i]), key=S.text_tag)
        gone = [bytearray(len(b)) for b in raws]
        places = sorted((p, r) for r, b in enumerate(raws) for p in range(len(b) - S.LENGTH + 1))
        for p, r in places:
            w = raws[r][p:p + S.LENGTH]
            if w in seen:
                gone[r][p:p + S.LENGTH] = b"\1" * S.LENGTH
            else:
                seen[w] = (i, p)
        for b, g in zip(raws, gone):
            rest = bytes(c for c, f in zip(b, g) if not f)
            runs = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
            out[(i, b)] = (len(b), sum(g), runs, hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_against_every_window(documents, texts, batches):
    want = {i: v for (i, _), v in brute(texts.items()).items()}
    got = S.remove_repeats(documents, batches=batches, digest=True).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_edges(edge):
    table = brute(edge_rows())
    want = sorted((str(i), *table[(i, (t or "").encode())]) for i, t in edge_rows())
    got = S.remove_repeats(edge, digest=True).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_kept_bytes_and_empty(documents, texts, empty):
    got = S.remove_repeats(documents.where("doc_id < 30")).collect()
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)
    assert S.remove_repeats(empty).collect() == []


def test_levels_merge_like_a_binary_counter(spark, documents, monkeypatch):
    """Only levels of equal size merge: the files of the others stay the same, and no entry stands in two levels."""
    monkeypatch.setattr(S, "TASK_BYTES", 1 << 16)
    src = documents.selectExpr("doc_id as id", "text")
    parts, size = S.id_batches(src, 5)
    index = S.SuffixIndex(size)
    assert size == sum(len(r["text"].encode()) for r in documents.collect()) and index.parts > index.buckets > 4
    sizes, files = [], []
    for part in parts:
        index.ingest(part)
        sizes.append([n for n, _ in index.levels])
        files.append([sorted(level.inputFiles()) for _, level in index.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    assert files[1][0] == files[2][0] and files[3][0] == files[4][0]
    entries = []
    for _, level in index.levels:
        for r in level.collect():
            e = S.unpack(r["payload"], S.ENTRY)
            assert (np.diff(e["key"].astype(np.float64)) >= 0).all()
            entries += zip(e["key"].tolist(), e["sk"].tolist())
    assert len(entries) == len(set(entries)) > 1000


@pytest.mark.parametrize("batches", [1, 5])
def test_many_shards_and_buckets(documents, texts, batches, monkeypatch):
    monkeypatch.setattr(S, "TASK_BYTES", 1 << 16)
    want = {i: v for (i, _), v in brute(texts.items()).items()}
    got = S.remove_repeats(documents, batches=batches, digest=True).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for kind, fields in S._FIELDS.items():
        block = {f: rng.integers(0, 1 << (8 * w - 1), 50).astype(np.uint64) for f, w in fields}
        back = S.unpack(S.pack(block, kind), kind)
        assert all((back[f] == block[f]).all() for f in block)


def test_pieces_of_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(S, "_PIECE", 1000)
    monkeypatch.setattr(S, "_PLACE_BITS", 12)
    import pyarrow as pa

    raw = np.random.default_rng(2).integers(97, 123, 9000).astype(np.uint8).tobytes().decode()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([raw])], ["id", "text"])
    windows = np.concatenate([np.concatenate([np.arange(p >> 16, (p >> 16) + n) for p, n in zip(e["pos"].tolist(), e["n"].tolist())])
                              for e, _ in S._entries(batch)])
    assert sorted(windows.tolist()) == list(range(9000 - 99))


def test_many_rows_without_an_id(spark):
    rng = np.random.default_rng(6)
    word = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    docs = []
    for k in range(1500):  # each repeats a passage of its own, at places that differ from row to row
        passage = word(130)
        docs.append((None, word(k % 50) + passage + word(20 + k % 70) + passage + word(10)))
    table = brute(docs)
    want = sorted(table[(i, t.encode())] for i, t in docs)
    got = S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), digest=True).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
