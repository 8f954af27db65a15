import random

import pytest

SF = "/root/testdata/sf0.001"


def edge_rows():
    """(doc_id, text): nulls, empty, white space, ties, repeated rows, a shared id, very long texts, odd characters."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 9)))
    long_text = " ".join(word() for _ in range(40_000))
    passage = " ".join(word() for _ in range(60))
    return [
        (None, None), (None, "A null id, with a line of more than twenty characters"), (1, ""), (2, None), (3, " \t\n  \n"),
        (4, long_text), (5, long_text + " end"), (6, "x" * 50_000), (7, "ab " * 20_000),
        (8, passage), (8, passage), (9, passage + "\n" + passage), (10, "Start " + passage.upper() + " stop"),
        (11, "One line that is long enough to count\nshort\nOne line that is long enough to count"),
        (12, "  one LINE that is long enough to count \nother"), (13, "One line that is long enough to count\r"),
        (14, "é" * 30 + " \u2581 \u3000 \U0001F600 ß İ"), (15, passage), (15, "another text under the same id"),
        (16, "a@b.c, 1.2.3.4, card 4111 1111 1111 1111, +1 (555) 123-4567, DE89 3704 0044 0532 0130 00"), (17, "\x01\x00 \x0b\x0c"),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge rows with extra columns whose names clash with those the operators make."""
    clash = ["_id", "_text", "_row", "_kept", "_gone", "id", "h", "fp", "key", "ids", "score", "spans", "failed", "n_words", "kept",
             "component_id", "lang", "source", "n_chars"]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash)
    return spark.createDataFrame([(i, t, *["clash"] * len(clash)) for i, t in edge_rows()], schema)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}
