import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, rid bigint, key binary, digest binary, spans string, part int"


@pytest.fixture(scope="session")
def make_docs():
    """Documents from texts; the extra columns have names that operators use inside."""

    def make(spark, texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        langs = langs or ["en"] * len(texts)
        rows = [(i, t, lang, "s", None if t is None else len(t), 0.5, 7, b"k", b"d", "x", 3) for i, t, lang in zip(ids, texts, langs)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge_texts():
    """Null, empty, blank, repeated and very long texts, and one with unusual characters."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    return [None, "", " \n\t ", "same text here for all of us", "same text here for all of us", long, "é 日本 \U0001f600 x\u00a0y <|endoftext|>", "a" * 50_000, "."]
