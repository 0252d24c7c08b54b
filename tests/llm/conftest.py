import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, shard string"


@pytest.fixture
def documents(spark):
    """Makes a table of documents, with columns whose names operators use inside."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


#: Nulls in every column, empty and blank texts, one word, ties, repeated rows, a very long text.
ODD = [
    (0, None, None, None),
    (1, "", "en", "a"),
    (2, " \n\t ", "en", "a"),
    (3, "word", None, "b"),
    (4, "the same text in two rows of the table here", "en", "b"),
    (4, "the same text in two rows of the table here", "en", "b"),
    (5, "the same text in two rows of the table here", "fr", None),
    (None, "the same text in two rows of the table here", "en", "b"),
    (None, None, None, None),
    (6, "long " * 30_000 + "ünïcode \U0001f600 end", "de", "c"),
]


@pytest.fixture
def odd(documents):
    return documents(ODD)


@pytest.fixture
def no_documents(documents):
    return documents([])
