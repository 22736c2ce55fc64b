import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "word"), (None, "a null id has a text of its own here"),
    (5, "the same text twice"), (5, "the same text twice"), (6, "the same text twice"), (7, LONG), (8, LONG + " more"),
    (9, "é日本語🎉 Größe ÀÉ \u00a0nbsp\u2003 \u0085 end"), (10, "x" * 50_000), (11, "\n\n\n"),
]


@pytest.fixture
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows, signs of all widths."""
    return spark.createDataFrame(ODD, "doc_id long, text string")


@pytest.fixture
def clashing(spark):
    """The columns of documents with others named like those the operators make."""
    names = "n_words int, row int, id int, v int, b int, c int, rid int, first int, n int, text_ int, gone int, pos int, host int, quality int, _null int, rest int, signature int, removed int, chunks int"
    rows = [(i, t, "en", None, None, *([i] * 19)) for i, t in [(1, "one two three\nfour five"), (2, None), (3, ""), (4, " ".join(f"t{i}" for i in range(80)))]]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
