import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def documents(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


ODD_TEXTS = [
    (1, "the cat sat on the mat and the dog ran off"),
    (1, "the cat sat on the mat and the dog ran off"),
    (2, None),
    (None, "a row without an id"),
    (3, ""),
    (4, " \t\n "),
    (5, "x"),
    (6, "The CAT sat on the mat, and the dog ran off!"),
    (7, "word " * 120_000),
    (8, "12345 67890 --- ... 　 \U0001f600"),
    (9, "tab\tline\nfeed  two spaces ▁marker <|endoftext|> <s> é ß ﬁ 'tis we'll"),
    (10, "x" * 50_000),
    (11, " lead"),
    (12, "trail "),
    (13, "a"),
    (14, " "),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, repeats, very long texts and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "kept", k, 0.5) for k, (i, t) in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, key int, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
