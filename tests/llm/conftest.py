import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, ties, a very long text, clashing column names."""
    long = " ".join(f"word{i % 997} goes on." for i in range(20_000))
    plain = "The first sentence has words. The second one has more of them! Does a third one follow here? It does so now."
    rows = [
        (1, plain, "en", "a", 1),
        (1, plain, "en", "a", 1),
        (2, plain, None, None, None),
        (3, None, "en", None, 2),
        (None, "no id here, but a text of some words", "de", "b", 3),
        (None, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \n\t ", "en", "a", 4),
        (6, long, "en", "a", len(long)),
        (7, "ünï日本 \U0001f600 <s> <|endoftext|>  two  spaces\n\n 12kg %%%", "fr", "a", 9),
        (8, "x", "en", "c", 1),
        (1, "another text under the same id", "en", "c", 1),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    names = ("keys", "node", "words", "size", "ids", "label", "at", "hash", "run", "key", "upper", "__row")
    return frame.selectExpr("*", *[f"'clash' AS `{n}`" for n in names])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 9)] + [(None, 1, 1), (9, None, None), (1, 1, 0), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sample():
    return "/root/testdata/sf0.01"
