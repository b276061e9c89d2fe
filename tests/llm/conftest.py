import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp string, `row` string, row_sha string, gone_id string, Row_Hash string, `a.b` string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows and ids, a very long text, and clashing extra names."""
    rows = [
        (1, "a b c d e", "en", "s", 1, "x", "r"),
        (1, "a b c d e", "en", "s", 1, "x", "r"),
        (1, "A b c d e", "en", "s", 1, "x", "r"),
        (None, "a b c d e", None, None, None, None, None),
        (2, None, None, None, None, None, None),
        (3, "", "en", None, None, None, None),
        (4, " \n\t ", "en", None, None, None, None),
        (5, "hello world " * 20000, "en", "s", 3, "1", "z"),
        (6, "été naïve 日本語 Привет 😀", "fr", "s", 3, "1", "z"),
        (6, "another text under the same id", "en", "s", 3, "1", "z"),
    ]
    return spark.createDataFrame([(*r, "sha", "gone", "hash", "dot") for r in rows], DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
