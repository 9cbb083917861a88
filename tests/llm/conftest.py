import pytest

#: Beside the columns of documents, names that operators use for their results, in other cases too.
MORE = ["_r", "w", "r", "t", "_q", "_M", "_p", "_L", "_text", "N_TOKENS", "Score", "Token_Tree", "KEPT", "Class_Id", "node", "row", "edits_", "verdict", "Key"]
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in MORE)
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 6000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a very long text, and columns with names that operators use."""
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n\t", None, "b"), (4, "Hello MIT License", "en", "a"), (4, "Hello MIT License", "en", "a"),
            (5, "hello mit license", "en", "a"), (None, "no id", "fr", "b"), (7, LONG, "de", "b"), (8, "日本語 😀 a@b.co +1 (555) 123-4567", "ja", "c")]
    return spark.createDataFrame([(*r, *MORE) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (7, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
