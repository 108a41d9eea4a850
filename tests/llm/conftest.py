import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "Plain words of a text, and <|endoftext|> inside it.", "en", "a", 10),
        (1, "Plain words of a text, and <|endoftext|> inside it.", "en", "a", 10),
        (2, None, None, None, None),
        (3, "", "de", "b", 0),
        (4, " \n\t ", "en", "b", 4),
        (None, "a row without an id", None, "a", None),
        (5, "Σας ΣΑΣ İx ﬁ é ½ 日本語 😀\x00\x1c  don't", "el", None, 30),
        (6, "word " * 40_000 + "x" * 30_000, "en", "a", None),
        (7, "!" * 5_000, "en", "a", 5_000),
        (7, "another text with the same id", "en", "a", 29),
    ]
    extra = "score string, predicted string, n_tokens string, component_id string, fingerprint string, copy_no string, rate string"
    extra += ", lang_pred string, span string, tie string, payload string, _of_text string, shuffle_key string"
    full = [(*r, *["x"] * 13) for r in rows]
    return spark.createDataFrame(full, f"{DOCS}, {extra}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
