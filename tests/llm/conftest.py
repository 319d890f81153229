
import pytest

#: null, empty, blank, one-word, multi-byte and repeated texts
ODD = [None, "", "  \n", "word", "Ünïcödé 日本語 текст", "word", "a" * 3000, "ab " * 2000]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with null and repeated ids, a null source, and columns named as operators name theirs."""
    rows = [(i, t, "en" if i % 2 else None, None, None, "x", 1.0, 2) for i, t in enumerate(ODD)]
    rows += [(None, "word", None, None, None, "x", 1.0, 2), (3, "word", "en", None, None, "x", 1.0, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double, n_tokens int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
