import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, hub long, key string"

    def make(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 7, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def labels_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, T.StructType.fromDDL("doc_id long, quality int, toxic int"))

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """NULL and empty texts, blanks, one word, repeated rows, a long word, a very long text, other scripts."""
    base = " ".join(f"word{i % 97} and{i % 31}" for i in range(120))
    return [
        None, "", " \n\t", "one", "two words", base, base, base + " more", base.upper(), "x" * 5000, "ab " * 20000,
        "Größe 漢字 naïve x", "don't we'll <|endoftext|> 12  3\n\n", "THE!! END!! NOW!!", "a|b|c",
    ]
