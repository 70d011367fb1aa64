import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, row string, node string, label string, key string, n string, t string"


def document_rows():
    """Nulls, empty and very long texts, ties, repeated rows, columns that clash with internal names."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    texts = [None, "", "   ", "one two", "one two", "One Two", "a b c d e f g h i j", "a b c d e f g h i j", "é漢🙂 <|im_end|>", long, long + " tail", "x" * 50_000, "\n\n\n", "idiot loser scum"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one two"), (3, "one two"), (None, "a b c d e f g h i j"), (None, None), (None, "nothing else")]
    return [(i, t, None if k % 3 else "en", ("b", "a", None)[k % 3], None, "s", "r", "o", "l", "k", "n", "t") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(document_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
