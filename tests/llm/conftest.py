import pytest

#: Texts that every document operator must survive.
ODD_TEXTS = [
    None, "", " ", "\n\t", "a", "one two", "ÀÉ ß 日本語 😀", "x" * 5000, "word " * 3000, " " * 3000,
    "same text here", "same text here", "<|endoftext|> </s> \x00 \x1c\x85 ▁", "!!! ### $$$", "\n".join(["line"] * 50),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with null and repeated ids, and columns whose names operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, i, "a", "b", float(i)) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id", None, 0, "a", "b", 0.0), (None, None, None, 0, "a", "b", 0.0), rows[3], rows[3]]
    schema = "doc_id long, text string, lang string, id long, key string, _text string, score double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(i, i % 2, (i + 1) % 2) for i in range(15)] + [(None, 1, 1), (3, None, None)],
        "doc_id long, quality int, toxic int",
    )
