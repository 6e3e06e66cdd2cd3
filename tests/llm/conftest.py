import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, h int, key string, id string"


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns whose
    names an operator may use itself."""
    long = " ".join(f"word{i % 977} and" for i in range(20_000))
    texts = {
        1: "one two  three\tfour\nfive six seven",
        2: "one two three four five six seven",
        3: None,
        4: "",
        5: long,
        6: long,
        7: "   ",
        8: "ünï ▁ code <|endoftext|> </s> 日本語   x",
        9: "a",
        10: "don't  stop\r\n\r\n\tnow ",
    }
    rows = [(k, v, None, "s", None, "x", 1, None, "y") for k, v in texts.items()]
    return spark.createDataFrame(rows + [rows[0], rows[2]], DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
