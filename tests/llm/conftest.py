import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """A small (id, text) table of awkward texts: null, empty, wordless, repeated, long, non-Latin."""
    texts = [
        None, "", " \n\t ", "...", "Hello World", "hello world", "HELLO world", "日本語のテキスト", "don't we'll '' 've",
        "<|endoftext|> and <|endoftext|>", "word " * 30_000, "a" * 50_000, "x", "émile Ärger", "A\x00B",
    ]
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string"), texts


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "id long, text string")
