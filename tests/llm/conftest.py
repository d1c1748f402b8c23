import pytest


@pytest.fixture
def documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns that clash with results."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en" if k % 3 else None, f"src{k % 4}", 1, 7, "x") for k, (i, t) in enumerate(zip(ids, texts))]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, fp int, kept string")

    return make


@pytest.fixture
def awkward():
    return [None, "", " \n\t ", "one", "a b c", "Same words here again " * 20, "Same words here again " * 20, "é ü ß 日本 👍🏽 " * 30, "long " * 60_000, "\n\n".join(["line of text"] * 40), "#### $$$$ |||| <<<< " * 20]
