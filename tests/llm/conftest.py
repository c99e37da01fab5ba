import pytest


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of given texts, with further columns whose names operators use themselves."""

    def make(texts, ids=None):
        rows = [(i, t, 1, "x", 2.0, "y") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, row long, v string, score double, entities string")

    return make
