import pytest


def frame(spark, texts, extra=True):
    """Documents from texts, with the usual columns and some whose names operators use themselves."""
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}" if i % 7 else None, len(t or ""), -1, "x", 0.5) for i, t in enumerate(texts)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, names + ", n_words long, shard string, score double")
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, extra=True: frame(spark, texts, extra)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


EDGE_TEXTS = [None, "", " \n\t ", "one", "a b", "word " * 30_000, "same text here again", "same text here again", "A!b?c.\n\nÄ ö ü 🙂", "|||", "\x00\x0b"]


@pytest.fixture(scope="session")
def edge_texts():
    return EDGE_TEXTS
