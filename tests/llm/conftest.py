import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, fp string, tier int, root string"


def edge_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    words = "The quick brown fox jumps over the lazy dog near a quiet river bank".split()
    long = " ".join(words[i * i % 13] + str(i % 97) for i in range(12_000))
    texts = [None, "", " \n\t ", "one", "one two", "one two three", "A-Z ÄÖÜ ß é", "tail  spaces \n\n here ", long, "x" * 30_000, "日本語 テキスト", "don't stop now"]
    rows = [(i, t, "en", "s", 1, 2, "z", 3, "r") for i, t in enumerate(texts)]
    rows += [(100, "same text again", "en", "s", 1, 2, "z", 3, "r")] * 3
    rows += [(101, "same text again", None, None, None, None, None, None, None), (None, "no id", "en", "s", 1, 2, "z", 3, "r"), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    """The smallest documents table, as Spark and as Python rows."""
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return frame, [tuple(r) for r in frame.select("doc_id", "text").collect()]
