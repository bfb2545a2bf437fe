"""Tables that the operators of this folder must stand."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark_items(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties and clashing names."""
    long_text = " ".join(f"word{i % 997} tale{i}" for i in range(40_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, "one", "en", None, 3), (4, "one", "en", None, 3), (5, "one", "de", "b", 3),
        (None, "a text without a key and some more words in it", "en", "b", 10), (None, None, None, None, None), (7, long_text, "en", "c", len(long_text)),
        (8, "naïve café — 日本語 \u0000 tail", "fr", "c", 20), (9, long_text + " end", "en", "c", len(long_text) + 4),
    ]
    extra = [(*r, i, f"x{i}", i, "s", 0.5) for i, r in enumerate(rows)]
    return spark.createDataFrame(extra, DOCS + ", size int, shard string, slot int, label string, score double")
