import pytest


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="module")
def benchmark_items(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, clashing columns."""
    long = "word " * 60_000 + "end."
    rows = [
        (1, None, None, "a", None, "x", 1.0, 1),
        (2, "", "en", None, 0, "x", 2.0, 1),
        (3, "   \n\t ", "en", "a", 6, None, None, None),
        (4, long, "en", "a", len(long), "x", 1.0, 1),
        (5, "one two three four five six seven", "en", "a", 1, "x", 1.0, 1),
        (5, "one two three four five six seven", "en", "a", 1, "x", 1.0, 1),
        (6, "one two three four five six seven", "en", "b", 1, "x", 1.0, 1),
        (None, "one two three four five six seven", None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None),
        (7, "hi", "en", "a", 2, "x", 1.0, 1),
        (8, "***!!! 123 ...", "de", "a", 3, "x", 1.0, 1),
        (9, "\U0001f600 İß́ ▁ <|endoftext|> \x00", "de", "a", 3, "x", 1.0, 1),
    ]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, class string, score double, id int",
    )


@pytest.fixture(scope="module")
def odd_labels(spark):
    rows = [(5, 1, 1, "x"), (6, 0, 0, "x"), (None, 1, 1, "x"), (7, None, None, "x"), (7, 1, 0, None), (2, 1, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
