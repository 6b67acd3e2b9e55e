from __future__ import annotations

import pytest

ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 3), (4, "one", "en", None, None),
    (None, "no id here", "en", "b", 10), (5, "same text twice " * 30, "en", "b", 480),
    (5, "same text twice " * 30, "en", "b", 480), (6, "same text twice " * 30, "en", "c", 480),
    (7, "x" * 200_000, "en", "a", 200_000), (8, "long words and many of them " * 8_000, "en", "a", 224_000),
    (9, "Ünïcödé 日本語 😀 ▁ <s> </s> \0 end", "xx", "a", 40),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties and repeated rows, and columns whose names clash."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ODD, SCHEMA)
    return frame.withColumns({c: F.lit("clash") for c in ("id", "t", "score", "fp", "shard", "bin", "row", "h")})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (2, 0, 0), (5, 1, 0), (8, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
