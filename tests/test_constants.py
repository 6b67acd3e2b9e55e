"""Constant tables keep every character."""

from __future__ import annotations

from lintlake.functions.constants import contains_any, index_literal, rows_literal, sql_literal, texts_literal

from pyspark.sql import functions as F

TEXTS = ["", "plain", "it's", 'say "x"', r"\d+\\ A \%", "${SECRET} $0 ${env:HOME}", "line\nbreak\ttab", "ünï ￿ 😀", "a--b /* c */"]


def test_texts_survive(spark):
    assert spark.range(1).select(texts_literal(TEXTS).alias("t")).collect()[0].t == TEXTS
    rows = spark.range(1).select(rows_literal([{"a": t, "n": i, "l": [t], "z": None} for i, t in enumerate(TEXTS)]).alias("r"))
    assert [(r.a, r.n, r.l, r.z) for r in rows.collect()[0].r] == [(t, i, [t], None) for i, t in enumerate(TEXTS)]
    keys = {t: i for i, t in enumerate(TEXTS)}
    assert spark.range(1).select(index_literal(keys).alias("m")).collect()[0].m == keys
    assert sql_literal(True) == "true" and sql_literal(3) == "3"


def test_contains_any_takes_words_literally(spark):
    frame = spark.createDataFrame([("a.b",), ("axb",), ("***",)], "t string")
    assert [r.x for r in frame.select(contains_any(F.col("t"), ["a.b", "***"]).alias("x")).collect()] == [True, False, True]
