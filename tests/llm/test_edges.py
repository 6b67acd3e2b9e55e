"""Every operator on odd rows and on an empty table: a defined result, and nobody is lost."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lintlake.llm import (
    decontamination, licenses, line_rules, line_runs, lm_scoring, packing, personal, quality, sharding, simhash, token_counts)
from tests.llm.conftest import ODD, SCHEMA

IDS = sorted((r[0] for r in ODD), key=lambda x: (x is None, x))


def operators(spark, labels):
    benchmark = spark.createDataFrame(
        [(1, "long words and many of them long words and many of them"), (2, None), (3, ""), (None, "x"), (4, "one")],
        "item_id long, text string")
    return {
        "lm": lm_scoring.scores,
        "tokens": token_counts.token_counts,
        "shards": sharding.shards,
        "pack": packing.pack_documents,
        "decontaminate": lambda d: decontamination.contaminated(d, benchmark),
        "quality": lambda d: quality.quality(d, labels),
        "licenses": licenses.license_scan,
        "simhash": simhash.near_duplicates,
        "personal": lambda d: personal.personal_data(d, personal.fit_judge(d)),
        "lines": line_rules.line_quality,
        "runs": line_runs.without_frequent_lines,
    }


NAMES = ["lm", "tokens", "shards", "pack", "decontaminate", "quality", "licenses", "simhash", "personal", "lines", "runs"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, labels, name):
    rows = operators(spark, labels)[name](odd).collect()
    if name == "pack":
        rows = [r for r in rows if r["piece"] == 0]
    assert sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x)) == IDS
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    if name == "lm":
        assert by[1][0]["n_tokens"] == by[2][0]["n_tokens"] == by[3][0]["n_tokens"] == 1 and all(r["score"] < 0 for r in rows)
    if name == "tokens":
        assert by[1][0]["n_tokens"] == by[2][0]["n_tokens"] == 0 and by[8][0]["over_limit"]
    if name == "shards":
        sizes = {}
        for r in rows:
            sizes.setdefault(r["shard"], []).append(r["slot"])
        assert sorted(map(len, sizes.values())) == [1] * 5 + [2] * 3
        assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
        assert by[1][0]["size"] == 1 and by[1][0]["text_crc32"] == 0
    if name == "pack":
        assert len({r["bin"] for i in (5, 6) for r in by[i]}) == 3
    if name == "decontaminate":
        assert by[8][0]["items"] == [1] and by[4][0]["items"] == [4] and not by[1][0]["contaminated"]
    if name == "simhash":
        assert {r["component_id"] for i in (5, 6) for r in by[i]} == {5}
        assert by[1][0]["fingerprint"] == "0" * 16 and by[3][0]["component_id"] == 1
    if name == "quality":
        assert by[1][0]["score"] == by[2][0]["score"] and by[None][0]["held_out"] is False
    if name == "personal":
        assert by[1][0]["spans"] == "" and by[1][0]["redacted"] is None and by[2][0]["redacted"] == ""
    if name == "lines":
        assert by[1][0]["base_failed"] and not by[1][0]["kept"] and by[1][0]["n_words"] == 0
        assert by[5][0]["n_repeat_words"] == 90
    if name == "runs":
        assert (by[1][0]["n_lines"], by[1][0]["n_dropped"], by[1][0]["kept"]) == (1, 0, "") and by[3][0]["n_lines"] == 2


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(spark, nothing, labels, name):
    assert operators(spark, labels)[name](nothing).collect() == []


def test_quality_without_labels(spark, odd, labels):
    assert {r["score"] for r in quality.quality(odd, labels.limit(0)).collect()} == {0.5}


def test_stages_on_odd_rows(spark, odd, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = odd.select(SCHEMA.replace(" long", "").replace(" string", "").split(", "))
    for name, stage in corpus_pipeline.STAGES:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == docs.columns or name == "packing"
            assert out.count() <= frame.count() or name == "packing"
    ids = [r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert ids.count(5) == 1 and 6 not in ids and None in ids and 7 in ids


def test_pipeline_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, sf)
    lost = docs.join(kept, "doc_id", "left_anti").join(labels, "doc_id")
    assert lost.where("quality = 1").count() <= 0.02 * labels.count()
    assert docs.join(labels.where("quality = 0"), "doc_id").join(lost, "doc_id", "left_anti").count() <= 2
    packed = corpus_pipeline.run(spark, sf)
    assert packed.groupBy("bin").agg(F.sum("length").alias("n")).where(F.col("n") > packing.CAPACITY).count() == 0
