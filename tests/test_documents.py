"""Documents of a whole run, written in ranges and put together again."""

from __future__ import annotations

import glob
import json

import pytest
from pyspark.sql import functions as F

from lintlake.functions.severity import AGENTS
from lintlake.operators.consensus import consensus
from lintlake.operators.ordering import in_ranges, with_previous, with_total_before
from lintlake.operators.review import review
from lintlake.plans import documents
from workload import corpus as tables
from workload.queries import RUN_TIME

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark):
    return review(tables.scannable(spark, SF)).persist()


def text_of(folder):
    return "".join(open(part).read() for part in sorted(glob.glob(f"{folder}/part-*")))


@pytest.mark.parametrize("rows", [0, 1, 500])
def test_carried_values(spark, rows):
    frame = spark.range(rows).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"), "id",
        (F.col("id") % 5).alias("n")).repartition(7)
    ranged = in_ranges(frame, ["k", "id"], "carried")
    placed = with_total_before(with_previous(ranged, ["k", "id"], "id", "before"), [], ["k", "id"], F.col("n"), "total")
    by_key = with_total_before(ranged, ["k"], ["id"], F.lit(1), "number")
    expected = sorted((r["k"], r["id"], r["n"]) for r in frame.collect())
    total, before, want, numbers = 0, None, {}, {}
    for k, i, n in expected:
        want[i] = (before, total)
        numbers[i] = sum(o == k and j < i for o, j, _ in expected)
        before, total = i, total + n
    assert {r["id"]: (r["before"], r["total"]) for r in placed.collect()} == want
    assert {r["id"]: r["number"] for r in by_key.collect()} == numbers


def test_run_document_is_json(spark, found, tmp_path):
    agreed = consensus(found)
    document = documents.run_document(found, agreed, RUN_TIME, 2.5)
    documents.write_run_document(document, str(tmp_path / "run"))
    parsed = json.loads(text_of(tmp_path / "run"))
    assert parsed["metadata"]["duration_seconds"] == 2.5 and parsed["metadata"]["scan_date"] == RUN_TIME
    assert parsed["metadata"]["statistics"] == {a: found.where(F.col("agent") == a).count() for a in AGENTS}
    rows = [(repo, path, f["line_number"], f["severity"], f["evidence"], f["consensus_level"], tuple(f["agreeing_agents"]))
            for repo, files in parsed["findings"].items() for path, findings in files.items() for f in findings]
    assert sorted(rows) == sorted(
        (r["repo"], r["path"], r["line_number"], r["severity"], r["evidence"], r["consensus_level"], tuple(r["agreeing_agents"]))
        for r in agreed.collect())
    assert [r["position"] for r in document.orderBy("position").collect()] == list(range(document.count()))


def test_names_are_escaped_and_nothing_is_a_document(spark, found):
    odd = consensus(found).limit(3).withColumn("repo", F.lit('a"b\\c')).withColumn("path", F.lit('x"\ny'))
    for agreed in (odd, odd.limit(0)):
        parts = documents.run_document(found, agreed, RUN_TIME, 0.0).orderBy("position").collect()
        parsed = json.loads("".join(r["value"] for r in parts))
        assert list(parsed["findings"]) == (['a"b\\c'] if len(parts) > 2 else [])
        assert all(list(files) == ['x"\ny'] for files in parsed["findings"].values())


def test_listing_lines_are_where_they_are_said_to_be(spark, found, tmp_path):
    listing = documents.reviewer_listing(found, RUN_TIME)
    documents.write_listing(listing, str(tmp_path / "listing"))
    for agent in AGENTS:
        lines = text_of(tmp_path / "listing" / f"agent={agent}").split("\n")
        for r in listing.where(F.col("agent") == agent).collect():
            first = r["first_line"] - 1
            assert lines[first:first + r["n_lines"]] == r["value"].split("\n")
        assert lines[0] == f"Reviewer: {agent}"
        assert sum(line.startswith("   Evidence: ") for line in lines) == found.where(F.col("agent") == agent).count()


def test_listing_without_findings(spark, found):
    rows = documents.reviewer_listing(found.limit(0), RUN_TIME).collect()
    assert {(r["agent"], r["first_line"], r["n_lines"]) for r in rows} == {(a, 1, 3) for a in AGENTS}
