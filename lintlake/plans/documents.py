"""Documents of a whole run: reviewers' listings and the JSON report.

A document is a table of blocks with their places; no task holds more than one
range of it, and its text is the written parts one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.reasoning import summary_text
from lintlake.functions.severity import AGENTS, SEVERITIES
from lintlake.operators.consensus import enrich
from lintlake.operators.ordering import in_ranges, with_previous, with_total_before
from lintlake.operators.review import REPORT_ORDER
from lintlake.plans.audit import findings_by_file, run_metadata
from lintlake.plans.reports import reviewer_totals

INDENT = "   "


def _lines(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit(""))) + 1


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{INDENT}{label}: "), value)


def listing_heads(findings: DataFrame) -> DataFrame:
    """``agent, value``: what each reviewer found in all; severities without findings are left out."""
    agents = findings.sparkSession.range(1).select(F.explode(F.array(*[F.lit(a) for a in AGENTS])).alias("agent"))
    totals = agents.join(reviewer_totals(findings), "agent", "left").fillna(0)
    severities = [F.when(F.col(s.lower()) > 0, F.format_string(f"{s}: %d", s.lower())) for s in SEVERITIES[:4]]
    return totals.select("agent", F.concat_ws(
        "\n", F.concat(F.lit("Reviewer: "), "agent"), F.format_string("Files with findings: %d", "files"),
        F.format_string("Issues: %d", "issues"), *severities).alias("value"))


def listing_blocks(findings: DataFrame, generated_at: str) -> DataFrame:
    """``agent, repo, path, value``: the findings of one reviewer in one file, numbered from 1, most severe first.

    The permission reviewer's findings come with a summary of their reasoning.
    A file is the largest group collected here.
    """
    rich = enrich(findings, generated_at, ["permission"])
    told = F.when(F.col("cot").isNotNull(), summary_text(F.col("cot")))
    indented = F.concat(F.lit(INDENT), F.replace(told, F.lit("\n"), F.lit(f"\n{INDENT}")))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("["), "severity", F.lit("] "), "category"),
        _labelled("Line", F.col("line_number").cast("string")),
        _labelled("Confidence", F.col("confidence")),
        _labelled("Evidence", F.col("evidence")),
        _labelled("Recommendation", F.col("recommendation")),
        _labelled("Reference", F.col("ref_primary")),
        _labelled("See also", F.col("ref_secondary")),
        indented)
    entries = rich.select("agent", "repo", "path", F.struct(*REPORT_ORDER, text.alias("text")).alias("entry"))
    grouped = entries.groupBy("agent", "repo", "path").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    numbered = F.transform("entries", lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["text"]))
    return grouped.select("agent", "repo", "path", F.concat(
        F.lit("File: "), "path", F.lit("\n"), F.array_join(numbered, "\n")).alias("value"))


def reviewer_listing(findings: DataFrame, generated_at: str) -> DataFrame:
    """The reviewers' reports in blocks: ``agent, repo, path, first_line, n_lines, value``.

    Each report starts with its head, whose file is null, at line 1; then come
    the files by repository and path.  A reviewer without findings has its head.
    """
    none = F.lit(None).cast("string")
    heads = listing_heads(findings).select("agent", none.alias("repo"), none.alias("path"), "value")
    blocks = heads.unionByName(listing_blocks(findings, generated_at))
    order = ["agent", "repo", "path"]
    ranged = in_ranges(blocks.withColumn("n_lines", _lines(F.col("value")).cast("long")), order, "listing")
    placed = with_total_before(ranged, ["agent"], ["repo", "path"], F.col("n_lines"), "_lines_before")
    return placed.select("agent", "repo", "path", (F.col("_lines_before") + 1).alias("first_line"), "n_lines", "value")


def write_listing(listing: DataFrame, path: str) -> None:
    """One folder for each reviewer; its parts, one after the other, are the report."""
    ordered = listing.repartitionByRange("agent", "first_line").sortWithinPartitions("agent", "first_line")
    ordered.select("agent", "value").write.mode("overwrite").partitionBy("agent").text(path)


def _key(value: Column) -> Column:
    """A JSON string."""
    listed = F.to_json(F.array(value))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def run_document(findings: DataFrame, agreed: DataFrame, run_time: str, duration_seconds: float) -> DataFrame:
    """The JSON report of a run in fragments: ``position, repo, path, value``.

    In the order of their positions, which go from 0 without gaps, the values
    are one JSON document: the run's metadata, then findings by repository and
    file.  The first and the last fragment belong to no file; without findings
    they are all there is.
    """
    none = F.lit(None).cast("string")
    head = run_metadata(findings, run_time, duration_seconds).select(
        F.lit(0).alias("section"), none.alias("repo"), none.alias("path"),
        F.concat(F.lit('{"metadata":'), "value", F.lit(',"findings":{')).alias("value"))
    files = findings_by_file(agreed).select(
        F.lit(1).alias("section"), "repo", "path",
        F.concat(_key(F.col("path")), F.lit(":"), F.to_json("findings")).alias("value"))
    tail = findings.sparkSession.range(1).select(
        F.lit(2).alias("section"), none.alias("repo"), none.alias("path"), F.lit("}}").alias("value"))
    order = ["section", "repo", "path"]
    ranged = in_ranges(head.unionByName(files).unionByName(tail), order, "run-document")
    follows = with_previous(ranged.withColumn("_open", F.struct("section", "repo")), order, "_open", "_before")
    placed = with_total_before(follows, [], order, F.lit(1).cast("long"), "position")
    opens = F.concat(_key(F.col("repo")), F.lit(":{"))
    after_file = F.col("_before.section") == 1
    start = (
        F.when(F.col("section") == 0, "")
        .when(F.col("section") == 2, F.when(after_file, "}").otherwise(""))
        .when(~after_file, opens)
        .when(F.col("_before.repo").eqNullSafe(F.col("repo")), ",")
        .otherwise(F.concat(F.lit("},"), opens)))
    return placed.select("position", "repo", "path", F.concat(start, "value").alias("value"))


def write_run_document(document: DataFrame, path: str) -> None:
    """The parts, one after the other, are the document."""
    document.repartitionByRange("position").sortWithinPartitions("position").select("value").write.mode("overwrite").text(path)
