"""The whole audit: corpus in, consensus findings out, sinks written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.severity import AGENTS
from lintlake.operators.consensus import consensus_of_files, consensus_with_reasoning, filter_min_severity
from lintlake.operators.review import file_findings, review, review_labels


def audit(
    corpus: DataFrame,
    *,
    min_severity: str = "MEDIUM",
    reasoning: bool = False,
    generated_at: str = "",
    syntax: bool = True,
) -> DataFrame:
    """Findings of all reviewers, grouped by location, then filtered by severity.

    A corpus has one row per file, so without reasoning nothing is shuffled.
    """
    if reasoning:
        agreed = consensus_with_reasoning(review(corpus, syntax=syntax), generated_at)
        return filter_min_severity(agreed, min_severity)
    return audit_of_files(file_findings(corpus.select("repo", "path", "content"), AGENTS, syntax=syntax), min_severity)


def audit_of_files(files: DataFrame, min_severity: str = "MEDIUM") -> DataFrame:
    """The audit of files that ``file_findings`` has been over for all reviewers."""
    return filter_min_severity(consensus_of_files(files, review_labels(AGENTS)), min_severity)


def findings_by_file(agreed: DataFrame) -> DataFrame:
    """``repo, path, findings``: the findings of each file by line.  A file is the largest group collected here."""
    entry = F.struct(
        "line_number", "severity", "category", "evidence", "recommendation", "consensus_level", "agreeing_agents")
    order = F.struct("line_number", "sev_rank", "rule_id")
    grouped = agreed.groupBy("repo", "path").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), entry.alias("e")))).alias("_sorted"))
    return grouped.select("repo", "path", F.transform("_sorted", lambda x: x["e"]).alias("findings"))


def findings_documents(agreed: DataFrame) -> DataFrame:
    """One JSON document per file, the findings of the file inside.

    A repository's documents are the lines below its folder once the frame is
    written by repository.
    """
    return findings_by_file(agreed).select(
        "repo", "path", F.to_json(F.struct(F.col("path").alias("file"), "findings")).alias("value"))


def run_metadata(findings: DataFrame, run_time: str, duration_seconds: float) -> DataFrame:
    """One JSON line that describes the run."""
    per_agent = findings.agg(*[
        F.count_if(F.col("agent") == agent).alias(agent) for agent in ("security", "privacy", "permission")])
    return per_agent.select(F.to_json(F.struct(
        F.lit("consensus").alias("scan_type"),
        F.array(F.lit("security"), F.lit("privacy"), F.lit("permission")).alias("agents"),
        F.lit(run_time).alias("scan_date"),
        F.lit(duration_seconds).alias("duration_seconds"),
        F.struct("security", "privacy", "permission").alias("statistics"))).alias("value"))


def write_findings_json(agreed: DataFrame, path: str) -> None:
    findings_documents(agreed).select("repo", "value").write.mode("overwrite").partitionBy("repo").text(path)


def write_repo_summaries(markdown: DataFrame, path: str) -> None:
    markdown.write.mode("overwrite").partitionBy("repo").text(path)


def write_run_report(report: DataFrame, path: str) -> None:
    """The text report: one line per entry, sorted by section."""
    lines = report.orderBy("section", "key").select(F.concat_ws("\t", "section", "key", "value").alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)
