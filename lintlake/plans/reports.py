"""Reports as tables: counts, shares, rankings and per-repository summaries.

Every aggregate combines on the map side, so a repository that holds a third
of all findings costs one partial row per task.  Severity totals are read from
rows grouped by all the keys a report needs, so the findings are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.functions.severity import AGENTS, SEVERITIES
from lintlake.functions.text import floor_percent

TOP_REPOS = 10
CONSENSUS_LEVELS = [3, 2, 1]


def _labels(spark: SparkSession, name: str, values: list) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in values])).alias("position", name))


def agent_counts(findings: DataFrame) -> DataFrame:
    """Findings per reviewer before consensus, zeros included."""
    counted = findings.groupBy("agent").agg(F.count("*").alias("n"))
    return (
        _labels(findings.sparkSession, "agent", AGENTS)
        .join(counted, "agent", "left")
        .select("agent", F.coalesce("n", F.lit(0)).alias("findings"))
    )


def consensus_levels(agreed: DataFrame) -> DataFrame:
    """Findings per number of agreeing reviewers, with whole percents."""
    counted = agreed.groupBy("consensus_level").agg(F.count("*").alias("n"))
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(F.lit(1)))
    return (
        _labels(agreed.sparkSession, "consensus_level", CONSENSUS_LEVELS)
        .join(counted, "consensus_level", "left")
        .select(
            "consensus_level",
            F.coalesce("n", F.lit(0)).alias("findings"),
            floor_percent(F.coalesce("n", F.lit(0)), total).alias("percent"),
        )
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    """All five severities, zeros included."""
    counted = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return (
        _labels(findings.sparkSession, "severity", SEVERITIES)
        .join(counted, "severity", "left")
        .select("severity", F.col("position").alias("sev_rank"), F.coalesce("n", F.lit(0)).alias("findings"))
    )


def category_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count("*").alias("findings"))


def repo_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo").agg(
        F.count("*").alias("findings"), F.count_distinct("path").alias("files_with_findings"))


def findings_rollup(findings: DataFrame) -> DataFrame:
    """Totals by repository, severity and category in one pass."""
    return findings.rollup("repo", "severity", "category").agg(
        F.count("*").alias("findings"), F.grouping_id().cast("int").alias("level"))


def top_repos(findings: DataFrame, limit: int = TOP_REPOS) -> DataFrame:
    """Repositories with most findings; ties go by name."""
    counted = findings.groupBy("repo").agg(F.count("*").alias("findings"))
    return counted.orderBy(F.desc("findings"), "repo").limit(limit)


def reduction(raw_total: Column, kept_total: Column) -> list[Column]:
    """How many findings merging and filtering removed, and the share."""
    removed = raw_total - kept_total
    return [
        removed.alias("removed"),
        F.when(raw_total > 0, F.round(removed * 100 / raw_total, 1)).otherwise(F.lit(0.0)).alias("removed_percent"),
    ]


def repo_summary(corpus: DataFrame, findings: DataFrame, agreed: DataFrame) -> DataFrame:
    """One row per repository: files, findings, severities, reviewers."""
    files = corpus.groupBy("repo").agg(F.count("*").alias("files_scanned"))
    by_severity = (
        agreed.groupBy("repo")
        .pivot("severity", SEVERITIES)
        .agg(F.count(F.lit(1)))
        .select("repo", *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in SEVERITIES])
    )
    by_agent = (
        findings.groupBy("repo")
        .pivot("agent", AGENTS)
        .agg(F.count(F.lit(1)))
        .select("repo", *[F.coalesce(a, F.lit(0)).alias(f"{a}_findings") for a in AGENTS])
    )
    joined = files.join(by_severity, "repo", "left").join(by_agent, "repo", "left")
    numbers = [s.lower() for s in SEVERITIES] + [f"{a}_findings" for a in AGENTS]
    filled = joined.fillna(0, numbers)
    return filled.withColumn("total_findings", sum((F.col(s.lower()) for s in SEVERITIES), F.lit(0)))


def repo_summary_markdown(summary: DataFrame, run_time: str) -> DataFrame:
    """The per-repository report as text, one row per repository."""
    table = F.concat(
        F.lit("| Severity | Count |\n|---|---|\n"),
        F.concat_ws("\n", *[F.format_string(f"| {s} | %d |", F.col(s.lower())) for s in SEVERITIES]))
    agents = F.concat(
        F.lit("| Reviewer | Findings |\n|---|---|\n"),
        F.concat_ws("\n", *[F.format_string(f"| {a} | %d |", F.col(f"{a}_findings")) for a in AGENTS]))
    body = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# Audit of "), F.col("repo")),
        F.lit(f"Run: {run_time}"),
        F.format_string("Files scanned: %d, findings: %d", "files_scanned", "total_findings"),
        table,
        agents,
    )
    return summary.select("repo", body.alias("value"))


def reviewer_totals(findings: DataFrame) -> DataFrame:
    """Head of a reviewer's report: files with findings, issues, severities."""
    heads = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES[:4]]
    return findings.groupBy("agent").agg(
        F.count_distinct("repo", "path").alias("files"), F.count("*").alias("issues"), *heads)


def compliance_coverage(enriched: DataFrame) -> DataFrame:
    """Findings per compliance tag of their reasoning."""
    return (
        enriched.where(F.col("cot").isNotNull())
        .select("agent", F.explode("cot.risk.compliance_impact").alias("tag"))
        .groupBy("agent", "tag")
        .agg(F.count("*").alias("findings"))
    )


def _section(section: str, df: DataFrame, key: Column, value: Column) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("string").alias("value"))


def _counts_of_findings(findings: DataFrame) -> DataFrame:
    """``section, key, n``: findings per reviewer and in all, by one pass."""
    sets = findings.groupingSets([[F.col("agent")], []], F.col("agent")).agg(
        F.count("*").alias("n"), F.grouping_id().alias("g"))
    return sets.select(F.lit("reviewers").alias("section"), F.when(F.col("g") == 0, F.col("agent")).otherwise("total").alias("key"), "n")


def _counts_of_consensus(agreed: DataFrame) -> DataFrame:
    """``section, key, n`` by level, severity and repository and in all, by one pass."""
    level, severity, repo = (F.col(c) for c in ("consensus_level", "severity", "repo"))
    sets = agreed.groupingSets([[level], [severity], [repo], []], level, severity, repo).agg(
        F.count("*").alias("n"), F.grouping_id().alias("g"))
    # Bits of the grouping number: summed over level, severity, repository.
    g = F.col("g")
    return sets.select(
        F.when(g == 0b101, "severity").when(g == 0b110, "top_repos").otherwise("consensus").alias("section"),
        F.when(g == 0b011, level.cast("string")).when(g == 0b101, severity).when(g == 0b110, repo).otherwise("total").alias("key"), "n")


def run_report(corpus: DataFrame, findings: DataFrame, agreed: DataFrame,
               log_statistics: DataFrame | None = None, recovery: DataFrame | None = None) -> DataFrame:
    """The run report as one long table of section, key and value.

    Findings and consensus are each read by one aggregate over grouping sets.
    The largest entries of a section are kept before its counts meet in one
    place; only the ranking of repositories has more than a few.
    """
    counted = _counts_of_findings(findings).unionByName(_counts_of_consensus(agreed))
    largest = Window.partitionBy("section").orderBy(F.desc("n"), "key")
    few = counted.withColumn("rank", F.row_number().over(largest)).where(F.col("rank") <= TOP_REPOS).drop("rank")
    zeros = [("reviewers", a) for a in [*AGENTS, "total"]] + [("consensus", str(c)) for c in [*CONSENSUS_LEVELS, "total"]]
    zeros += [("severity", s) for s in SEVERITIES[:4]]
    empty = findings.sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), F.lit(0).cast("long").alias("n")) for s, k in zeros])).alias("z")).select("z.*")
    filled = few.unionByName(empty).groupBy("section", "key").agg(F.max("n").alias("n")).where(
        (F.col("section") != "severity") | F.col("key").isin(SEVERITIES[:4]))

    def in_all(section: str) -> Column:
        mine = (F.col("section") == section) & (F.col("key") == "total")
        return F.max(F.when(mine, F.col("n"))).over(Window.partitionBy(F.lit(1)))

    removed, percent = reduction(F.col("raw"), F.col("kept"))

    def entry(section: str | Column, key: str | Column, value: Column, condition: Column) -> Column:
        named = [F.lit(c) if isinstance(c, str) else c for c in (section, key)]
        return F.when(condition, F.struct(named[0].alias("section"), named[1].alias("key"), value.cast("string").alias("value")))

    section, key, n = F.col("section"), F.col("key"), F.col("n")
    is_level = (section == "consensus") & (key != "total")
    once = (section == "reviewers") & (key == "total")
    entries = [
        entry(section, key, n, F.lit(True)),
        entry("consensus_percent", key, floor_percent(n, F.col("kept")), is_level),
        entry("reduction", "removed", F.col("removed"), once),
        entry("reduction", "percent", F.format_string("%.1f", F.col("removed_percent")), once),
    ]
    report = filled.select("*", in_all("reviewers").alias("raw"), in_all("consensus").alias("kept")).select(
        "*", removed, percent).select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    parts = [_section("run", corpus.agg(F.count("*").alias("n")), F.lit("files_scanned"), F.col("n"))]
    if log_statistics is not None:
        parts += [_section("log", log_statistics, F.lit(name), F.col(name)) for name in ("findings_count", "checkpoint_count")]
    if recovery is not None:
        parts += [_section("resume", recovery, F.lit(name), F.col(name))
                  for name in ("recovery_method", "checkpoint_timestamp")]
    for part in parts:
        report = report.unionByName(part)
    return report
