"""Reviewers: regex and syntax findings of one or all of them, in one pass over the corpus.

Each file is read once.  What the rules and the syntax checks find in it become
two arrays of one slim kind, which are exploded together; a finding carries the
position of its label, and the labels are looked up in a constant table.  Python
sees the text of Python files only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import text
from lintlake.functions.constants import exploded, rows_literal
from lintlake.functions.rules import RULES_BY_AGENT
from lintlake.functions.severity import AGENTS
from lintlake.operators.pyfacts import facts_of, syntax_hits, syntax_labels
from lintlake.operators.scan import FINDING_COLUMNS, rule_labels, with_matches

# Within a file: most severe first, then by line; the reviewer's own order last.
REPORT_ORDER = ["sev_rank", "line_number", "agent_rank", "rule_ordinal", "match_ordinal"]

# What a finding is before its label is looked up.
SLIM = "array<struct<line_number:int,label:int,match_ordinal:int,evidence:string>>"


def review_labels(agents: list[str]) -> list[dict[str, object]]:
    """The labels that a review by these reviewers uses, rules first."""
    rules = [rule for agent in agents for rule in RULES_BY_AGENT[agent]]
    kinds = [("regex", rule_labels(rules)), ("ast", syntax_labels())]
    return [
        {"detector": detector, "with_context": label.get("with_context", True),
         **{name: value for name, value in label.items() if name != "with_context"}}
        for detector, labels in kinds for label in labels]


def file_findings(corpus: DataFrame, agents: list[str] | None = None, *, syntax: bool = True) -> DataFrame:
    """The corpus with a column ``found``: all findings of each file, slim.  One scan, no shuffle."""
    agents = agents or AGENTS
    rules = [rule for agent in agents for rule in RULES_BY_AGENT[agent]]

    def slim(line: Column, label: Column, ordinal: Column, evidence: Column) -> Column:
        return F.struct(
            line.alias("line_number"), label.cast("int").alias("label"), ordinal.cast("int").alias("match_ordinal"),
            evidence.alias("evidence"))

    def matched(ix: Column, nth: Column, line: Column, match: Column) -> Column:
        return slim(line, ix, nth, text.clip(text.evidence(match), text.FINDING_EVIDENCE_CAP))

    def checked(fact: Column) -> Column:
        return F.transform(
            syntax_hits(lambda name: fact[name], agents),
            lambda h: slim(fact["line"], h["label"] + len(rules), fact["fact_ordinal"], h["evidence"]))

    names = corpus.columns
    if not syntax or agents == ["permission"]:
        return with_matches(corpus, rules, "found", matched).withColumn("found", F.col("found").cast(SLIM))
    parsed = corpus.withColumn("_facts", facts_of(F.col("path"), F.col("content")))
    both = with_matches(parsed, rules, "_matches", matched)
    facts = F.coalesce(F.flatten(F.transform("_facts", checked)).cast(SLIM), F.array().cast(SLIM))
    return both.select(*names, F.concat(F.col("_matches").cast(SLIM), facts).alias("found"))


def labelled(rows: DataFrame, labels: list[dict[str, object]], finding: str, *extra: str) -> DataFrame:
    """Findings in full from rows with a slim finding in the column ``finding``."""
    slim = F.col(finding)
    looked_up = F.get(rows_literal(labels), slim["label"])
    own = {name: slim[name] for name in ("match_ordinal", "line_number", "evidence")}
    columns = {"repo": F.col("repo"), "path": F.col("path"), **own}
    return rows.select(*[columns.get(name, looked_up[name]).alias(name) for name in FINDING_COLUMNS], *extra)


def findings_of_files(files: DataFrame, agents: list[str] | None = None) -> DataFrame:
    """All findings in full of files that ``file_findings`` has been over, for the same reviewers."""
    rows = files.select("repo", "path", exploded(F.col("found")).alias("_f"))
    return labelled(rows, review_labels(agents or AGENTS), "_f")


def review(
    corpus: DataFrame,
    agents: list[str] | None = None,
    *,
    syntax: bool = True,
    with_context: bool = False,
) -> DataFrame:
    """All findings of the given reviewers (all three by default).

    ``syntax=False`` leaves the Python syntax checks out.
    """
    agents = agents or AGENTS
    labels = review_labels(agents)
    files = file_findings(corpus.select("repo", "path", "content"), agents, syntax=syntax)
    if not with_context:
        return findings_of_files(files, agents)
    # Lines are cut once for each file.
    lines = files.withColumn("_lines", F.split("content", "\n"))
    rows = lines.select("repo", "path", "_lines", exploded(F.col("found")).alias("_f"))
    shown = F.get(rows_literal(labels), F.col("_f.label"))["with_context"]
    around = F.when(shown, text.context_window(F.col("_lines"), F.col("_f.line_number")))
    return labelled(rows.withColumn("context", around), labels, "_f", "context")


def number_in_file(findings: DataFrame) -> DataFrame:
    """Numbers the findings of each file from 1, in report order."""
    by_file = Window.partitionBy("repo", "path").orderBy(*REPORT_ORDER)
    return findings.withColumn("number", F.row_number().over(by_file))


def finding_id() -> Column:
    """Stable across runs and re-runs, so repeated writes can be told apart."""
    return F.md5(F.concat_ws("|", "repo", "path", "rule_id", F.col("match_ordinal").cast("string")))
