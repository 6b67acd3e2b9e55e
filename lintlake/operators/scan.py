"""Regex detection: files in, one row per match out.  No shuffle.

Two narrow steps.  First every rule is tested on the text, cheap substring
tests guarding the regular expression, and the file is exploded into the rules
that hit.  Then only those rules extract their matches with line numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import text
from lintlake.functions.constants import exploded, rows_literal, sql_literal, texts_literal
from lintlake.functions.rules import BUILTIN_RULES, Rule, anchor_of
from lintlake.functions.severity import AGENTS, SEVERITIES

DETECTORS = ["regex", "ast"]


def rule_labels(rules: Sequence[Rule]) -> list[dict[str, object]]:
    """What the findings of each rule are labelled with, by the rule's position."""
    ordinals: dict[str, int] = {}
    rows = []
    for rule in rules:
        ordinals[rule.agent] = ordinals.get(rule.agent, 0) + 1
        rows.append({
            "rule_id": rule.rule_id,
            "agent": rule.agent,
            "agent_rank": AGENTS.index(rule.agent),
            "rule_ordinal": ordinals[rule.agent],
            "category": rule.category,
            "severity": rule.severity,
            "sev_rank": SEVERITIES.index(rule.severity),
            "confidence": rule.confidence,
            "recommendation": rule.advice,
            "ref_primary": rule.ref_primary,
            "ref_secondary": rule.ref_secondary,
            "description": rule.description,
        })
    return rows


def rules_literal(rules: Sequence[Rule]) -> Column:
    """The rule labels as one constant array, indexed by position."""
    return rows_literal(rule_labels(rules))


def _anchors(rule: Rule) -> list[str]:
    """Anchors of the rule's first group of needed substrings."""
    return list(dict.fromkeys(anchor_of(word) for word in rule.needs[0])) if rule.needs else []


def _may_match(rule: Rule, anchors: Sequence[str]) -> str:
    """SQL condition on ``content``, ``_lowered`` and the anchors found in it;
    cheap tests come first."""
    own = _anchors(rule)
    tests = ["(" + " OR ".join(f"_a[{anchors.index(a)}]" for a in own) + ")"] if own else []
    tests += [
        "(" + " OR ".join(f"contains(_lowered, {sql_literal(word)})" for word in group) + ")"
        for i, group in enumerate(rule.needs) if i > 0 or set(group) != set(own)
    ]
    if rule.gate:
        tests.append(f"rlike(content, {sql_literal(f'(?dUi){rule.gate}')})")
    tests.append(f"rlike(content, {sql_literal(rule.java_regex)})")
    return " AND ".join(tests)


def _with_hits(corpus: DataFrame, rules: Sequence[Rule], name: str) -> DataFrame:
    """Adds the positions of the rules that match somewhere in the file."""
    anchors = sorted({anchor for rule in rules for anchor in _anchors(rule)})
    tests = ", ".join(f"contains(_lowered, {sql_literal(a)})" for a in anchors)
    cases = ", ".join(f"CASE WHEN {_may_match(rule, anchors)} THEN {i} END" for i, rule in enumerate(rules))
    return (
        # Two letters match an ASCII one in any case, yet are not its upper case.
        corpus.withColumn("_lowered", F.replace(F.replace(F.lower("content"), F.lit("\u017f"), F.lit("s")), F.lit("\u212a"), F.lit("k")))
        .withColumn("_a", F.expr(f"array({tests})").cast("array<boolean>"))
        .select(*corpus.columns, F.array_compact(F.expr(f"array({cases})")).alias(name))
    )


def rule_hits(corpus: DataFrame, rules: Sequence[Rule], *keep: str) -> DataFrame:
    """One row per (file, rule that matches somewhere in it)."""
    return _with_hits(corpus.select(*keep), rules, "_hits").select(*keep, exploded(F.col("_hits")).alias("rule_ix"))


def with_matches(corpus: DataFrame, rules: Sequence[Rule], name: str, body) -> DataFrame:
    """Adds the matches of all rules in a file as one array of ``body(rule_ix, match_ordinal, line_number, match)``.

    Suppressed matches are left out.  The file stays one row, so its text is
    not copied for each rule that hits.
    """
    regexes = texts_literal([rule.java_regex for rule in rules])

    def of_rule(ix: Column) -> Column:
        regex = F.get(regexes, ix)
        found = F.zip_with(
            F.regexp_extract_all(F.col("content"), regex, F.lit(0)),
            text.match_start_lines(F.col("content"), regex),
            lambda match, line: F.struct(match.alias("match"), line.alias("line")))
        kept = F.filter(found, lambda e: ~_suppressed(rules, ix, e["match"]))
        return F.transform(kept, lambda e, nth: body(ix, nth, e["line"], e["match"]))

    hits = _with_hits(corpus, rules, "_hits")
    return hits.withColumn(name, F.flatten(F.transform("_hits", of_rule))).drop("_hits")


def _suppressed(rules: Sequence[Rule], rule_ix: Column, match: Column) -> Column:
    """True when one of the rule's suppression patterns occurs in the match."""
    condition = F.lit(False)
    for i, rule in enumerate(rules):
        for pattern in rule.suppress:
            condition = condition | ((rule_ix == i) & F.rlike(match, F.lit(f"(?dU){pattern}")))
    return condition


def regex_matches(
    corpus: DataFrame,
    rules: Sequence[Rule] = BUILTIN_RULES,
    *,
    with_context: bool = False,
    keep_suppressed: bool = False,
) -> DataFrame:
    """Every match: ``repo, path, rule_ix, match_ordinal, line_number, match``
    and, on request, ``context`` and ``suppressed``."""
    keep = ["repo", "path", "content"]
    if with_context:
        corpus = corpus.withColumn("_lines", F.split("content", "\n"))
        keep.append("_lines")
    hits = rule_hits(corpus, rules, *keep)

    regex = F.get(texts_literal([rule.java_regex for rule in rules]), F.col("rule_ix"))

    def entry(match: Column, line: Column) -> Column:
        fields = [line.alias("line_number"), match.alias("match")]
        if with_context:
            fields.append(text.context_window(F.col("_lines"), line).alias("context"))
        fields.append(_suppressed(rules, F.col("rule_ix"), match).alias("suppressed"))
        return F.struct(*fields)

    entries = F.zip_with(
        F.regexp_extract_all(F.col("content"), regex, F.lit(0)),
        text.match_start_lines(F.col("content"), regex),
        entry,
    )
    if not keep_suppressed:
        entries = F.filter(entries, lambda e: ~e["suppressed"])
    matches = hits.select(
        "repo", "path", "rule_ix", F.posexplode(entries).alias("match_ordinal", "_m")
    )
    fields = ["line_number", "match"]
    if with_context:
        fields.append("context")
    if keep_suppressed:
        fields.append("suppressed")
    return matches.select(
        "repo", "path", "rule_ix", "match_ordinal", *[F.col(f"_m.{name}").alias(name) for name in fields]
    )


FINDING_COLUMNS = [
    "repo", "path", "agent", "agent_rank", "detector", "rule_id", "rule_ordinal",
    "match_ordinal", "category", "severity", "sev_rank", "confidence", "line_number",
    "evidence", "recommendation", "ref_primary", "ref_secondary", "description",
]


def regex_findings(
    corpus: DataFrame,
    rules: Sequence[Rule] = BUILTIN_RULES,
    *,
    with_context: bool = False,
) -> DataFrame:
    """Findings of the given rules, suppression applied."""
    matches = regex_matches(corpus, rules, with_context=with_context)
    labelled = matches.withColumn("_rule", F.get(rules_literal(rules), F.col("rule_ix")))
    own = {
        "repo": F.col("repo"),
        "path": F.col("path"),
        "detector": F.lit("regex"),
        "match_ordinal": F.col("match_ordinal"),
        "line_number": F.col("line_number"),
        "evidence": text.clip(text.evidence(F.col("match")), text.FINDING_EVIDENCE_CAP),
    }
    columns = [own.get(name, F.col(f"_rule.{name}")).alias(name) for name in FINDING_COLUMNS]
    if with_context:
        columns.append(F.col("context"))
    return labelled.select(*columns)


def rules_from_table(table: DataFrame) -> list[Rule]:
    """User-defined rules from a table with the fields of ``Rule``.

    The rules become part of the scan's expression, exactly like the built-in
    ones, so the corpus is never joined with them.  Missing optional fields
    take their defaults.  Rules apply in the order of ``ordinal`` if the table
    has that column, else of their ids.  ``needs`` is ignored, since a wrong one
    would hide matches.
    """
    rows = [r.asDict() for r in table.collect()]
    rules = []
    for row in sorted(rows, key=lambda r: (r.get("ordinal") is None, r.get("ordinal") or 0, r["rule_id"])):
        if row["agent"] not in AGENTS or row["severity"] not in SEVERITIES:
            raise ValueError(f"rule {row['rule_id']}: unknown agent or severity")
        rules.append(Rule(
            rule_id=row["rule_id"],
            agent=row["agent"],
            category=row["category"],
            severity=row["severity"],
            confidence=row.get("confidence") or "MEDIUM",
            flags=row.get("flags") or "",
            pattern=row["pattern"],
            ref_primary=row.get("ref_primary"),
            ref_secondary=row.get("ref_secondary"),
            description=row.get("description") or row["rule_id"],
            advice=row.get("advice") or "",
            suppress=tuple(row.get("suppress") or ()),
        ))
    return rules
