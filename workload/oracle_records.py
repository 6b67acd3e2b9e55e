"""The merge of handed-in records restated in DuckDB SQL."""

from __future__ import annotations

from lintlake.functions.severity import AGENTS
from workload.oracle import q, strings
from workload.records import EFFORTS, RATINGS


def _some(*places: int) -> str:
    return f"list_filter([{', '.join(f'w[{i}]' for i in places)}], lambda x: x IS NOT NULL)"


# Columns of a record, by the words of its document.
FIELDS = {
    "pattern": "w[1] || ' ' || w[2]", "method": "'scan ' || len(w[1]) % 3", "signals": _some(3, 4), "reason": "w[5]",
    "impact": "'impact on ' || w[4]", "assets": _some(5, 6), "surface": "w[6]", "sensitivity": "CASE WHEN len(w[2]) % 2 = 0 THEN w[2] END",
    "compliance": "CASE WHEN len(w[1]) % 2 = 0 THEN ['C' || len(w[1])] ELSE [] END", "vector": "w[7]", "steps": _some(8, 9, 10),
    "access": "'access ' || len(w[3]) % 4", "rating": f"({strings(RATINGS)})[len(w[4]) % 5 + 1]",
    "cves": "CASE WHEN len(w[5]) % 3 = 0 THEN ['CVE-' || w[5]] ELSE [] END", "example": "CASE WHEN len(w[6]) % 3 = 0 THEN w[6] END",
    "level": "CASE WHEN len(w[1]) % 2 = 0 THEN 'LOW' ELSE 'MEDIUM' END", "factors": _some(11), "strong": _some(12, 13), "weak": _some(14),
    "fix": "w[1] || ' to ' || w[3]", "rationale": "'since ' || w[2]", "fixes": _some(15, 16), "tradeoff": "CASE WHEN len(w[7]) % 2 = 0 THEN w[7] END",
    "effort": f"({strings(EFFORTS)})[len(w[8]) % 4 + 1]", "breaking": "coalesce(len(w[9]) % 7 = 0, FALSE)",
    "test": "CASE WHEN len(w[8]) % 2 = 0 THEN w[8] END",
    "has_context": "coalesce(len(w[3]) % 2 = 0, FALSE)", "has_doubt": "coalesce(len(w[4]) % 3 = 1, FALSE)",
    "has_others": "coalesce(len(w[6]) % 3 = 1, FALSE)",
}
# Lists of the optional parts.
PARTS = {
    "surrounding": ("has_context", _some(11)), "missing": ("has_context", _some(12)), "ambiguity": ("has_doubt", _some(6)),
    "boosters": ("has_doubt", _some(7)), "detractors": ("has_doubt", _some(8)), "uses": ("has_others", _some(9)),
    "counter": ("has_others", _some(10, 11)),
}
HANDED_IN = f"""
WITH words AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
judged AS (SELECT *, CASE WHEN len(w[2]) % 5 = 4 THEN 'not a record' WHEN lang IS NULL THEN 'no place or reviewer'
  WHEN w[5] IS NULL THEN 'incomplete' END AS rejected FROM words)"""
REJECTS = HANDED_IN + " SELECT rejected AS reason, count(*) AS lines FROM judged WHERE rejected IS NOT NULL GROUP BY ALL"


def _distinct(column: str, cap: int | None = None, separator: str = "|") -> str:
    """Distinct members, in the order first seen."""
    return f"""(SELECT repo, line_number, string_agg(m, {q(separator)} ORDER BY nth) AS joined FROM (
      SELECT *, row_number() OVER (PARTITION BY repo, line_number ORDER BY place) AS nth FROM (
        SELECT repo, line_number, m, min(place) AS place FROM (
          SELECT repo, line_number, unnest({column}) AS m, (pos * 1000 + generate_subscripts({column}, 1))::BIGINT AS place FROM r)
        GROUP BY ALL)) WHERE nth <= {cap or 10**9} GROUP BY ALL)"""


def _leading(column: str, cap: int, separator: str = "|", condition: str = "TRUE") -> str:
    """The first members, repeats included."""
    return f"""(SELECT repo, line_number, string_agg(m, {q(separator)} ORDER BY nth) AS joined FROM (
      SELECT *, row_number() OVER (PARTITION BY repo, line_number ORDER BY place) AS nth FROM (
        SELECT repo, line_number, unnest({column}) AS m, (pos * 1000 + generate_subscripts({column}, 1))::BIGINT AS place FROM r WHERE {condition}))
      WHERE nth <= {cap} GROUP BY ALL)"""


def merged() -> str:
    longest = lambda c: f"arg_min({c}, -len({c}) * 1000000 + pos)"
    joins = {
        "names": _distinct("[agent]", separator=", "), "methods": _distinct("[method]", separator=" + "), "signals": _distinct("signals", 10),
        "reasons": _leading("['[' || agent || '] ' || reason]", 3, "; "), "impacts": _distinct("[impact]", separator=". "),
        "assets": _distinct("assets", 10), "compliance": _distinct("compliance"),
        "steps": _leading("list_transform(steps, lambda s: s || ' (' || agent || ')')", 8), "access": _distinct("[access]", separator=", or "),
        "cves": _distinct("cves", 5), "factors": _leading("list_transform(factors, lambda s: '[' || agent || '] ' || s)", 5),
        "strong": _distinct("strong", 10), "weak": _distinct("weak", 5), "fixes": _distinct("fixes", 5),
        "rationales": _distinct("[rationale]", 2, ". "), "tests": _leading("[test]", 2, "; ", "test IS NOT NULL"),
        "doubts": _leading("['doubt of ' || w[5]]", 2, "; ", "has_doubt"),
        **{name: _distinct(name, 5 if name in ("boosters", "detractors") else None) for name in PARTS},
    }
    j = lambda name: f"coalesce(j_{name}.joined, '')"
    one, many = "records = 1", "records > 1"
    main = "arg_min({0}, -len(coalesce(w[9], '')) * 1000000 + pos) FILTER (has_context)"
    wrap = lambda single, merged: f"CASE WHEN {one} THEN {single} ELSE {merged} END"
    return HANDED_IN + f""",
raw AS (SELECT lang AS repo, (doc_id % 5 + 1)::INT AS line_number, ({strings(AGENTS)})[doc_id % 3 + 1] AS agent, doc_id, w,
  {", ".join(f"{sql} AS {name}" for name, sql in FIELDS.items())},
  {", ".join(f"CASE WHEN coalesce({FIELDS[part]}, FALSE) THEN {sql} ELSE [] END AS {name}" for name, (part, sql) in PARTS.items())}
  FROM judged WHERE rejected IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY repo, line_number ORDER BY list_position({strings(AGENTS)}, agent), doc_id) AS pos FROM raw),
g AS (SELECT repo, line_number, count(*) AS records, count(DISTINCT agent)::INT AS n_agents, string_agg(DISTINCT agent, ',' ORDER BY agent) AS agents,
  {", ".join(f"{longest(c)} AS {c}" for c in ("pattern", "surface", "vector", "fix"))},
  {", ".join(f"arg_min({c}, pos) FILTER ({c} IS NOT NULL) AS {c}" for c in ("sensitivity", "example", "tradeoff"))},
  arg_min(rating, CASE rating WHEN 'Unknown' THEN 99 ELSE list_position({strings(RATINGS)}, rating) END * 1000000 + pos) AS rating,
  arg_min(coalesce(effort, chr(0)), -CASE WHEN effort IS NULL OR effort = 'Unknown' THEN 0 ELSE list_position({strings(EFFORTS)}, effort) - 1 END * 1000000 + pos) AS effort,
  bool_or(breaking) AS breaking, arg_min(level, pos) AS level, bool_or(has_context) AS has_context, bool_or(has_doubt) AS has_doubt,
  bool_or(has_others) AS has_others,
  {", ".join(f"nullif({main.format(f'coalesce(w[{i}], chr(0))')}, chr(0)) AS {name}" for name, i in (("purpose", 9), ("flow", 10), ("file_is", 13), ("frame", 14)))},
  bool_or(coalesce(len(w[5]) % 4 = 0, FALSE)) FILTER (has_doubt) AS likely, any_value(w[7]) AS validation,
  bool_or(coalesce(len(w[7]) % 5 = 0, FALSE)) FILTER (has_others) AS human, any_value(reason) AS only_reason
  FROM r GROUP BY repo, line_number)
SELECT g.repo, g.repo || '.txt' AS path, g.line_number, records, g.agents AS agreeing_agents,
  g.pattern AS pattern_matched, {wrap("NULL", f"left(g.pattern || ' (seen by ' || n_agents || ' reviewers: ' || j_names.joined || ')', 200)")} AS evidence_summary,
  {j("methods")} AS detection_method, {j("signals")} AS signals_observed, {wrap("NULL", "'consensus'")} AS agent_name,
  {wrap("NULL", "'agreement'")} AS check_name, {wrap("only_reason", j("reasons"))} AS severity_reasoning, left({j("impacts")}, 500) AS impact_description,
  {j("assets")} AS affected_assets, g.surface AS attack_surface, sensitivity AS data_sensitivity, {j("compliance")} AS compliance_impact,
  g.vector AS attack_vector, {wrap("replace(" + j("steps") + ", ' (' || g.agents || ')', '')", j("steps"))} AS attack_steps, {j("access")} AS required_access,
  rating AS exploitability_rating, {j("cves")} AS similar_cves, example AS exploit_examples,
  CASE WHEN n_agents >= 2 THEN 'HIGH' ELSE level END AS confidence_level,
  {wrap("replace(" + j("factors") + ", '[' || g.agents || '] ', '')",
        "n_agents || ' reviewers found this independently' || CASE WHEN j_factors.joined IS NULL THEN '' ELSE '|' || j_factors.joined END")} AS primary_factors,
  {j("strong")} AS strong_evidence, {j("weak")} AS weak_evidence, n_agents AS agent_agreement,
  {wrap("'Single reviewer: ' || g.agents", "n_agents || ' reviewers agree (' || replace(g.agents, ',', ', ') || ')'")} AS agreement_details,
  g.fix AS recommended_fix, {j("rationales")} AS fix_rationale, {j("fixes")} AS alternative_fixes, tradeoff AS tradeoffs,
  nullif(effort, chr(0)) AS implementation_complexity, breaking AS breaking_changes, j_tests.joined AS testing_guidance,
  purpose AS function_purpose, flow AS data_flow, {j("surrounding")} AS surrounding_controls, {j("missing")} AS missing_controls,
  file_is AS file_purpose, frame AS framework_context, likely AS is_likely_false_positive, j_doubts.joined AS doubt,
  {j("ambiguity")} AS ambiguity_factors, CASE WHEN {one} AND g.has_doubt THEN validation END AS validation_needed,
  {j("boosters")} AS confidence_boosters, {j("detractors")} AS confidence_detractors, {j("uses")} AS possible_legitimate_uses,
  {j("counter")} AS counterarguments, human AS requires_human_judgment, CASE WHEN {many} THEN 'consensus' END AS generated_by
FROM g {" ".join(f"LEFT JOIN {sql} j_{name} USING (repo, line_number)" for name, sql in joins.items())}"""
