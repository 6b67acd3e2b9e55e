"""DuckDB SQL for every registered query."""

from __future__ import annotations

from lintlake.functions.rules import BUILTIN_RULES, RULES_BY_AGENT, Rule
from lintlake.functions.severity import AGENTS, SEVERITIES
from lintlake.sources.corpus import MAX_FILE_BYTES, SCANNABLE_EXTENSIONS, SKIP_DIRECTORIES
from workload.oracle import (
    CONSENSUS, ENRICHED, FILES, MIXED_FILES, PROSE_FILES, base, consensus_sql, facts, matches, merged_sql, q, scan_sql, strings,
)
from workload import oracle_records
from workload.queries import LATER, RUN_TIME, SHORT, USER_RULES

COLUMNS = ", ".join(SHORT)
AGREED = ("repo, path, line_number, agent, rule_id, severity, category, evidence, recommendation, "
          "consensus_level, agreeing_agents")


def _regex(rules, select: str | None = None, files: str = FILES) -> str:
    return base(rules, syntax=False, files=files) + "\n" + (select or f"SELECT {COLUMNS} FROM regex_found")


def _labels(name: str, labels) -> str:
    return f"(VALUES {', '.join(f'({i}, {q(v)})' for i, v in enumerate(labels))}) l(position, {name})"


CONTEXT = """
SELECT repo, path, rule_id, match_ordinal::INT AS match_ordinal, line_number::INT AS line_number,
  array_to_string(list_transform(
    range(greatest(1, line_number - 2), least(len(lines), line_number + 2) + 1),
    lambda k: lpad(k::VARCHAR, greatest(4, len(k::VARCHAR))::INT, ' ') || ': ' || lines[k]), chr(10)) AS context
FROM (SELECT *, string_split(content, chr(10)) AS lines FROM matched WHERE NOT suppressed)"""

TOLERANCE = """,
by_line AS (
  SELECT repo, path, line_number, count(*) AS n FROM findings GROUP BY ALL),
starts AS (
  SELECT *, CASE WHEN line_number - lag(line_number) OVER w <= 2 THEN 0 ELSE 1 END AS is_new
  FROM by_line WINDOW w AS (PARTITION BY repo, path ORDER BY line_number)),
islands AS (
  SELECT *, sum(is_new) OVER (PARTITION BY repo, path ORDER BY line_number) AS island FROM starts),
members AS (
  SELECT f.*, island, row_number() OVER (PARTITION BY f.repo, f.path, island
      ORDER BY sev_rank, agent_rank, rule_ordinal, match_ordinal, line_number) AS nth
  FROM findings f JOIN islands USING (repo, path, line_number))
SELECT repo, path, max(line_number) FILTER (nth = 1) AS line_number, min(line_number) AS first_line,
  max(line_number) AS last_line, max(agent) FILTER (nth = 1) AS agent, max(rule_id) FILTER (nth = 1) AS rule_id,
  max(severity) FILTER (nth = 1) AS severity, count(DISTINCT agent)::INT AS consensus_level,
  string_agg(DISTINCT agent, ',' ORDER BY agent) AS agreeing_agents, count(*) AS findings_merged
FROM members GROUP BY repo, path, island"""

WEAK = """CASE WHEN weak_when = 'always' OR (weak_when = 'unless_high' AND level <> 'HIGH')
  OR (weak_when = 'if_low' AND level = 'LOW') THEN array_to_string(weak, '|') ELSE '' END"""

SUMMARY = """
SELECT repo, path, rule_id, match_ordinal, concat_ws(chr(10),
  'Finding: ' || pattern, 'Method: ' || method, 'Signals: ' || array_to_string(signals, ', '),
  'Risk: ' || reason, 'Impact: ' || impact, 'Assets: ' || array_to_string(assets, ', '),
  'Attack: ' || vector, 'Exploitability: ' || rating, 'Access: ' || access,
  'Confidence: ' || level, 'Factors: ' || array_to_string(factors, ', '), 'Agreement: 1 of 3 reviewers',
  'Fix: ' || fix, 'Rationale: ' || rationale, 'Complexity: ' || complexity) AS summary
FROM enriched"""


def _run_report(resumed: bool = False) -> str:
    more = [
        f"SELECT 'log', 'findings_count', {N_LOGGED}::VARCHAR",
        "SELECT 'log', 'checkpoint_count', '0'",
        "SELECT 'resume', 'recovery_method', 'checkpoint'",
        f"SELECT 'resume', 'checkpoint_timestamp', '{RUN_TIME}'",
    ]
    entries = [
        "SELECT 'run', 'files_scanned', count(*)::VARCHAR FROM files",
        f"SELECT 'reviewers', agent, count(rule_id)::VARCHAR FROM {_labels('agent', AGENTS)} LEFT JOIN findings USING (agent) GROUP BY agent",
        "SELECT 'reviewers', 'total', count(*)::VARCHAR FROM findings",
        "SELECT 'consensus', level::VARCHAR, count(rule_id)::VARCHAR FROM (VALUES (1), (2), (3)) l(level) LEFT JOIN agreed ON consensus_level = level GROUP BY level",
        "SELECT 'consensus_percent', level::VARCHAR, (count(rule_id) * 100 // (SELECT count(*) FROM agreed))::VARCHAR FROM (VALUES (1), (2), (3)) l(level) LEFT JOIN agreed ON consensus_level = level GROUP BY level",
        "SELECT 'consensus', 'total', count(*)::VARCHAR FROM agreed",
        "SELECT 'reduction', 'removed', ((SELECT count(*) FROM findings) - (SELECT count(*) FROM agreed))::VARCHAR",
        "SELECT 'reduction', 'percent', printf('%.1f', round(((SELECT count(*) FROM findings) - (SELECT count(*) FROM agreed)) * 100 / (SELECT count(*) FROM findings), 1))",
        f"SELECT 'severity', severity, count(rule_id)::VARCHAR FROM {_labels('severity', SEVERITIES[:4])} LEFT JOIN agreed USING (severity) GROUP BY severity",
        "SELECT * FROM (SELECT 'top_repos', repo, count(*)::VARCHAR FROM agreed GROUP BY repo ORDER BY count(*) DESC, repo LIMIT 10)",
        *(more if resumed else []),
    ]
    return consensus_sql("SELECT * FROM (" + "\nUNION ALL ".join(entries) + ") report(section, key, value)")


def _repo_summary() -> str:
    severities = ", ".join(f"count(*) FILTER (severity = {q(s)}) AS {s.lower()}" for s in SEVERITIES)
    agents = ", ".join(f"count(*) FILTER (agent = {q(a)}) AS {a}_findings" for a in AGENTS)
    names = [s.lower() for s in SEVERITIES]
    return f"""
SELECT f.repo, files_scanned, {", ".join(f"coalesce({n}, 0) AS {n}" for n in names)},
  {", ".join(f"coalesce({a}_findings, 0) AS {a}_findings" for a in AGENTS)},
  {" + ".join(f"coalesce({n}, 0)" for n in names)} AS total_findings
FROM (SELECT repo, count(*) AS files_scanned FROM files GROUP BY repo) f
LEFT JOIN (SELECT repo, {severities} FROM agreed GROUP BY repo) s USING (repo)
LEFT JOIN (SELECT repo, {agents} FROM findings GROUP BY repo) a USING (repo)"""


def _markdown() -> str:
    severities = " || chr(10) || ".join(f"'| {s} | ' || {s.lower()} || ' |'" for s in SEVERITIES)
    agents = " || chr(10) || ".join(f"'| {a} | ' || {a}_findings || ' |'" for a in AGENTS)
    return f"""
SELECT repo, '# Audit of ' || repo || chr(10) || chr(10) || 'Run: {RUN_TIME}' || chr(10) || chr(10)
  || 'Files scanned: ' || files_scanned || ', findings: ' || total_findings || chr(10) || chr(10)
  || '| Severity | Count |' || chr(10) || '|---|---|' || chr(10) || {severities} || chr(10) || chr(10)
  || '| Reviewer | Findings |' || chr(10) || '|---|---|' || chr(10) || {agents} AS value
FROM ({_repo_summary()})"""


FINDINGS_JSON = """
SELECT repo, to_json({'file': path, 'findings': list({
    'line_number': line_number, 'severity': severity, 'category': category, 'evidence': evidence,
    'recommendation': recommendation, 'consensus_level': consensus_level,
    'agreeing_agents': string_split(agreeing_agents, ',')} ORDER BY line_number)})::VARCHAR AS value
FROM agreed GROUP BY repo, path"""

_HEAD = " || ".join([
    "'Reviewer: ' || agent || chr(10) || 'Files with findings: ' || count(DISTINCT (repo, path)) FILTER (rule_id IS NOT NULL)",
    "chr(10) || 'Issues: ' || count(rule_id)",
    *(f"CASE WHEN count(*) FILTER (severity = {q(s)}) > 0 THEN chr(10) || '{s}: ' || count(*) FILTER (severity = {q(s)}) ELSE '' END"
      for s in SEVERITIES[:4])])
LISTING = f""",
told AS ({SUMMARY.replace("SELECT repo,", "SELECT agent, repo,").strip()}),
entries AS (
  SELECT f.*, row_number() OVER (PARTITION BY agent, repo, path ORDER BY sev_rank, line_number, agent_rank, rule_ordinal, match_ordinal) AS nth,
    concat_ws(chr(10), '[' || severity || '] ' || category, '   Line: ' || line_number, '   Confidence: ' || confidence,
      '   Evidence: ' || evidence, '   Recommendation: ' || recommendation, '   Reference: ' || ref_primary,
      '   See also: ' || ref_secondary,
      CASE WHEN agent = 'permission' THEN '   ' || replace(summary, chr(10), chr(10) || '   ') END) AS entry
  FROM findings f LEFT JOIN told USING (agent, repo, path, rule_id, match_ordinal)),
blocks AS (
  SELECT agent, NULL AS repo, NULL AS path, {_HEAD} AS value FROM {_labels('agent', AGENTS)} LEFT JOIN findings USING (agent) GROUP BY agent
  UNION ALL
  SELECT agent, repo, path, 'File: ' || path || chr(10) || string_agg(nth || '. ' || entry, chr(10) ORDER BY nth)
  FROM entries GROUP BY agent, repo, path),
counted AS (SELECT *, (1 + len(value) - len(replace(value, chr(10), '')))::BIGINT AS n_lines FROM blocks)
SELECT agent, repo, path, (1 + coalesce(sum(n_lines) OVER (PARTITION BY agent ORDER BY repo NULLS FIRST, path
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first_line, n_lines, value FROM counted"""

RUN_DOCUMENT = f"""
SELECT row_number() OVER w - 1 AS position, repo, path, CASE section
    WHEN 0 THEN value
    WHEN 2 THEN CASE WHEN lag(section) OVER w = 1 THEN '}}' ELSE '' END || value
    ELSE CASE WHEN lag(repo) OVER w = repo THEN ',' WHEN lag(section) OVER w = 1 THEN '}},' || to_json(repo) || ':{{'
      ELSE to_json(repo) || ':{{' END || value END AS value
FROM (
  SELECT 0 AS section, NULL AS repo, NULL AS path, '{{"metadata":' || to_json({{'scan_type': 'consensus',
    'agents': [{", ".join(q(a) for a in ("security", "privacy", "permission"))}], 'scan_date': '{RUN_TIME}', 'duration_seconds': 1.5::DOUBLE,
    'statistics': {{{", ".join(f"'{a}': count(*) FILTER (agent = {q(a)})" for a in ("security", "privacy", "permission"))}}}}}) || ',"findings":{{' AS value
  FROM findings
  UNION ALL SELECT 1, repo, path, to_json(path) || ':' || to_json(list({{
    'line_number': line_number, 'severity': severity, 'category': category, 'evidence': evidence,
    'recommendation': recommendation, 'consensus_level': consensus_level,
    'agreeing_agents': string_split(agreeing_agents, ',')}} ORDER BY line_number)) FROM agreed GROUP BY repo, path
  UNION ALL SELECT 2, NULL, NULL, '}}}}')
WINDOW w AS (ORDER BY section, repo, path)"""

N_CRITICAL = "(SELECT count(*) FROM agreed WHERE severity = 'CRITICAL')"
N_LOGGED = "(SELECT count(*) FROM agreed WHERE severity IN ('CRITICAL', 'HIGH'))"

USER = [Rule(rule_id, agent, category, severity, "MEDIUM", flags, pattern, None, None, rule_id, "")
        for rule_id, agent, category, severity, flags, pattern, _ in USER_RULES]

INDEXED = r"""
WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
p AS (SELECT DISTINCT a, b FROM (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w))
      WHERE len(a) >= 6 AND len(b) >= 6),
f AS (SELECT source AS repo, doc_id, text, lower(text) AS low FROM documents),
c AS (SELECT repo, doc_id, text, a, b FROM f JOIN p ON contains(low, a) AND contains(low, b)
      WHERE regexp_matches(text, '(?i)' || a || '\s+' || b)),
s AS (SELECT *, regexp_extract_all(text, '(?i)' || a || '\s+' || b) AS ms,
      string_split_regex(text, '(?i)' || a || '\s+' || b) AS parts FROM c),
e AS (SELECT *, unnest(range(len(ms))) AS i FROM s),
h AS (SELECT *, array_to_string(parts[1:i + 1], '') || array_to_string(ms[1:i], '') AS head FROM e)
SELECT repo, doc_id::VARCHAR AS path, a || ' ' || b AS rule_id, i::INT AS match_ordinal,
  (1 + len(head) - len(replace(head, chr(10), '')))::INT AS line_number FROM h"""

LOOKAHEAD = [r for r in BUILTIN_RULES if r.has_lookahead]
# A reviewer's rules keep their numbers even when only some of them are run;
# the numbers are not part of the output.

ORACLE = {
    "scannable_files": f"WITH {MIXED_FILES.strip()} SELECT repo, path, length FROM files",
    "skipped_files": f"WITH {MIXED_FILES.strip()} SELECT * FROM (SELECT repo, path, strlen(content)::BIGINT AS length, CASE "
                     "WHEN starts_with(repo, '.') THEN 'hidden repository' "
                     f"WHEN list_has_any(string_split(path, '/')[:-2], {strings(SKIP_DIRECTORIES)}) THEN 'directory' "
                     f"WHEN regexp_extract(path, '[^/](\\.[^./]+)$', 1) NOT IN ({', '.join(q(e) for e in SCANNABLE_EXTENSIONS)}) "
                     "THEN 'extension' "
                     f"WHEN strlen(content) > {MAX_FILE_BYTES} THEN 'size' END AS reason FROM all_files) WHERE reason IS NOT NULL",
    "normalized_text": "SELECT doc_id, len(text)::INT AS n_chars, md5(text) AS digest FROM documents",
    "regex_findings_security": _regex(RULES_BY_AGENT["security"]),
    "regex_findings_privacy": _regex(RULES_BY_AGENT["privacy"]),
    "regex_findings_permission": _regex(RULES_BY_AGENT["permission"]),
    "regex_findings_lookahead": _regex(LOOKAHEAD),
    "suppressed_matches": _regex(
        RULES_BY_AGENT["security"],
        "SELECT repo, path, line_number::INT AS line_number, match AS evidence FROM matched WHERE suppressed"),
    "finding_context": _regex(BUILTIN_RULES, CONTEXT),
    "findings_sorted_numbered": scan_sql(
        "SELECT repo, path, row_number() OVER (PARTITION BY repo, path ORDER BY sev_rank, line_number, agent_rank, "
        "rule_ordinal, match_ordinal)::INT AS number, severity, line_number, rule_id FROM findings"),
    "ast_facts": f"WITH {FILES.strip()},\n{facts()}\nSELECT repo, path, fact_ordinal, kind, line, end_line, name, "
                 "func_name, value_str, arg0_kind, shell_true, args FROM facts",
    "ast_findings_security": scan_sql(f"SELECT {COLUMNS} FROM ast_found WHERE agent = 'security'"),
    "ast_findings_privacy": scan_sql(f"SELECT {COLUMNS} FROM ast_found WHERE agent = 'privacy'"),
    "all_findings": scan_sql(f"SELECT agent, detector, {COLUMNS} FROM findings"),
    "prose_findings": _regex(BUILTIN_RULES, files=PROSE_FILES),
    "user_rules": _regex(USER, files=PROSE_FILES),
    "indexed_rules": INDEXED,
    "consensus_findings": consensus_sql(f"SELECT {AGREED} FROM agreed"),
    "consensus_reasoned": consensus_sql(
        "SELECT repo, path, line_number, rule_id, severity, consensus_level, agreeing_agents, findings_merged, "
        "severity IN ('CRITICAL', 'HIGH') AS reasoned FROM consensus"),
    "consensus_high": consensus_sql(f"SELECT {AGREED} FROM consensus WHERE severity IN ('CRITICAL', 'HIGH')"),
    "consensus_without_syntax": ",\n".join([
        base(syntax=False), "findings AS (SELECT * FROM regex_found)", CONSENSUS.strip()])
        + f"\nSELECT {AGREED} FROM agreed",
    "consensus_tolerance": base() + TOLERANCE,
    "reasoning_enriched": base() + ",\n" + ENRICHED + f"""
SELECT repo, path, rule_id, match_ordinal, pattern,
  'Line ' || line_number || ': ' || left(evidence, summary_chars) AS evidence_summary,
  array_to_string(signals, '|') AS signals, reason, sensitivity, array_to_string(compliance, '|') AS compliance, rating,
  array_to_string(cves, '|') AS cves, level AS confidence_level, {WEAK} AS weak, fix, complexity, breaking,
  array_to_string(missing, '|') AS missing, '{RUN_TIME}' AS generated_at
FROM enriched""",
    "reasoning_merged": "SELECT * EXCLUDE (records) FROM (" + merged_sql() + ")",
    "summary_text": base() + ",\n" + ENRICHED + SUMMARY,
    "record_rejects": oracle_records.REJECTS,
    "records_merged": oracle_records.merged(),
    "record_json": base() + ",\n" + ENRICHED
    + "SELECT repo, path, rule_id, match_ordinal, pattern, len(steps)::INT AS steps, TRUE AS unchanged FROM enriched",
    "compliance_coverage": base() + ",\n" + ENRICHED
    + "SELECT agent, tag, count(*) AS findings FROM (SELECT agent, unnest(compliance) AS tag FROM enriched) GROUP BY ALL",
    "agent_counts": scan_sql(
        f"SELECT agent, count(rule_id) AS findings FROM {_labels('agent', AGENTS)} LEFT JOIN findings USING (agent) GROUP BY agent"),
    "consensus_levels": consensus_sql(
        "SELECT level::INT AS consensus_level, count(rule_id) AS findings, count(rule_id) * 100 // (SELECT count(*) FROM agreed) AS percent "
        "FROM (VALUES (1), (2), (3)) l(level) LEFT JOIN agreed ON consensus_level = level GROUP BY level"),
    "severity_counts": consensus_sql(
        f"SELECT severity, position::INT AS sev_rank, count(rule_id) AS findings FROM {_labels('severity', SEVERITIES)} "
        "LEFT JOIN agreed USING (severity) GROUP BY severity, position"),
    "category_counts": consensus_sql("SELECT category, count(*) AS findings FROM agreed GROUP BY category"),
    "repo_counts": consensus_sql(
        "SELECT repo, count(*) AS findings, count(DISTINCT path) AS files_with_findings FROM agreed GROUP BY repo"),
    "findings_rollup": consensus_sql(
        "SELECT repo, severity, category, count(*) AS findings, grouping(repo, severity, category)::INT AS level "
        "FROM agreed GROUP BY ROLLUP (repo, severity, category)"),
    "top_repos": consensus_sql(
        "SELECT repo, count(*) AS findings FROM agreed GROUP BY repo ORDER BY findings DESC, repo LIMIT 10"),
    "repo_summary": consensus_sql(_repo_summary()),
    "repo_summary_markdown": consensus_sql(_markdown()),
    "reviewer_report": scan_sql(
        "SELECT agent, count(DISTINCT (repo, path)) AS files, count(*) AS issues, "
        + ", ".join(f"count(*) FILTER (severity = {q(s)}) AS {s.lower()}" for s in SEVERITIES[:4])
        + " FROM findings GROUP BY agent"),
    "run_report": _run_report(),
    "run_report_resumed": _run_report(resumed=True),
    "findings_json": consensus_sql(FINDINGS_JSON),
    "reviewer_listing": base() + ",\n" + ENRICHED + LISTING,
    "run_document": consensus_sql(RUN_DOCUMENT),
    "log_replay": consensus_sql(
        "SELECT md5(concat_ws('|', repo, path, rule_id, match_ordinal)) AS finding_id, repo, path AS file, severity, category, "
        "line_number, left(evidence, 200) AS evidence, consensus_level, agreeing_agents FROM agreed"),
    "log_stats": consensus_sql(
        f"SELECT count(*) + {N_CRITICAL} + 3 AS total_entries, count(*) + {N_CRITICAL} AS findings_count, "
        "2::BIGINT AS checkpoint_count FROM agreed"),
    "resume_pending_files": consensus_sql(
        "SELECT repo, path FROM files f WHERE NOT EXISTS (SELECT 1 FROM agreed a WHERE a.repo = f.repo AND a.path = f.path "
        "AND severity IN ('CRITICAL', 'HIGH'))"),
    "resume_pending_repos": consensus_sql(
        "SELECT repo, path FROM files WHERE repo NOT IN (SELECT repo FROM agreed WHERE consensus_level = 3)"),
    "resume_state": consensus_sql(
        f"SELECT 'checkpoint' AS recovery_method, 'file_level' AS checkpoint_type, '{RUN_TIME}' AS checkpoint_timestamp, "
        "(SELECT count(DISTINCT (repo, path)) FROM agreed WHERE severity = 'CRITICAL') AS files_scanned, "
        f"{N_CRITICAL} AS findings_count, 0::BIGINT AS repos_completed, 'src0' AS current_repo, {N_LOGGED} AS log_findings"),
    "state_validation": consensus_sql(
        f"SELECT TRUE AS is_valid, {N_CRITICAL} = {N_LOGGED} AS counts_match, {N_LOGGED} AS findings_count, TRUE AS unfinished, "
        "TRUE AS has_file_checkpoint, FALSE AS has_repo_checkpoint, FALSE AS has_summary_checkpoint, "
        f"'{RUN_TIME}' AS latest_timestamp, 'file_level' AS latest_type"),
    "last_checkpoint": consensus_sql(f"SELECT '{LATER}' AS timestamp, '2' AS files FROM (SELECT count(*) FROM agreed)"),
    "stream_findings": consensus_sql(f"SELECT {AGREED} FROM agreed"),
    "stream_counts": _regex(BUILTIN_RULES, "SELECT agent, severity, count(*) AS findings FROM regex_found GROUP BY ALL"),
    "stream_totals": consensus_sql(
        "SELECT 'all' AS dimension, 'all' AS value, count(*) AS findings FROM agreed HAVING count(*) > 0 "
        + " ".join(f"UNION ALL SELECT '{c}', {c}::VARCHAR, count(*) FROM agreed GROUP BY {c}"
                   for c in ("consensus_level", "severity", "category", "repo"))),
    "stream_progress": consensus_sql(
        "SELECT count(*) AS files, (SELECT count(*) FROM agreed) AS findings, sum(strlen(content))::BIGINT AS bytes, "
        "100.0::DOUBLE AS percent, TRUE AS in_batches, TRUE AS rated FROM files"),
    "log_order": consensus_sql(
        f"SELECT '3' AS level, count(*) AS before, {N_CRITICAL} AS after, TRUE AS sized FROM agreed"),
    "resume_states": consensus_sql("""SELECT * EXCLUDE (n),
  'Resumed by: ' || recovery_method || coalesce(chr(10) || 'State saved at: ' || saved_at, '')
  || chr(10) || 'Files done: ' || files_scanned || chr(10) || 'Findings: ' || findings_count
  || chr(10) || 'Repositories done: ' || repos_completed || coalesce(chr(10) || 'Repository under way: ' || current_repo, '') AS summary
FROM (SELECT state, recovery_method, checkpoint_type,
    CASE WHEN with_files THEN files ELSE 0 END AS files_scanned, CASE state WHEN 'nothing' THEN 0 ELSE n END AS findings_count,
    CASE WHEN with_repos THEN repos ELSE 0 END AS repos_completed, current_repo, TRUE AS is_valid, TRUE AS counts_match,
    unfinished, saved_at, n
  FROM (SELECT count(*) AS n, count(DISTINCT (repo, path)) AS files, count(DISTINCT repo) AS repos
        FROM agreed WHERE severity = 'CRITICAL'),
  (VALUES ('files', 'checkpoint', 'file_level', TRUE, FALSE, 'src0', TRUE, '"""
        + RUN_TIME + """'), ('repos', 'checkpoint', 'repo_level', TRUE, TRUE, NULL, TRUE, '"""
        + LATER + """'), ('finished', 'checkpoint', 'summary', FALSE, FALSE, NULL, FALSE, '"""
        + LATER + """'), ('log', 'transaction_log', NULL, TRUE, FALSE, NULL, TRUE, NULL),
    ('nothing', 'none', NULL, FALSE, FALSE, NULL, FALSE, NULL))
  s(state, recovery_method, checkpoint_type, with_files, with_repos, current_repo, unfinished, saved_at))""").replace(
        "SELECT * EXCLUDE (n),", "SELECT * EXCLUDE (n, saved_at),"),
}
