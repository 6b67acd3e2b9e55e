"""The registered queries restated in DuckDB SQL.

The SQL shares the pattern table, the fragments and the templates with the
library; everything computed from them — matching, line numbers, evidence,
checks, grouping, merging, reports — is written again here.
"""

from __future__ import annotations

from lintlake.functions.rules import BUILTIN_RULES
from lintlake.functions.severity import AGENTS, SEVERITIES
from lintlake.functions.templates import CONFIDENCE_MODES, TEMPLATES
from lintlake.operators import pyfacts as checks
from lintlake.sources.corpus import MAX_FILE_BYTES, SCANNABLE_EXTENSIONS, SKIP_DIRECTORIES
from workload.golden_facts import golden_rows
from workload.snippets import DIRECTORIES, SNIPPETS, SOURCE_DIRECTORIES


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


def values(name: str, columns: list[str], rows) -> str:
    body = ",\n  ".join("(" + ", ".join(c if str(c).startswith("[") else q(c) for c in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES\n  {body})"


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def logged(text: str, prefix: str = "") -> str:
    """Each line of the text as a statement that logs it."""
    start = f"{prefix}log(\""
    return f"{q(start)} || replace({text}, chr(10), '\")' || chr(10) || {q(start)}) || '\")'"


def _files(extensions, folders, where: str) -> str:
    return f"""
{values("snippets", ["snip_id", "ext", "code"], [(i, e, c) for i, (e, (_, c)) in enumerate(zip(extensions, SNIPPETS))])},
{values("dirs", ["dir_id", "dir"], list(enumerate(folders)))},
all_files AS (
  SELECT source AS repo, doc_id, snip_id, source || '/' || dir || '/doc_' || doc_id || ext AS path,
         {logged("text", "# ")} || chr(10) || code || chr(10) AS content,
         len(text) - len(replace(text, chr(10), '')) + 1 AS prose_lines
  FROM documents JOIN snippets ON snip_id = doc_id % {len(SNIPPETS)} JOIN dirs ON dir_id = doc_id % {len(folders)}),
files AS (SELECT *, strlen(content)::BIGINT AS length FROM all_files{where})"""


# Every document is a file that a scan reads.
FILES = _files([".sh" if e in (".md", ".txt") else e for e, _ in SNIPPETS], SOURCE_DIRECTORIES, "")
# Files of all kinds, of which a scan reads some.
MIXED_FILES = _files([e for e, _ in SNIPPETS], DIRECTORIES, f"""
  WHERE strlen(content) <= {MAX_FILE_BYTES}
    AND regexp_extract(path, '[^/](\\.[^./]+)$', 1) IN ({", ".join(q(e) for e in SCANNABLE_EXTENSIONS)})
    AND NOT list_has_any(string_split(path, '/')[:-2], {strings(SKIP_DIRECTORIES)})
    AND NOT starts_with(repo, '.')""")

PROSE_FILES = f"""
files AS (
  SELECT source AS repo, 'documents/' || doc_id AS path, {logged("text")} AS content, 0 AS snip_id, 0 AS prose_lines FROM documents
  UNION ALL SELECT 'pages', 'pages/' || page_id, {logged("html")}, 0, 0 FROM pages
  UNION ALL SELECT 'conversations', 'conversations/' || conv_id || '/' || turn, {logged("text")}, 0, 0 FROM conversations)"""

# The expressions without their lookaheads; what those demand is tested below.
PLAIN = {
    r.rule_id: r.pattern[: r.pattern.index("(?!")] + (r"[^;]+" if r.rule_id == "P10" else "")
    for r in BUILTIN_RULES if r.has_lookahead
}


_BLANK = r"\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_UNICODE = {"w": r"\p{L}\p{N}_", "s": _BLANK, "d": r"\p{Nd}"}


def unicode_classes(pattern: str) -> str:
    """The pattern with its class letters spelt out, since here they stand for ASCII only."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            letter = pattern[i + 1]
            if letter in _UNICODE:
                out.append(_UNICODE[letter] if inside else f"[{_UNICODE[letter]}]")
            elif letter.lower() in _UNICODE and not inside:
                out.append(f"[^{_UNICODE[letter.lower()]}]")
            else:
                out.append(pattern[i:i + 2])
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(c)
        i += 1
    return "".join(out)


def rule_values(rules) -> str:
    ordinals: dict[str, int] = {}
    rows = []
    for r in rules:
        ordinals[r.agent] = ordinals.get(r.agent, 0) + 1
        flags = f"(?{r.flags})" if r.flags else ""
        rows.append((r.rule_id, r.agent, AGENTS.index(r.agent), ordinals[r.agent], r.category, r.severity,
                     SEVERITIES.index(r.severity), r.confidence, r.ref_primary, r.ref_secondary, r.description,
                     r.advice, flags + unicode_classes(PLAIN.get(r.rule_id, r.pattern))))
    return values("rules", ["rule_id", "agent", "agent_rank", "rule_ordinal", "category", "severity", "sev_rank",
                            "confidence", "ref_primary", "ref_secondary", "description", "recommendation", "rx"], rows)


def _last(word: str, text: str) -> str:
    """Position of the last occurrence, 0 if there is none."""
    found = f"strpos(reverse(lower({text})), reverse({q(word)}))"
    return f"CASE WHEN {found} = 0 THEN 0 ELSE len({text}) - {found} - {len(word) - 2} END"


OWNERS = ["user_id", "owner_id", "tenant_id", "customer_id", "created_by"]
S03_SUPPRESS = next(r for r in BUILTIN_RULES if r.rule_id == "S03").suppress


def matches(rules) -> str:
    """All matches with their lines.  P10 may only use a WHERE, and P08 only a
    FROM, behind a certain point; earlier ones are masked by a word of the same
    length."""
    last_owner = "greatest(" + ", ".join(_last(w, "content") for w in OWNERS) + ")"
    last_tenant = _last("tenant_id", "content")
    before_tenant = f"substr(content, 1, greatest({last_tenant} - 1, 0))"
    last_where = _last("where", before_tenant)
    return f"""
{rule_values(rules)},
masked AS (
  SELECT repo, path, content, content AS scanned, NULL AS only_rule FROM files
  UNION ALL
  SELECT repo, path, content,
    regexp_replace(substr(content, 1, greatest({last_owner} - 1, 0)), '(?i)where', 'W_ERE', 'g')
      || substr(content, greatest({last_owner}, 1)), 'P10'
  FROM files WHERE contains(lower(content), 'select')
  UNION ALL
  SELECT repo, path, content,
    regexp_replace(substr(content, 1, greatest({last_where} - 1, 0)), '(?i)from', 'F_OM', 'g')
      || substr(content, greatest({last_where}, 1)), 'P08'
  FROM files WHERE contains(lower(content), 'view')),
hits AS (
  SELECT m.*, r.* FROM masked m JOIN rules r
    ON coalesce(only_rule, CASE WHEN rule_id IN ('P08', 'P10') THEN '' ELSE rule_id END) = rule_id
   AND regexp_matches(scanned, rx)),
cut AS (
  SELECT *, regexp_extract_all(scanned, rx) AS ms, string_split_regex(scanned, rx) AS segs FROM hits),
placed AS (
  SELECT * EXCLUDE (ms, segs),
    i AS match_ordinal, ms[i + 1] AS found,
    array_to_string(segs[1:i + 1], '') || array_to_string(ms[1:i], '') AS head
  FROM (SELECT *, unnest(range(len(ms))) AS i FROM cut)),
located AS (
  SELECT *,
    1 + len(head) - len(replace(head, chr(10), '')) AS line_number,
    substr(content, len(head) + 1, len(found)) AS whole,
    substr(content, len(head) + len(found) + 1) AS rest
  FROM placed),
decided AS (
  SELECT *, CASE
    WHEN rule_id = 'S11' THEN CASE WHEN NOT regexp_matches(rest, '^(?i)\\s*where') THEN whole END
    WHEN rule_id IN ('V12', 'V14') THEN CASE WHEN NOT regexp_matches(rest, '^(?i).*encrypt') THEN whole END
    WHEN rule_id = 'P01' THEN CASE WHEN NOT regexp_matches(rest, '^(?i)\\s*CREATE\\s+ROW\\s+ACCESS\\s+POLICY') THEN whole END
    WHEN rule_id = 'P05' THEN CASE WHEN NOT contains(lower(rest), 'where') THEN whole END
    WHEN rule_id = 'P09' THEN CASE
      WHEN NOT starts_with(lower(rest), 'secure') THEN whole
      WHEN regexp_matches(whole, '\\s\\s$') THEN left(whole, len(whole) - 1) END
    WHEN rule_id = 'P11' THEN CASE
      WHEN NOT regexp_matches(rest, '^(?i)\\s+WHERE') THEN whole
      WHEN regexp_matches(whole, '\\w\\w$') THEN left(whole, len(whole) - 1)
      WHEN regexp_matches(whole, '\\.\\w$') THEN left(whole, len(whole) - 2)
      WHEN regexp_matches(whole, '(?i)^(update|delete)\\s+from\\s') THEN regexp_extract(whole, '(?i)^(update|delete)\\s+from') END
    ELSE whole END AS match
  FROM located),
matched AS (
  SELECT * EXCLUDE (match_ordinal),
    row_number() OVER (PARTITION BY repo, path, rule_id, suppressed ORDER BY match_ordinal) - 1 AS match_ordinal
  FROM (SELECT *, rule_id = 'S03' AND ({" OR ".join(f"regexp_matches(match, {q(p)})" for p in S03_SUPPRESS)}) AS suppressed
    FROM decided WHERE match IS NOT NULL)),
regex_found AS (
  SELECT repo, path, agent, agent_rank, 'regex' AS detector, rule_id, rule_ordinal,
    match_ordinal::INT AS match_ordinal,
    category, severity, sev_rank, confidence, line_number::INT AS line_number,
    CASE WHEN len(t) > 200 THEN left(t, 197) || '...' ELSE t END AS evidence,
    recommendation, ref_primary, ref_secondary, description
  FROM (SELECT *, trim(match, {BLANKS}) AS t FROM matched WHERE NOT suppressed))"""


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def facts() -> str:
    rows = [[int(r[0]), int(r[1]), r[2], int(r[3]), int(r[4]), *r[5:9],
             None if r[9] is None else r[9] == "True", r[10]] for r in golden_rows()]
    return values("golden", ["g_snip", "fact_ordinal", "kind", "rel_line", "rel_end", "name", "func_name", "value_str",
                             "arg0_kind", "shell_true", "args"], rows) + """,
facts AS (
  SELECT repo, path, content, fact_ordinal, kind, (rel_line + prose_lines)::INT AS line,
    (rel_end + prose_lines)::INT AS end_line, name, func_name, value_str, arg0_kind, shell_true, args
  FROM files JOIN golden ON g_snip = snip_id WHERE ends_with(path, '.py'))"""


def ast_found() -> str:
    adv, c = checks.ADVICE, checks
    lowered = "lower(name)"
    statement = "lower(array_to_string(string_split(content, chr(10))[line:end_line], chr(10)))"
    functions = ", ".join(f"({q(k)}, {q(v)})" for k, v in c.INSECURE_FUNCTIONS.items())
    columns = """repo, path, agent, agent_rank, 'ast' AS detector, rule_id, rule_ordinal,
    fact_ordinal AS match_ordinal, category, severity,
    list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'], severity)::INT - 1 AS sev_rank,
    confidence, line AS line_number, evidence, recommendation, ref_primary, ref_secondary, description"""

    def check(n, agent, category, severity, confidence, evidence, advice, ref1, ref2, description, source):
        return f"""
  SELECT repo, path, fact_ordinal, line, {q(agent)} AS agent, {AGENTS.index(agent)} AS agent_rank,
    'E{n}' AS rule_id, {c.AST_ORDINAL_BASE + n} AS rule_ordinal, {category} AS category, {severity} AS severity,
    {q(confidence)} AS confidence, {evidence} AS evidence, {advice} AS recommendation, {q(ref1)} AS ref_primary,
    {q(ref2)} AS ref_secondary, {description} AS description
  FROM {source}"""

    built = "CASE arg0_kind WHEN 'fstring' THEN 'f-string interpolation' WHEN 'add' THEN 'string concatenation' END"
    first_pii = f"list_filter(string_split(args, ';'), lambda a: list_has_any(string_split(a, ','), {strings(c.PII_NAMES)}))"
    parts = [
        check(1, "security", q("Hardcoded Credentials"), q("CRITICAL"), "MEDIUM",
              "name || ' = ''' || left(value_str, 50) || '...'''", q(adv["E1"]), c.CREDENTIAL_REF, None,
              q("Secret assigned to a variable"),
              f"facts WHERE kind = 'assign' AND value_str <> '' AND {_any(lowered, c.SECRET_NAMES)}"
              f" AND NOT {_any('lower(value_str)', c.PLACEHOLDERS)}"),
        check(2, "security", q("SQL Injection"), q("CRITICAL"), "HIGH", f"'SQL query uses ' || {built}", q(adv["E2"]),
              c.INJECTION_REF, None, f"'Statement built by ' || {built}",
              f"facts WHERE kind = 'call' AND {_any('func_name', c.EXECUTE_WORDS)} AND arg0_kind IN ('fstring', 'add')"),
        check(3, "security", q("Command Injection"), "CASE WHEN func_name = 'eval' THEN 'CRITICAL' ELSE 'HIGH' END",
              "HIGH",
              "'Dangerous function call: ' || func_name || CASE WHEN shell_true THEN ' with shell=True' ELSE '' END",
              q(adv["E3"]), c.INJECTION_REF, None, "'Command run by ' || func_name",
              f"facts WHERE kind = 'call' AND func_name IN ({', '.join(q(f) for f in c.SHELL_CALLS)})"
              f" AND (shell_true OR func_name IN ({', '.join(q(f) for f in c.ALWAYS_RISKY)}))"),
        check(4, "security", "f_category", q("MEDIUM"), "HIGH", "'Insecure function: ' || func_name",
              f"CASE WHEN f_category = 'Insecure Deserialization' THEN {q(adv['Insecure Deserialization'])}"
              f" ELSE {q(adv['Weak Random Number Generation'])} END",
              c.INTEGRITY_REF, None, "'Use of ' || func_name",
              f"facts JOIN (VALUES {functions}) f(f_name, f_category) ON func_name = f_name WHERE kind = 'call'"),
        check(5, "privacy", q("PII Exposure"),
              f"CASE WHEN list_has_any(string_split({first_pii}[1], ','), {strings(c.GRAVE_PII_NAMES)})"
              " THEN 'CRITICAL' ELSE 'HIGH' END",
              "HIGH", "'Logging PII field in statement at line ' || line", q(adv["E5"]), "GDPR Article 5(1)(f)",
              "SOC 2 CC6.1", q("Personal field in a logging call"),
              f"facts WHERE kind = 'call' AND {_any('lower(func_name)', c.LOGGING_WORDS)} AND len({first_pii}) > 0"),
        check(6, "privacy", q("Missing Encryption"), q("CRITICAL"), "HIGH",
              "'Sensitive field ''' || name || ''' without encryption'", q(adv["E6"]), "GDPR Article 32, PCI DSS 3.4",
              "PCI DSS, HIPAA", q("Sensitive variable without protection"),
              f"facts WHERE kind = 'assign' AND {_any(lowered, c.SENSITIVE_NAMES)}"
              f" AND NOT {_any(statement, c.ENCRYPTION_WORDS)}"),
    ]
    return f"checked AS ({' UNION ALL '.join(parts)}),\nast_found AS (SELECT {columns} FROM checked)"


def base(rules=BUILTIN_RULES, syntax: bool = True, files: str = FILES) -> str:
    parts = ["WITH " + files.strip(), matches(rules).strip()]
    if syntax:
        parts += [facts(), ast_found(), "findings AS (SELECT * FROM regex_found UNION ALL SELECT * FROM ast_found)"]
    return ",\n".join(parts)


CONSENSUS = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY repo, path, line_number
      ORDER BY sev_rank, agent_rank, rule_ordinal, match_ordinal) AS nth,
    count(*) OVER (PARTITION BY repo, path, line_number) AS findings_merged
  FROM findings),
agents_at AS (
  SELECT repo, path, line_number, count(DISTINCT agent)::INT AS consensus_level,
    string_agg(DISTINCT agent, ',' ORDER BY agent) AS agreeing_agents
  FROM findings GROUP BY ALL),
consensus AS (
  SELECT r.* EXCLUDE (nth), consensus_level, agreeing_agents
  FROM ranked r JOIN agents_at a USING (repo, path, line_number) WHERE nth = 1),
agreed AS (SELECT * FROM consensus WHERE sev_rank <= 2)"""


def scan_sql(select: str, **kwargs) -> str:
    return base(**kwargs) + "\n" + select


def consensus_sql(select: str, *extra: str) -> str:
    return ",\n".join([base(), CONSENSUS.strip(), *extra]) + "\n" + select


# --- reasoning -------------------------------------------------------------

TEMPLATE_VALUES = values(
    "templates",
    ["template_ix", "t_agent", "t_category", "t_variant", "pattern", "method", "fixed_signals", "reason", "impact",
     "assets", "surface", "sensitivity", "compliance", "vector", "steps", "access", "rating", "cves", "factors",
     "strong", "weak", "fix", "rationale", "fixes", "complexity", "breaking", "testing", "if_high", "if_medium",
     "if_low", "weak_when", "summary_chars", "purpose", "missing", "generic"],
    [(i, t.agent, t.category, t.variant, t.pattern, t.method, strings(t.signals), t.reason, t.impact,
      strings(t.assets), t.surface, t.sensitivity, strings(t.compliance), t.vector, strings(t.steps), t.access,
      t.rating, strings(t.cves), strings(t.factors), strings(t.strong), strings(t.weak), t.fix, t.rationale,
      strings(t.alternatives), t.complexity, t.breaking, t.testing, CONFIDENCE_MODES[t.confidence]["HIGH"],
      CONFIDENCE_MODES[t.confidence]["MEDIUM"], CONFIDENCE_MODES[t.confidence]["LOW"], t.weak_when, t.summary_chars,
      t.purpose, strings(t.missing), t.generic) for i, t in enumerate(TEMPLATES)])

ENRICHED = TEMPLATE_VALUES + """,
variant_of AS (
  SELECT *, CASE category
    WHEN 'Hardcoded Credentials' THEN CASE WHEN low LIKE '%api%' THEN 'api' WHEN low LIKE '%aws%' THEN 'aws'
      WHEN low LIKE '%jwt%' OR low LIKE '%bearer%' THEN 'jwt' WHEN evidence LIKE '%PRIVATE KEY%' THEN 'key' ELSE 'password' END
    WHEN 'Command Injection' THEN CASE WHEN evidence LIKE '%eval%' THEN 'eval' WHEN evidence LIKE '%os.system%' THEN 'system'
      WHEN low LIKE '%shell%' THEN 'shell' WHEN evidence LIKE '%exec%' THEN 'exec' ELSE 'process' END
    WHEN 'Insecure Cryptography' THEN CASE WHEN low LIKE '%md5%' THEN 'md5' WHEN low LIKE '%sha1%' THEN 'sha1'
      WHEN evidence LIKE '%DES%' OR evidence LIKE '%RC4%' OR evidence LIKE '%Blowfish%' THEN 'cipher' ELSE 'other' END
    WHEN 'Network Security' THEN CASE WHEN low LIKE '%verify%' OR contains(low, 'cert_none') THEN 'tls' ELSE 'bind' END
    WHEN 'PII Exposure' THEN CASE WHEN evidence LIKE '%@%' OR low LIKE '%email%' THEN 'email'
      WHEN regexp_matches(evidence, '\\d{3}-\\d{2}-\\d{4}') THEN 'ssn'
      WHEN regexp_matches(evidence, '\\d{3}[-.]?\\d{3}[-.]?\\d{4}') THEN 'phone' ELSE 'field' END
    WHEN 'Missing Encryption' THEN CASE
        WHEN low LIKE '%card%' OR low LIKE '%cvv%' OR low LIKE '%credit%' OR low LIKE '%payment%' THEN 'payment'
        WHEN low LIKE '%medical%' OR low LIKE '%health%' OR low LIKE '%phi%' OR low LIKE '%diagnosis%' THEN 'health'
        ELSE 'other' END || CASE WHEN low LIKE '%http://%' THEN '_http' ELSE '' END
    WHEN 'HIPAA Violation' THEN CASE WHEN low LIKE '%log%' OR low LIKE '%print%' OR low LIKE '%console%' THEN 'logs' ELSE 'stored' END
    WHEN 'PCI DSS Violation' THEN CASE WHEN low LIKE '%cvv%' OR low LIKE '%cvc%' OR contains(low, 'security_code') THEN 'cvv' ELSE 'number' END
    WHEN 'Missing Row-Level Security' THEN CASE WHEN contains(low, 'tenant_id') OR contains(low, 'org_id')
      OR contains(low, 'customer_id') OR contains(low, 'account_id') THEN 'tenant' ELSE 'plain' END
    WHEN 'Over-broad GRANT Permissions' THEN CASE WHEN up LIKE '%GRANT ALL%' THEN 'all' ELSE 'some' END
    WHEN 'Insecure View' THEN CASE WHEN up LIKE '%SECURE%' THEN 'secure' ELSE 'open' END
      || CASE WHEN contains(low, 'tenant_id') OR up LIKE '%WHERE%' THEN '_filtered' ELSE '' END
    WHEN 'Missing Ownership Check (BOLA/IDOR)' THEN CASE
      WHEN up LIKE '%UPDATE%' OR up LIKE '%DELETE%' THEN 'change' || CASE WHEN up LIKE '%WHERE%' THEN '_where' ELSE '' END
        || CASE WHEN up LIKE '%SELECT%' THEN '_select' ELSE '' END
      WHEN up LIKE '%SELECT%' THEN 'select'
      WHEN evidence LIKE '%@%' AND regexp_matches(evidence, 'get|post|put|delete') THEN 'api' ELSE 'other' END
    WHEN 'Excessive Privileges' THEN CASE WHEN agent = 'permission' THEN '' WHEN low LIKE '%accountadmin%' THEN 'admin' ELSE 'star' END
    ELSE '' END AS variant
  FROM (SELECT *, lower(evidence) AS low, upper(evidence) AS up FROM findings WHERE severity IN ('CRITICAL', 'HIGH'))),
enriched AS (
  SELECT v.*, t.* REPLACE (
      CASE WHEN generic THEN description ELSE pattern END AS pattern,
      CASE WHEN generic THEN severity || ' severity: ' || description ELSE reason END AS reason,
      CASE WHEN generic THEN CASE WHEN agent = 'privacy' THEN [ref_primary] ELSE []::VARCHAR[] END ELSE compliance END AS compliance,
      CASE WHEN generic THEN [description] ELSE factors END AS factors,
      CASE WHEN generic THEN recommendation ELSE fix END AS fix),
    CASE confidence WHEN 'HIGH' THEN if_high WHEN 'MEDIUM' THEN if_medium ELSE if_low END AS level,
    fixed_signals || CASE
      WHEN generic THEN [description]
      WHEN category = 'SQL Injection' THEN list_filter([
        CASE WHEN evidence LIKE '%+%' OR low LIKE '%concat%' THEN 'value added by an operator' END,
        CASE WHEN evidence LIKE '%format%' OR contains(evidence, '%') THEN 'value added by formatting' END,
        CASE WHEN evidence LIKE '%f''%' OR evidence LIKE '%f"%' THEN 'value inside an f-string' END,
        CASE WHEN low LIKE '%execute%' THEN 'run on the same line' END,
        CASE WHEN NOT (contains(evidence, '?') OR contains(evidence, '%s') OR contains(evidence, 'paramstyle')) THEN 'no bind marker' END],
        lambda x: x IS NOT NULL)
      WHEN category = 'Command Injection' THEN CASE WHEN low LIKE '%shell%' AND low LIKE '%true%' THEN ['shell=True'] ELSE [] END
      WHEN category = 'Over-broad GRANT Permissions' THEN list_filter(['grant',
        CASE WHEN up LIKE '%GRANT ALL%' THEN 'every privilege' END, CASE WHEN up LIKE '%PUBLIC%' THEN 'everybody' END], lambda x: x IS NOT NULL)
      ELSE [] END AS signals
  FROM variant_of v JOIN templates t ON t_agent = agent AND (
    (t_category = category AND t_variant = variant)
    OR (generic AND NOT EXISTS (SELECT 1 FROM templates s WHERE s.t_agent = v.agent AND s.t_category = v.category))))"""

# Ordered, distinct members of the lists of all records at a location.
def _union_of(column: str, cap: int | None = None) -> str:
    order = "agent_rank, sev_rank, rule_ordinal, match_ordinal"
    limit = f"WHERE nth <= {cap}" if cap else ""
    return f"""(SELECT repo, path, line_number, string_agg(member, '|' ORDER BY nth) AS members FROM (
      SELECT *, row_number() OVER (PARTITION BY repo, path, line_number ORDER BY first_at) AS nth FROM (
        SELECT repo, path, line_number, member, min(place) AS first_at FROM (
          SELECT repo, path, line_number, unnest({column}) AS member,
            (pos * 1000 + generate_subscripts({column}, 1))::BIGINT AS place
          FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, line_number ORDER BY {order}) AS pos FROM merging))
        GROUP BY ALL)) {limit} GROUP BY ALL)"""


def merged_sql() -> str:
    order = "agent_rank, sev_rank, rule_ordinal, match_ordinal"
    longest = lambda c: f"arg_min({c}, -len({c}) * 100000 + pos)"
    joins = {
        "signals": _union_of("signals", 10), "assets": _union_of("assets", 10), "compliance": _union_of("compliance"),
        "cves": _union_of("cves", 5), "strong": _union_of("strong", 10), "fixes": _union_of("fixes", 5),
        "weak": _union_of("applied_weak", 5), "missing": _union_of("missing"),
    }
    steps = f"""(SELECT repo, path, line_number, string_agg(step, '|' ORDER BY nth) AS members FROM (
      SELECT *, row_number() OVER (PARTITION BY repo, path, line_number ORDER BY place) AS nth FROM (
        SELECT repo, path, line_number, unnest(steps) || ' (' || agent || ')' AS step,
          (pos * 1000 + generate_subscripts(steps, 1))::BIGINT AS place FROM positioned))
      WHERE nth <= 8 GROUP BY ALL)"""
    select = f"""
SELECT g.repo, g.path, g.line_number, g.records, g.consensus_level, g.pattern, g.surface, g.vector, g.fix,
  g.sensitivity, g.rating, g.complexity, g.breaking, g.first_reasons, 'HIGH' AS confidence_level,
  {", ".join(f"coalesce(j_{n}.members, '') AS {n}" for n in joins)}, coalesce(j_steps.members, '') AS steps
FROM (
  SELECT repo, path, line_number, count(*)::INT AS records, any_value(consensus_level) AS consensus_level,
    {longest("pattern")} AS pattern, {longest("surface")} AS surface, {longest("vector")} AS vector, {longest("fix")} AS fix,
    arg_min(sensitivity, pos) AS sensitivity,
    arg_min(rating, coalesce(list_position(['Easy', 'Medium', 'Hard', 'Very Hard'], rating), 100) * 100000 + pos) AS rating,
    arg_min(complexity, -coalesce(list_position(['Easy', 'Medium', 'Hard'], complexity), 1) * 100000 + pos) AS complexity,
    bool_or(breaking) AS breaking,
    string_agg('[' || agent || '] ' || reason, '; ' ORDER BY pos) FILTER (pos <= 3) AS first_reasons
  FROM positioned GROUP BY repo, path, line_number) g
{" ".join(f"LEFT JOIN {sql} j_{n} USING (repo, path, line_number)" for n, sql in joins.items())}
LEFT JOIN {steps} j_steps USING (repo, path, line_number)"""
    merging = """
merging AS (
  SELECT e.*, a.consensus_level,
    CASE WHEN weak_when = 'always' OR (weak_when = 'unless_high' AND level <> 'HIGH') OR (weak_when = 'if_low' AND level = 'LOW')
      THEN weak ELSE [] END AS applied_weak
  FROM enriched e JOIN agents_at a USING (repo, path, line_number)
  WHERE consensus_level >= 2
  QUALIFY count(*) OVER (PARTITION BY e.repo, e.path, e.line_number) >= 2)"""
    positioned = f"""
positioned AS (
  SELECT *, row_number() OVER (PARTITION BY repo, path, line_number ORDER BY {order}) AS pos FROM merging)"""
    return consensus_sql(select, ENRICHED, merging.strip(), positioned.strip())
