"""Every rule against CPython's ``re`` on all fragments and on hard texts."""

from __future__ import annotations

import re

from lintlake.functions.rules import BUILTIN_RULES, RULES_BY_AGENT
from lintlake.operators.scan import regex_findings, regex_matches, rules_from_table
from workload.snippets import SNIPPETS

HARD_TEXTS = [
    "",
    "md5",
    "\n\nmd5\n",
    "x = 1\r",
    "MD5 md5( hashlib.md5\nmd5",
    "CREATE TABLE a (x INT);\n\n  create row access policy p;\nCREATE TABLE b (x INT);",
    "delete from users   where id = 1; DELETE FROM a.b WHERE 1; update q\nset a = 1; \n where x",
    "log 'a@b.co' " * 3 + "\nblog\"x 123-45-6789 y@z.org",
    "select a from b where c; select d from e where user_id = 1; select f from g where h",
    "create view v as select 1 from t where tenant_id = 2; create view w as select 1 from u",
    "GRANT SELECT ON TABLE t;\nGRANT SELECT ON TABLE u\nwhere",
    "café password = 'naïve-secret' # ünïcode\n" * 3,
    "create view  \n secure x",
    "update üser set a=1;",
    "CREATE TABLE café (id int);",
    "eval\u00a0(x)",
    "paſſword = 'longenough1'",
    "to\u212aen = 'prod-to\u212aen-value'; print(naïve_email)",
    "￿ password = '￿12345678￿'\n￿eval(￿",
]


def flags_of(rule):
    flags = re.UNICODE
    flags |= re.IGNORECASE if "i" in rule.flags else 0
    flags |= re.DOTALL if "s" in rule.flags else 0
    return flags


def expected(path, content, rules=BUILTIN_RULES):
    for rule in rules:
        for m in re.finditer(rule.pattern, content, flags_of(rule)):
            if any(re.search(s, m.group(0)) for s in rule.suppress):
                continue
            yield path, rule.rule_id, content.count("\n", 0, m.start()) + 1, m.group(0)


def test_every_rule_agrees_with_python(spark, files):
    pairs = [(f"r/f{i}{ext}", f"# head\n{code}\n") for i, (ext, code) in enumerate(SNIPPETS)]
    pairs += [(f"r/h{i}.txt", t) for i, t in enumerate(HARD_TEXTS)]
    pairs.append(("r/all.txt", "\n".join(code for _, code in SNIPPETS)))
    found = regex_matches(files(*pairs)).collect()
    got = sorted((r.path, BUILTIN_RULES[r.rule_ix].rule_id, r.line_number, r.match) for r in found)
    want = sorted(row for path, content in pairs for row in expected(path, content))
    assert got == want
    assert {rule for _, rule, _, _ in got} == {r.rule_id for r in BUILTIN_RULES}


def test_rule_table_counts():
    assert [len(RULES_BY_AGENT[a]) for a in ("security", "privacy", "permission")] == [23, 17, 15]
    levels = {a: [r.severity for r in RULES_BY_AGENT[a]] for a in RULES_BY_AGENT}
    assert [levels["security"].count(s) for s in ("CRITICAL", "HIGH", "MEDIUM")] == [9, 10, 4]
    assert [levels["privacy"].count(s) for s in ("CRITICAL", "HIGH", "MEDIUM")] == [7, 8, 2]
    assert [levels["permission"].count(s) for s in ("CRITICAL", "HIGH", "MEDIUM")] == [4, 7, 4]
    assert sum(r.has_lookahead for r in BUILTIN_RULES) == 11


def test_needs_never_hide_a_match():
    for rule in BUILTIN_RULES:
        for _, code in SNIPPETS:
            for m in re.finditer(rule.pattern, code, flags_of(rule)):
                low = code.lower()
                assert all(any(w in low for w in group) for group in rule.needs), rule.rule_id
                assert rule.gate is None or re.search(rule.gate, code, re.I), rule.rule_id
                assert m.group(0) != ""


def test_evidence_context_and_order(spark, files):
    long = "password = '" + "x" * 300 + "'"
    content = "one\ntwo\n" + long + "\nfour\nfive\nsix"
    row = regex_findings(files(("r/a.txt", content)), with_context=True).where("rule_id = 'S03'").collect()[0]
    assert len(row.evidence) == 200 and row.evidence.endswith("...")
    assert row.context.split("\n") == ["   1: one", "   2: two", f"   3: {long}", "   4: four", "   5: five"]


def test_one_line_with_many_matches(spark, files):
    """A file that is one long line: linear work, nothing lost."""
    content = "md5 " * 50_000 + "\nmd5"
    rows = regex_findings(files(("r/min.js", content))).where("rule_id = 'S14'").groupBy("line_number").count()
    assert {r["line_number"]: r["count"] for r in rows.collect()} == {1: 50_000, 2: 1}


def test_a_hard_line_without_an_address_is_quick(spark, files):
    """Backtracking over this line would never end; the gate rules it out."""
    rows = regex_findings(files(("r/a.txt", 'log "foo" user@host ' * 5000)), RULES_BY_AGENT["privacy"])
    assert rows.where("rule_id = 'V01'").count() == 0


def test_user_rules(spark, files):
    table = spark.createDataFrame(
        [("U1", "security", "Mark", "LOW", r"mark(\d+)", [["mark"]]), ("U2", "privacy", "Other", "HIGH", r"zz", None)],
        "rule_id string, agent string, category string, severity string, pattern string, needs array<array<string>>")
    rows = regex_findings(files(("r/a.txt", "mark1\nx mark22 zz")), rules_from_table(table)).collect()
    assert sorted((r.rule_id, r.line_number, r.evidence) for r in rows) == [
        ("U1", 1, "mark1"), ("U1", 2, "mark22"), ("U2", 2, "zz")]
