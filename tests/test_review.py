"""Reviewers, syntax checks, consensus."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from lintlake.operators.consensus import consensus, consensus_with_reasoning, consensus_within, filter_min_severity
from lintlake.operators.pyfacts import ast_findings, file_facts, py_facts
from lintlake.operators.review import number_in_file, review
from lintlake.plans.audit import audit
from workload.golden_facts import golden_rows
from workload.snippets import SNIPPETS


def test_facts_match_the_golden_rows():
    got = []
    for i, (ext, code) in enumerate(SNIPPETS):
        for f in file_facts(code + "\n") if ext == ".py" else ():
            args = None if f.get("args") is None else ";".join(",".join(a) for a in f["args"])
            cells = [i, f["fact_ordinal"], f["kind"], f["line"], f["end_line"], f.get("name"), f.get("func_name"),
                     f.get("value_str"), f.get("arg0_kind"), f.get("shell_true"), args]
            got.append([None if c is None else str(c) for c in cells])
    assert got == golden_rows()


def test_files_that_do_not_parse_yield_nothing():
    assert list(file_facts("def (:\n")) == []
    assert list(file_facts("x = 1\0")) == []
    assert list(file_facts("(" * 5000)) == []


def test_syntax_checks(spark, files):
    code = "\n".join([
        "password = 'hunter2hunter'",
        "token = 'changeme'",
        "db.execute(f'select {x}')",
        "eval(x)",
        "subprocess.run(c)",
        "subprocess.run(c, shell=True)",
        "random.random()",
        "print(user.ssn, user.email)",
        "diagnosis = aes(x)",
        "s = 'lone \\ud800 surrogate'",
    ])
    rows = ast_findings(py_facts(files(("r/a.py", code), ("r/a.sql", code)), with_content=True), with_context=True).collect()
    got = sorted((r.rule_id, r.line_number, r.severity, r.evidence) for r in rows)
    assert got == [
        ("E1", 1, "CRITICAL", "password = 'hunter2hunter...'"),
        ("E2", 3, "CRITICAL", "SQL query uses f-string interpolation"),
        ("E3", 4, "CRITICAL", "Dangerous function call: eval"),
        ("E3", 6, "HIGH", "Dangerous function call: subprocess.run with shell=True"),
        ("E4", 7, "MEDIUM", "Insecure function: random.random"),
        ("E5", 8, "CRITICAL", "Logging PII field in statement at line 8"),
        ("E6", 1, "CRITICAL", "Sensitive field 'password' without encryption"),
    ]
    context = {r.rule_id: r.context for r in rows}
    assert context["E4"] is None
    assert context["E1"].split("\n")[0] == "   1: password = 'hunter2hunter'"


def test_switch_and_reviewer_choice(spark, files):
    corpus = files(("r/a.py", "eval(x)\nUSE ROLE ACCOUNTADMIN"))
    assert {r.detector for r in review(corpus, syntax=False).collect()} == {"regex"}
    assert {r.agent for r in review(corpus, ["permission"]).collect()} == {"permission"}


def test_multi_issue_script(spark, files):
    script = (
        "CREATE TABLE sales.orders (id INT, tenant_id INT);\n"
        "GRANT ALL ON SCHEMA sales TO ROLE analyst;\n"
        "USE ROLE ACCOUNTADMIN;\n"
        "CREATE VIEW v AS SELECT id FROM sales;\n")
    found = {r.category for r in review(files(("r/s.sql", script)), ["permission"]).collect()}
    assert {"Missing Row-Level Security", "Over-broad GRANT Permissions", "ACCOUNTADMIN Misuse", "Insecure View"} <= found


def test_numbering_follows_severity_then_line(spark, files):
    rows = number_in_file(review(files(("r/a.py", "x = hashlib.sha1(b)\ny = hashlib.md5(b)\npassword = 'abcdefgh1'")))).collect()
    rows.sort(key=lambda r: r.number)
    assert [r.number for r in rows] == list(range(1, len(rows) + 1))
    assert [(r.sev_rank, r.line_number) for r in rows] == sorted((r.sev_rank, r.line_number) for r in rows)


AGENTS = ["security", "privacy", "permission"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM"]


def made_findings(spark, seed, files=6, per_file=40, lines=30):
    rng = random.Random(seed)
    rows = []
    for f, k in itertools.product(range(files), range(per_file)):
        a, s = rng.randrange(3), rng.randrange(3)
        rows.append(("r", f"r/f{f}", AGENTS[a], a, "regex", f"{AGENTS[a][0]}{k}", k, 0, "Cat", SEVERITIES[s], s, "HIGH",
                     rng.randrange(1, lines), f"e{k}", "do", "ref", None, "desc"))
    return spark.createDataFrame(
        rows, "repo string, path string, agent string, agent_rank int, detector string, rule_id string, rule_ordinal int, "
        "match_ordinal int, category string, severity string, sev_rank int, confidence string, line_number int, "
        "evidence string, recommendation string, ref_primary string, ref_secondary string, description string"), rows


def test_consensus_by_brute_force(spark):
    frame, rows = made_findings(spark, 7)
    groups = {}
    for r in rows:
        groups.setdefault((r[1], r[12]), []).append(r)
    want = {
        key: (min(g, key=lambda r: (r[10], r[3], r[6], r[7]))[5], len({r[2] for r in g}), sorted({r[2] for r in g}), len(g))
        for key, g in groups.items()}
    got = {(r.path, r.line_number): (r.rule_id, r.consensus_level, r.agreeing_agents, r.findings_merged)
           for r in consensus(frame).collect()}
    assert got == want


def test_consensus_of_files_equals_that_of_findings(spark, files):
    corpus = files(*((f"r{i % 3}/f{i}{ext}", f"{code}\n{code}\n") for i, (ext, code) in enumerate(SNIPPETS)))
    inside = audit(corpus, min_severity="LOW")
    table = consensus(review(corpus))
    assert inside.columns == table.columns
    assert sorted(map(str, inside.collect())) == sorted(map(str, table.collect())) != []
    assert audit(corpus.limit(0)).collect() == [] and consensus(review(corpus.limit(0))).collect() == []


def test_consensus_of_repeated_rows(spark):
    frame, rows = made_findings(spark, 11, files=2, per_file=10, lines=4)
    once, twice = (
        {(r.path, r.line_number): r for r in consensus(f).collect()} for f in (frame, frame.unionByName(frame)))
    assert {k: r.rule_id for k, r in once.items()} == {k: r.rule_id for k, r in twice.items()}
    assert all(2 * r.findings_merged == twice[k].findings_merged for k, r in once.items())
    nowhere = frame.withColumn("repo", F.lit(None).cast("string"))
    assert consensus(nowhere).count() == len(once)


def test_plans_of_review_and_consensus(spark, files):
    """One scan and no shuffle for a corpus; no sort for a table of findings."""
    corpus = files(("r/a.py", "eval(x)"))
    plan = audit(corpus)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "artitioning" not in plan
    frame, _ = made_findings(spark, 3)
    grouped = consensus(frame)
    grouped.collect()
    plan = grouped._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortAggregate" not in plan and "Sort [" not in plan and "SortMergeJoin" not in plan and "ReusedExchange" in plan


def test_tolerance_by_brute_force(spark):
    frame, rows = made_findings(spark, 8, per_file=12, lines=60)
    want = set()
    for path in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == path), key=lambda r: r[12])
        islands = [[mine[0]]]
        for r in mine[1:]:
            if r[12] - islands[-1][-1][12] <= 2:
                islands[-1].append(r)
            else:
                islands.append([r])
        for g in islands:
            best = min(g, key=lambda r: (r[10], r[3], r[6], r[7], r[12]))
            want.add((path, best[5], g[0][12], g[-1][12], len({r[2] for r in g}), len(g)))
    got = {(r.path, r.rule_id, r.first_line, r.last_line, r.consensus_level, r.findings_merged)
           for r in consensus_within(frame).collect()}
    assert got == want


def test_facts_of_a_one_line_file_are_linear(spark, files):
    few, many = (files(("r/a.py", "password = 1; print(email); " * n)) for n in (1_000, 20_000))
    size = lambda c: py_facts(c).select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    assert size(many) < 25 * size(few)
    assert ast_findings(py_facts(many, with_content=True), with_context=True).count() == 40_000


def test_reasoning_does_not_change_the_consensus(spark, files):
    corpus = files(*[(f"r/f{i}{ext}", code) for i, (ext, code) in enumerate(SNIPPETS)])
    found = review(corpus)
    columns = ["path", "line_number", "rule_id", "severity", "consensus_level", "agreeing_agents"]
    plain = consensus(found).select(*columns)
    rich = consensus_with_reasoning(found, "T")
    key = lambda r: (r.path, r.line_number)
    assert sorted(plain.collect(), key=key) == sorted(rich.select(*columns).collect(), key=key)
    strong = rich.where("severity in ('CRITICAL', 'HIGH')")
    assert strong.where("cot is null").count() == 0
    assert rich.where("severity = 'MEDIUM' and cot is not null").count() == 0


def test_repeats_on_a_hot_line_do_not_change_the_merge(spark, files):
    one = "print('patient') ; DELETE FROM patient ; "
    few = files(("r/a.sh", one * 8))
    many = files(("r/a.sh", one * 3000))
    merged = [
        [r.cot for r in consensus_with_reasoning(review(c, syntax=False), "T").collect()] for c in (few, many)]
    assert len(merged[0]) == 1
    strip = lambda c: c.asDict(True) | {"generated_at": None}
    assert strip(merged[0][0]) == strip(merged[1][0])


def test_reasoning_keeps_a_severe_finding_among_many_repeats(spark, files):
    """One check yields HIGH and CRITICAL under one rule and one template; the CRITICAL one comes ninth."""
    line = "; ".join(["print(email)"] * 8 + ["print(ssn)"])
    corpus = files(("r/a.py", line), ("r/b.py", "print(email); " * 20))
    found = review(corpus)
    shared = consensus(found).columns
    plain = {tuple(r) for r in consensus(found).select(*[c for c in shared if c != "agreeing_agents"]).collect()}
    rich = {tuple(r) for r in consensus_with_reasoning(found, "T").select(*[c for c in shared if c != "agreeing_agents"]).collect()}
    assert plain == rich
    assert audit(corpus, min_severity="CRITICAL").count() == audit(corpus, min_severity="CRITICAL", reasoning=True, generated_at="T").count() == 1


def test_severity_filter_runs_after_consensus(spark, files):
    corpus = files(("r/a.sql", "USE ROLE ACCOUNTADMIN;"))
    rows = audit(corpus, min_severity="CRITICAL").collect()
    assert [(r.rule_id, r.consensus_level) for r in rows] == [("P06", 2)]


def test_unknown_severities_drop_out(spark):
    frame, _ = made_findings(spark, 9)
    odd = frame.withColumn("sev_rank", F.lit(5))
    assert filter_min_severity(odd, "LOW").count() == 0
    try:
        filter_min_severity(frame, "INFO")
    except ValueError as error:
        assert "min_severity" in str(error)
    else:
        raise AssertionError("INFO must be refused")


def test_findings_and_audit_share_one_scan_of_the_files(spark, files):
    from lintlake.operators.review import file_findings, findings_of_files
    from lintlake.plans.audit import audit, audit_of_files

    corpus = files(("r/a.py", 'print(eval("1"))\npassword = "correct horse"\n'), ("r/b.sql", "USE ROLE ACCOUNTADMIN;\n"), ("r/c.md", "none"))
    scanned = file_findings(corpus).select("repo", "path", "found").localCheckpoint()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(findings_of_files(scanned)) == rows(review(corpus)) != []
    assert rows(audit_of_files(scanned)) == rows(audit(corpus)) != []
