"""Rule tables too large for one expression each."""

from __future__ import annotations

import random
import re

import pytest

from lintlake.functions.rules import BUILTIN_RULES
from lintlake.operators import rule_index
from lintlake.operators.scan import regex_matches

SCHEMA = "rule_id string, agent string, category string, severity string, flags string, pattern string"


@pytest.mark.parametrize("pattern,literals", [
    ("abcd", ["abcd"]),
    ("abc?d", ["ab", "d"]),
    ("(pre|post)fix.*tail", ["p", "fix", "tail"]),
    ("a(?:bc)+d(ef)*g", ["bc", "a", "d", "g"]),
    ("[xy]z{2,}q", ["z", "q"]),
    ("(?!never)only", ["only"]),
    ("one|two", []),
    (r"\\Qa.b\\E", []),
    ("(?i:mixed)case", ["case"]),
    ("(unclosed", []),
])
def test_required_literals(pattern, literals):
    assert sorted(rule_index.required_literals(pattern)) == sorted(literals)


def test_keys_prefer_long_and_rare_literals():
    key = lambda p: rule_index.literal_key(p).to_bytes(8, "little").rstrip(b"\0")
    assert len(key("etaoin")) == 4
    assert key("Password.*zx_9") == b"password" and rule_index.literal_key("ab|cd") == rule_index.literal_key("abc") == -1
    wanted = rule_index.np.array(sorted(map(rule_index.literal_key, ["password", "zx_9", "absent99"])), dtype="uint64")
    assert sorted(rule_index.held_keys("the PASSWORD zx_9", wanted)) == sorted([-1, rule_index.literal_key("password"), rule_index.literal_key("zx_9")])
    for short in ("", "a", "ab", "abc", "zx_9", "zx_9abc"):
        assert (len(rule_index.held_keys(short, wanted)) == 2) == ("zx_9" in short)


def test_literals_stand_in_every_match():
    texts = ['api_key = "QWERTYuiop1234567890ABCD"', "-----BEGIN RSA PRIVATE KEY-----", "GRANT ALL ON SCHEMA s TO ROLE r", "x = eval (y)"]
    for rule in BUILTIN_RULES:
        flags = (re.I if "i" in rule.flags else 0) | (re.S if "s" in rule.flags else 0)
        for content in texts:
            for match in re.finditer(rule.pattern, content, flags):
                held = rule_index.folded(match.group())
                assert all(rule_index.folded(x) in held for x in rule_index.required_literals(rule.pattern) if x.isascii())


def test_built_in_rules_through_the_index(spark, files):
    """The index gives what a scan with one expression per rule gives."""
    from workload.snippets import SNIPPETS

    corpus = files(*((f"r/f{i}{ext}", code) for i, (ext, code) in enumerate(SNIPPETS)))
    rules = [r for r in BUILTIN_RULES if not r.suppress]
    table = spark.createDataFrame([(r.rule_id, r.agent, r.category, r.severity, r.flags, r.pattern) for r in rules], SCHEMA)
    got = {(r.path, r.rule_id, r.match_ordinal, r.line_number) for r in rule_index.indexed_findings(corpus, table).collect()}
    want = {(r.path, rules[r.rule_ix].rule_id, r.match_ordinal, r.line_number) for r in regex_matches(corpus, rules).collect()}
    assert got == want and len(want) > 100


def test_ten_thousand_rules_by_brute_force(spark, files):
    draw = random.Random(4)
    syllables = ["ka", "to", "mi", "ré", "sun", "dor", "LIN", "x_", "9"]
    words = ["".join(draw.choices(syllables, k=draw.randint(2, 4))) for _ in range(2500)]
    rules = [(f"U{i}", "security", "Own", "LOW", draw.choice(["", "i"]), re.escape(draw.choice(words)) + draw.choice(["", r"\\s+\\d", "(!|;)", "[a-z]?"]))
             for i in range(10_000)]
    rules += [("any1", "privacy", "Own", "HIGH", "", r"\\b\\d{3}\\b"), ("kelvin", "privacy", "Own", "HIGH", "i", "okay"), ("gone", "privacy", "Own", "HIGH", "", "nowhere at all")]
    pairs = [(f"r/f{i}.py", " ".join(draw.choices(words + ["123", "!", ";", "\\n"], k=40))) for i in range(30)]
    pairs += [("r/empty.py", ""), ("r/fold.py", "O\u212aAY and o\u212aay")]
    table = spark.createDataFrame(rules, SCHEMA)
    found = rule_index.indexed_findings(files(*pairs), table)
    got = sorted((r.path, r.rule_id, r.match_ordinal, r.line_number) for r in found.collect())
    want = sorted(
        (path, rule[0], n, content.count("\n", 0, m.start()) + 1)
        for path, content in pairs for rule in rules
        for n, m in enumerate(re.finditer(rule[5], content, re.I if rule[4] else 0)))
    assert got == want and len(want) > 1000
    few = rule_index.indexed_findings(files(*pairs), table.limit(3))
    size = lambda df: len(df._jdf.queryExecution().analyzed().toString())
    assert size(found) < size(few) * 1.2
    assert rule_index.indexed_findings(files(*pairs), table.limit(0)).collect() == []


def test_wrong_rules_are_an_error(spark, files):
    table = spark.createDataFrame([("U1", "nobody", "Own", "LOW", "", "abcd")], SCHEMA)
    with pytest.raises(Exception, match="rule U1: unknown agent"):
        rule_index.indexed_findings(files(("r/a.py", "abcd")), table).collect()


def test_a_rule_is_tried_only_where_all_its_literals_stand():
    needs = rule_index.literal_needs(r"people\s+remember")
    numbers = rule_index.Needs([(7, [rule_index._signed(n) for n in needs]), (9, []), (8, [])])
    assert numbers.held("few REMEMBER the\npeople") == [9, 8, 7]
    assert numbers.held("they remember") == numbers.held("people of note") == numbers.held("") == [9, 8]


def test_needs_stand_in_every_match():
    for pattern, match in ((r"alpha\s+b(et)+a_gamma", "alpha  betet" + "a_gamma"), (r"(?:api|key)_secret\w*", "api_secret1"), (r"\d+", "1")):
        needs = rule_index.literal_needs(pattern)
        assert rule_index.Needs([(1, [rule_index._signed(n) for n in needs])]).held(match) == [1]
        assert (needs == []) == (pattern == r"\d+")
