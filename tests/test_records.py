"""A table of records merged by location: gathered whole, and by what a merge reads."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lintlake.functions import reasoning
from lintlake.operators.records import merge_record_table
from lintlake.sources.records import parsed_lines, records_of, rejects_of


def record(draw, words):
    word = lambda: draw.choice(words)
    some = lambda most: [word() for _ in range(draw.randint(0, most))]
    maybe = lambda value: draw.choice([None, "", value])
    return {
        "detection": {"pattern_matched": word() * draw.randint(1, 3), "detection_method": word(), "signals_observed": some(3)},
        "risk": {"severity_reasoning": word(), "impact_description": word(), "affected_assets": some(2), "attack_surface": word(),
                 "data_sensitivity": maybe(word()), "compliance_impact": draw.choice([None, some(2)])},
        "attack": {"attack_vector": word(), "attack_steps": some(3), "required_access": word(),
                   "exploitability_rating": draw.choice(["Easy", "Hard", "Medium", "?"]), "similar_cves": draw.choice([None, some(2)]),
                   "exploit_examples": maybe(word())},
        "confidence": {"confidence_level": draw.choice(["HIGH", "LOW"]), "primary_factors": some(2), "strong_evidence": some(2),
                       "weak_evidence": some(1)},
        "remediation": {"recommended_fix": word(), "fix_rationale": word(), "alternative_fixes": some(2), "tradeoffs": maybe(word()),
                        "implementation_complexity": draw.choice(["Easy", "Hard", "?"]), "breaking_changes": draw.random() < 0.1,
                        "testing_guidance": maybe(word())},
        "context": draw.choice([None, {"function_purpose": maybe(word()), "data_flow": word(), "surrounding_controls": some(1),
                                       "missing_controls": some(2)}]),
        "false_positive": draw.choice([None, {"is_likely_false_positive": draw.random() < 0.2, "reasoning": word(),
                                              "ambiguity_factors": some(1), "confidence_boosters": some(2), "confidence_detractors": some(1)}]),
        "alternatives": draw.choice([None, {"possible_legitimate_uses": some(1), "counterarguments": some(2),
                                            "requires_human_judgment": draw.random() < 0.1}]),
        "generated_at": "t",
    }


def lines_of(spark, rows):
    return spark.createDataFrame([(None if r is None else r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


@pytest.fixture(scope="module")
def lines(spark):
    draw = random.Random(4)
    rows = []
    for line, size, vocabulary in ((1, 400, 1000), (2, 300, 12), (3, 2, 50), (4, 1, 50), (5, 40, 3)):
        words = [f"w{i}" for i in range(vocabulary)]
        for i in range(size):
            rows.append({"repo": "r", "path": "p", "line_number": line, "ordinal": i // 3,
                         "agent": draw.choice(["security", "privacy", "permission", "other"]) if line != 5 else "privacy",
                         "record": record(draw, words)})
    # Copies word for word, as many as a third of all.
    rows += [rows[0]] * 250
    return lines_of(spark, rows)


def test_reduced_merge_equals_the_merge_of_all(lines):
    records = records_of(parsed_lines(lines))
    assert records.count() == lines.count()
    shown = ["line_number", "records", "agents", F.to_json("merged").alias("merged")]
    whole = {r["line_number"]: r for r in merge_record_table(records, at_once=10**6).select(*shown).collect()}
    for at_once in (1, 20):
        assert {r["line_number"]: r for r in merge_record_table(records, at_once).select(*shown).collect()} == whole
    assert whole[1]["records"] == 650 and whole[1]["agents"] == ["other", "permission", "privacy", "security"]
    single = json.loads(whole[4]["merged"])
    assert single["confidence"]["agent_agreement"] == 1 and single["confidence"]["agreement_details"].startswith("Single reviewer")
    alone = json.loads(whole[5]["merged"])
    assert alone["confidence"]["agent_agreement"] == 1 and alone["generated_by_agent"] == "consensus"


def test_rejects_keep_their_lines_and_reasons(spark):
    good = {"repo": "r", "path": "p", "line_number": 1, "agent": "security", "record": record(random.Random(1), ["a", "b"])}
    unplaced, partial = {**good, "path": None}, {**good, "record": {**good["record"], "risk": None}}
    rows = [good, None, "", "no json", "[1]", '{"line_number": "x"}', json.dumps(good)[:-9], unplaced, partial]
    parsed = parsed_lines(lines_of(spark, rows))
    assert records_of(parsed).count() == 1
    reasons = sorted(r["reason"] for r in rejects_of(parsed).collect())
    assert reasons == ["incomplete", "no place or reviewer", *["not a record"] * 6]
    # A list that is missing is empty.
    short = {**good, "record": {**good["record"], "attack": {"attack_vector": "v"}}}
    both = records_of(parsed_lines(lines_of(spark, [good, {**short, "agent": "privacy"}])))
    assert merge_record_table(both).select("merged.attack.attack_steps").first()[0] is not None


def test_merge_in_the_order_of_reviewers(spark):
    rows = []
    for agent, text, extra in (("other", "long text", None), ("privacy", "b", {"is_likely_false_positive": True, "reasoning": "x"}),
                               ("security", "a", {"is_likely_false_positive": False, "reasoning": "y", "ambiguity_factors": ["z"]})):
        one = record(random.Random(2), ["q"])
        one["detection"]["pattern_matched"] = text
        one["risk"]["severity_reasoning"] = f"because {text}"
        one["false_positive"], one["alternatives"] = extra, {"counterarguments": [text], "requires_human_judgment": agent == "other"}
        rows.append({"repo": "r", "path": "p", "line_number": 7, "agent": agent, "record": one})
    for at_once in (1, 10):
        merged = merge_record_table(records_of(parsed_lines(lines_of(spark, rows))), at_once).first()["merged"]
        assert merged["detection"]["pattern_matched"] == "long text"
        assert merged["risk"]["severity_reasoning"] == "[security] because a; [privacy] because b; [other] because long text"
        assert merged["false_positive"]["is_likely_false_positive"] and merged["false_positive"]["reasoning"] == "y; x"
        assert merged["false_positive"]["ambiguity_factors"] == ["z"]
        assert merged["alternatives"]["counterarguments"] == ["a", "b", "long text"] and merged["alternatives"]["requires_human_judgment"]


def test_no_records(spark):
    parsed = parsed_lines(lines_of(spark, []))
    assert merge_record_table(records_of(parsed)).count() == 0 and reasoning.RECORD_TYPE == merge_record_table(records_of(parsed)).schema["merged"].dataType
