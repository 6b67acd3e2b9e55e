"""Merging the reasoning records of several reviewers.

Works on an ordered array of ``struct<agent, record>``; every element keeps its
own reviewer's name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.functions.reasoning import RECORD_TYPE, STRINGS

MERGED_BY = "consensus"

# How much of each list a merged record keeps, and the orders by
# which ratings compare.
SUMMARY_CHARS, IMPACT_CHARS = 200, 500
MAX_SIGNALS, MAX_REASONS, MAX_ASSETS = 10, 3, 10
MAX_STEPS, MAX_CVES = 8, 5
MAX_FACTORS, MAX_STRONG, MAX_WEAK = 5, 10, 5
MAX_RATIONALES, MAX_FIXES, MAX_TESTS = 2, 5, 2
MAX_FP_REASONS, MAX_FP_MARKS = 2, 5
EASE = ["Easy", "Medium", "Hard", "Very Hard"]
EASE_UNKNOWN = 99
EFFORT = ["Easy", "Medium", "Hard"]
EFFORT_UNKNOWN = 0

Part = Callable[[Column], Column]


def _each(items: Column, part: Part) -> Column:
    return F.transform(items, part)


def _union(items: Column, part: Part) -> Column:
    """Distinct members of all lists, in the order first seen."""
    lists = F.transform(items, lambda x: F.coalesce(part(x), F.array().cast(STRINGS)))
    return F.array_distinct(F.flatten(lists))


def _first(values: Column, count: int) -> Column:
    return F.slice(values, 1, count)


def _present(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def _longest(values: Column) -> Column:
    """The longest text, the first one on a tie."""
    return F.reduce(
        values,
        F.lit(None).cast("string"),
        lambda best, v: F.when(best.isNull() | (F.length(v) > F.length(best)), v).otherwise(best),
    )


def _rank(value: Column, order: list[str], unknown: int) -> Column:
    position = F.array_position(F.array(*[F.lit(o) for o in order]), value)
    return F.when(position > 0, position - 1).otherwise(F.lit(unknown)).cast("int")


def _first_by(values: Column, key: Part) -> Column:
    """The value with the smallest key, the first one on a tie."""
    ranked = F.transform(
        values, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"), v.alias("v")))
    return F.array_min(ranked)["v"]


def _none_if_empty(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def _tagged(items: Column, part: Part, style: str) -> Column:
    """All members of a list, each marked with its reviewer."""
    def mark(x: Column) -> Column:
        return F.transform(part(x), lambda v: F.format_string(style, x["agent"], v))

    return F.flatten(F.transform(items, mark))


def merged_record(items: Column, level: Column, agents: Column) -> Column:
    """One record for two or more reviewers' records at the same place."""
    patterns = _each(items, lambda x: x["record"]["detection"]["pattern_matched"])
    pattern = _longest(patterns)
    names = F.array_distinct(_each(items, lambda x: x["agent"]))
    detection = F.struct(
        pattern,
        F.substring(
            F.concat(pattern, F.lit(" (seen by "), F.size(names).cast("string"), F.lit(" reviewers: "),
                     F.array_join(names, ", "), F.lit(")")), 1, SUMMARY_CHARS),
        F.array_join(F.array_distinct(_each(items, lambda x: x["record"]["detection"]["detection_method"])), " + "),
        _first(_union(items, lambda x: x["record"]["detection"]["signals_observed"]), MAX_SIGNALS),
        F.lit(MERGED_BY), F.lit("agreement"),
    )
    reasons = _tagged(items, lambda x: F.array(x["record"]["risk"]["severity_reasoning"]), "[%s] %s")
    risk = F.struct(
        F.array_join(_first(reasons, MAX_REASONS), "; "),
        F.substring(
            F.array_join(F.array_distinct(_each(items, lambda x: x["record"]["risk"]["impact_description"])), ". "),
            1, IMPACT_CHARS),
        _first(_union(items, lambda x: x["record"]["risk"]["affected_assets"]), MAX_ASSETS),
        _longest(_each(items, lambda x: x["record"]["risk"]["attack_surface"])),
        F.get(_present(_each(items, lambda x: x["record"]["risk"]["data_sensitivity"])), F.lit(0)),
        _none_if_empty(_union(items, lambda x: x["record"]["risk"]["compliance_impact"])),
    )
    steps = F.flatten(F.transform(
        items,
        lambda x: F.transform(
            x["record"]["attack"]["attack_steps"], lambda s: F.format_string("%s (%s)", s, x["agent"]))))
    attack = F.struct(
        _longest(_each(items, lambda x: x["record"]["attack"]["attack_vector"])),
        _first(steps, MAX_STEPS),
        F.array_join(F.array_distinct(_each(items, lambda x: x["record"]["attack"]["required_access"])), ", or "),
        _first_by(_each(items, lambda x: x["record"]["attack"]["exploitability_rating"]),
                  lambda v: _rank(v, EASE, EASE_UNKNOWN)),
        _none_if_empty(_first(_union(items, lambda x: x["record"]["attack"]["similar_cves"]), MAX_CVES)),
        F.get(_present(_each(items, lambda x: x["record"]["attack"]["exploit_examples"])), F.lit(0)),
    )
    factors = _tagged(items, lambda x: x["record"]["confidence"]["primary_factors"], "[%s] %s")
    confidence = F.struct(
        F.when(level >= 2, F.lit("HIGH")).otherwise(
            F.get(_each(items, lambda x: x["record"]["confidence"]["confidence_level"]), F.lit(0))),
        F.concat(
            F.array(F.concat(level.cast("string"), F.lit(" reviewers found this independently"))),
            _first(factors, MAX_FACTORS)),
        _first(_union(items, lambda x: x["record"]["confidence"]["strong_evidence"]), MAX_STRONG),
        _first(_union(items, lambda x: x["record"]["confidence"]["weak_evidence"]), MAX_WEAK),
        level,
        F.concat(level.cast("string"), F.lit(" reviewers agree ("), F.array_join(agents, ", "), F.lit(")")),
    )
    tests = _present(_each(items, lambda x: x["record"]["remediation"]["testing_guidance"]))
    remediation = F.struct(
        _longest(_each(items, lambda x: x["record"]["remediation"]["recommended_fix"])),
        F.array_join(
            _first(F.array_distinct(_each(items, lambda x: x["record"]["remediation"]["fix_rationale"])),
                   MAX_RATIONALES), ". "),
        _first(_union(items, lambda x: x["record"]["remediation"]["alternative_fixes"]), MAX_FIXES),
        F.get(_present(_each(items, lambda x: x["record"]["remediation"]["tradeoffs"])), F.lit(0)),
        _first_by(_each(items, lambda x: x["record"]["remediation"]["implementation_complexity"]),
                  lambda v: -_rank(v, EFFORT, EFFORT_UNKNOWN)),
        F.exists(items, lambda x: F.coalesce(x["record"]["remediation"]["breaking_changes"], F.lit(False))),
        F.when(F.size(tests) > 0, F.array_join(_first(tests, MAX_TESTS), "; ")),
    )

    def having(part: str) -> Column:
        return F.filter(items, lambda x: x["record"][part].isNotNull())

    contexts = having("context")
    main = F.reduce(
        contexts,
        F.lit(None).cast(RECORD_TYPE["context"].dataType),
        lambda best, x: F.when(
            best.isNull()
            | (F.length(F.coalesce(x["record"]["context"]["function_purpose"], F.lit("")))
               > F.length(F.coalesce(best["function_purpose"], F.lit("")))),
            x["record"]["context"]).otherwise(best),
    )
    context = F.when(
        F.size(contexts) > 0,
        F.struct(
            main["function_purpose"], main["data_flow"],
            _union(contexts, lambda x: x["record"]["context"]["surrounding_controls"]),
            _union(contexts, lambda x: x["record"]["context"]["missing_controls"]),
            main["file_purpose"], main["framework_context"]))
    doubts = having("false_positive")
    false_positive = F.when(
        F.size(doubts) > 0,
        F.struct(
            F.exists(doubts, lambda x: F.coalesce(x["record"]["false_positive"]["is_likely_false_positive"], F.lit(False))),
            F.array_join(_first(_each(doubts, lambda x: x["record"]["false_positive"]["reasoning"]), MAX_FP_REASONS), "; "),
            _union(doubts, lambda x: x["record"]["false_positive"]["ambiguity_factors"]),
            F.lit(None).cast("string"),
            _first(_union(doubts, lambda x: x["record"]["false_positive"]["confidence_boosters"]), MAX_FP_MARKS),
            _first(_union(doubts, lambda x: x["record"]["false_positive"]["confidence_detractors"]), MAX_FP_MARKS)))
    others = having("alternatives")
    alternatives = F.when(
        F.size(others) > 0,
        F.struct(
            _union(others, lambda x: x["record"]["alternatives"]["possible_legitimate_uses"]),
            _union(others, lambda x: x["record"]["alternatives"]["counterarguments"]),
            F.exists(others, lambda x: F.coalesce(x["record"]["alternatives"]["requires_human_judgment"], F.lit(False)))))
    first = F.get(items, F.lit(0))
    return F.struct(
        detection, risk, attack, confidence, remediation, context, false_positive, alternatives,
        F.lit(MERGED_BY), first["record"]["generated_at"],
    ).cast(RECORD_TYPE)


def single_record(items: Column) -> Column:
    """The only record there is, marked as a single reviewer's."""
    only = F.get(items, F.lit(0))
    return only["record"].withField("confidence.agent_agreement", F.lit(1)).withField(
        "confidence.agreement_details", F.concat(F.lit("Single reviewer: "), only["agent"]))


def merge_records(items: Column, level: Column, agents: Column) -> Column:
    """No record for an empty array, the marked record for one, else the merge."""
    return (
        F.when(F.size(items) == 0, F.lit(None).cast(RECORD_TYPE))
        .when(F.size(items) == 1, single_record(items).cast(RECORD_TYPE))
        .otherwise(merged_record(items, level, agents))
    )
