"""Merging a table of reasoning records by location, however many meet at one.

A merge reads the first members of lists, the first bringers of distinct members
and the best of some texts.  Where more records meet than one row should hold,
those that the merge would read are found by aggregates and ranks which combine
before the shuffle, and only they are gathered; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import merge
from lintlake.functions.constants import computed_once
from lintlake.functions.reasoning import STRINGS
from lintlake.functions.severity import AGENTS
from lintlake.operators.consensus import LOCATION, REPEATS_READ

# So many records of one location are gathered as they are.
RECORDS_AT_ONCE = 256
# Parts of a location that has more.
PARTS = 32
PLACE = ["_rank", "agent", "ordinal", "_digest"]

# Lists whose distinct members are merged, and how many of them; None is all.
UNIONS = {
    "detection.signals_observed": merge.MAX_SIGNALS, "risk.affected_assets": merge.MAX_ASSETS, "risk.compliance_impact": None,
    "attack.similar_cves": merge.MAX_CVES, "confidence.strong_evidence": merge.MAX_STRONG,
    "confidence.weak_evidence": merge.MAX_WEAK, "remediation.alternative_fixes": merge.MAX_FIXES,
    "context.surrounding_controls": None, "context.missing_controls": None, "false_positive.ambiguity_factors": None,
    "false_positive.confidence_boosters": merge.MAX_FP_MARKS, "false_positive.confidence_detractors": merge.MAX_FP_MARKS,
    "alternatives.possible_legitimate_uses": None, "alternatives.counterarguments": None,
}
# Texts whose distinct values are joined.
DISTINCT = {
    "detection.detection_method": None, "risk.impact_description": None, "attack.required_access": None,
    "remediation.fix_rationale": merge.MAX_RATIONALES,
}
LONGEST = ["detection.pattern_matched", "risk.attack_surface", "attack.attack_vector", "remediation.recommended_fix"]
FIRST_PRESENT = ["risk.data_sensitivity", "attack.exploit_examples", "remediation.tradeoffs", "remediation.testing_guidance"]
LEADING_LISTS = ["attack.attack_steps", "confidence.primary_factors"]
ANY = ["remediation.breaking_changes", "false_positive.is_likely_false_positive", "alternatives.requires_human_judgment"]


def _field(name: str) -> Column:
    return F.col(f"record.{name}")


def _ranked_claims() -> Column:
    """What a record may be read for by its place in some order: ``field, key``, the smallest key first."""
    def claim(name: str, key: Column, condition: Column | bool = True) -> Column:
        return F.when(F.lit(condition) if condition is True else condition,
                      F.struct(F.lit(name).alias("field"), F.coalesce(key.cast("int"), F.lit(2**31 - 1)).alias("key")))

    def position(name: str, order: list[str], unknown: int) -> Column:
        at = F.array_position(F.array(*[F.lit(o) for o in order]), _field(name))
        return F.when(at > 0, at - 1).otherwise(F.lit(unknown))

    zero = F.lit(0)
    purpose = F.length(F.coalesce(_field("context.function_purpose"), F.lit("")))
    return F.array_compact(F.array(
        claim("first", zero),
        *[claim(name, -F.length(_field(name))) for name in LONGEST],
        *[claim(name, zero, _field(name).isNotNull() & (_field(name) != "")) for name in FIRST_PRESENT],
        *[claim(name, zero, F.size(_field(name)) > 0) for name in LEADING_LISTS],
        *[claim(name, zero, _field(name)) for name in ANY],
        claim("rating", position("attack.exploitability_rating", merge.EASE, merge.EASE_UNKNOWN)),
        claim("complexity", -position("remediation.implementation_complexity", merge.EFFORT, merge.EFFORT_UNKNOWN)),
        *[claim(part, zero, F.col(f"record.{part}").isNotNull()) for part in ("context", "false_positive", "alternatives")],
        claim("purpose", -purpose, F.col("record.context").isNotNull())))


def _member_claims() -> Column:
    """The distinct members a record brings: ``field, most, at, member``."""
    def members(name: str, most: int | None, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast(STRINGS)), lambda v, i: F.struct(
            F.lit(name).alias("field"), F.lit(most).cast("int").alias("most"), i.alias("at"), v.alias("member")))

    return F.flatten(F.array(
        *[members(name, most, _field(name)) for name, most in UNIONS.items()],
        *[members(name, most, F.array(_field(name))) for name, most in DISTINCT.items()],
        members("agent", None, F.array(F.col("agent")))))


def read_by_merge(records: DataFrame) -> DataFrame:
    """The records that a merge of all would read; ``records`` has the columns of its place.

    For each location there are at most some hundreds, and the first bringers of
    members that the merged record holds anyway.
    """
    place = F.struct(*PLACE)
    ranked = records.select(*LOCATION, *PLACE, F.explode(_ranked_claims()).alias("c")).select(*LOCATION, *PLACE, "c.*")
    nth = F.row_number().over(Window.partitionBy(*LOCATION, "field").orderBy("key", *PLACE))
    leading = ranked.withColumn("_nth", nth).where(F.col("_nth") <= REPEATS_READ).select(*LOCATION, *PLACE)
    brought = records.select(*LOCATION, place.alias("_place"), F.explode(_member_claims()).alias("c")).groupBy(
        *LOCATION, "c.field", "c.most", "c.member").agg(F.min(F.struct("_place", "c.at")).alias("_first"))
    # The members that are merged, of those lists that are cut.
    order = F.row_number().over(Window.partitionBy(*LOCATION, "field").orderBy("_first"))
    most = max(m for m in [*UNIONS.values(), *DISTINCT.values()] if m)
    cut = brought.where(F.col("most").isNotNull()).withColumn("_nth", order).where(F.col("_nth") <= most).drop("_nth")
    bringers = cut.unionByName(brought.where(F.col("most").isNull())).select(*LOCATION, "_first._place.*")
    wanted = leading.unionByName(bringers).distinct()
    return records.join(wanted, [*LOCATION, *PLACE], "left_semi")


def merge_record_table(records: DataFrame, at_once: int = RECORDS_AT_ONCE) -> DataFrame:
    """``repo, path, line_number, records, agents, merged``: one record for each location.

    Records merge in the order of the built-in reviewers, then other reviewers
    by name, then by ``ordinal``; records alike in all these go by a hash.  The
    number of records and the reviewers are those of all; a record repeated word
    for word counts as often as it stands there.  One record alone stays as it
    is, marked as a single reviewer's; an empty table gives an empty result.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(a) for a in AGENTS]), F.col("agent")), F.lit(0)), F.lit(len(AGENTS) + 1))
    placed = records.select(*LOCATION, rank.cast("int").alias("_rank"), "agent", "ordinal", F.xxhash64("record").alias("_digest"), "record")
    counted = placed.groupBy(*LOCATION).agg(
        F.count("*").alias("records"), F.sort_array(F.collect_set("agent")).alias("agents"))
    crowded = counted.where(F.col("records") > at_once).select(
        *LOCATION, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"), F.lit(True).alias("_crowded"))
    # A crowded location is joined in parts.
    dealt = placed.withColumn("_part", F.pmod("_digest", F.lit(PARTS)).cast("int")).join(
        crowded, [*LOCATION, "_part"], "left").drop("_part")
    few = dealt.where(F.col("_crowded").isNull()).drop("_crowded")
    # Repeats beyond those that any list reads change nothing.
    many = dealt.where("_crowded").groupBy(*LOCATION, *PLACE, "record").agg(F.count("*").alias("_n"))
    read = read_by_merge(many).select(
        *LOCATION, *PLACE, "record", F.explode(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(REPEATS_READ)))).alias("_repeat"))
    gathered = few.unionByName(read.drop("_repeat")).groupBy(*LOCATION).agg(
        F.array_sort(F.collect_list(F.struct(*PLACE, "record")), _by_place).alias("_sorted"))
    items = gathered.join(counted, LOCATION).withColumn(
        "_items", F.transform("_sorted", lambda x: F.struct(x["agent"].alias("agent"), x["record"].alias("record"))))
    merged = computed_once(items, "merged", merge.merge_records(F.col("_items"), F.size("agents"), F.col("agents")))
    return merged.select(*LOCATION, "records", "agents", "merged")


def _by_place(a: Column, b: Column) -> Column:
    order = F.lit(0)
    for name in reversed(PLACE):
        order = F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(order)
    return order
