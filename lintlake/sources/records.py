"""Reasoning records from JSON lines, with the lines that are none kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from lintlake.functions.reasoning import RECORD_TYPE, STRINGS

LINE_TYPE = (
    StructType().add("repo", StringType()).add("path", StringType()).add("line_number", IntegerType())
    .add("ordinal", LongType()).add("agent", StringType()).add("record", RECORD_TYPE).add("_bad", StringType()))
# Without these a record says nothing.
REQUIRED_PARTS = ["detection", "risk", "attack", "confidence", "remediation"]
REQUIRED_TEXTS = [
    "detection.pattern_matched", "risk.severity_reasoning", "confidence.confidence_level", "remediation.recommended_fix"]
# Lists of the required parts; a missing one is empty.
LISTS = ["detection.signals_observed", "risk.affected_assets", "attack.attack_steps", "confidence.primary_factors",
         "confidence.strong_evidence", "confidence.weak_evidence", "remediation.alternative_fixes"]


def _inside(record: Column, name: str) -> Column:
    for part in name.split("."):
        record = record[part]
    return record


def parsed_lines(lines: DataFrame) -> DataFrame:
    """``value, line, reason``: each line parsed, and why it is rejected, else null.

    A line is an object of ``repo, path, line_number, ordinal, agent`` and
    ``record``; ``ordinal`` is its place among the agent's records there and may
    be missing.  Null and empty lines, other JSON, wrong types, records without
    a place or reviewer and those that lack a required part are rejected.
    """
    line = F.from_json("value", LINE_TYPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = lines.select("value", line.alias("line"))
    placed = [F.col(f"line.{name}").isNull() for name in ("repo", "path", "line_number", "agent")]
    parts = [F.col(f"line.record.{name}").isNull() for name in [*REQUIRED_PARTS, *REQUIRED_TEXTS]]

    def any_of(conditions: list[Column]) -> Column:
        return F.exists(F.array(*conditions), lambda c: c)

    reason = (
        F.when(F.col("line").isNull() | F.col("line._bad").isNotNull(), "not a record")
        .when(any_of(placed), "no place or reviewer").when(any_of(parts), "incomplete"))
    return parsed.withColumn("reason", reason)


def records_of(parsed: DataFrame) -> DataFrame:
    """``repo, path, line_number, ordinal, agent, record`` of the lines that are records."""
    record = F.col("line.record")
    for name in LISTS:
        record = record.withField(name, F.coalesce(_inside(F.col("line.record"), name), F.array().cast(STRINGS)))
    return parsed.where(F.col("reason").isNull()).select(
        "line.repo", "line.path", "line.line_number", F.coalesce("line.ordinal", F.lit(0)).alias("ordinal"), "line.agent",
        record.cast(RECORD_TYPE).alias("record"))


def rejects_of(parsed: DataFrame) -> DataFrame:
    """``value, reason`` of the others."""
    return parsed.where(F.col("reason").isNotNull()).select("value", "reason")
