"""Reasoning records as other reviewers may hand them in, made of the words of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.constants import texts_literal
from lintlake.functions.reasoning import RECORD_TYPE, STRINGS
from lintlake.functions.severity import AGENTS

RATINGS = ["Easy", "Medium", "Hard", "Very Hard", "Unknown"]
EFFORTS = ["Easy", "Medium", "Hard", "Unknown"]


def _struct(part: str, **fields: Column) -> Column:
    kind = RECORD_TYPE[part].dataType
    return F.struct(*[fields[f.name].cast(f.dataType).alias(f.name) for f in kind.fields if f.name in fields])


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value``: each document as a record on one of five lines of a file of its language.

    Lines of some documents are cut, and a document of few words lacks parts.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "lang", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))

    def w(i: int) -> Column:
        return F.get("w", F.lit(i - 1))

    def some(*places: int) -> Column:
        return F.array_compact(F.array(*[w(i) for i in places])).cast(STRINGS)

    def size(i: int, modulus: int) -> Column:
        return F.length(w(i)) % modulus

    record = F.struct(
        _struct("detection", pattern_matched=F.concat(w(1), F.lit(" "), w(2)), detection_method=F.concat(F.lit("scan "), size(1, 3)),
                signals_observed=some(3, 4)).alias("detection"),
        _struct("risk", severity_reasoning=w(5), impact_description=F.concat(F.lit("impact on "), w(4)), affected_assets=some(5, 6),
                attack_surface=w(6), data_sensitivity=F.when(size(2, 2) == 0, w(2)),
                compliance_impact=F.when(size(1, 2) == 0, F.array(F.concat(F.lit("C"), F.length(w(1)))))).alias("risk"),
        _struct("attack", attack_vector=w(7), attack_steps=some(8, 9, 10), required_access=F.concat(F.lit("access "), size(3, 4)),
                exploitability_rating=F.get(texts_literal(RATINGS), size(4, 5)),
                similar_cves=F.when(size(5, 3) == 0, F.array(F.concat(F.lit("CVE-"), w(5)))),
                exploit_examples=F.when(size(6, 3) == 0, w(6))).alias("attack"),
        _struct("confidence", confidence_level=F.when(size(1, 2) == 0, "LOW").otherwise("MEDIUM"), primary_factors=some(11),
                strong_evidence=some(12, 13), weak_evidence=some(14)).alias("confidence"),
        _struct("remediation", recommended_fix=F.concat(w(1), F.lit(" to "), w(3)), fix_rationale=F.concat(F.lit("since "), w(2)),
                alternative_fixes=some(15, 16), tradeoffs=F.when(size(7, 2) == 0, w(7)),
                implementation_complexity=F.get(texts_literal(EFFORTS), size(8, 4)), breaking_changes=size(9, 7) == 0,
                testing_guidance=F.when(size(8, 2) == 0, w(8))).alias("remediation"),
        F.when(size(3, 2) == 0, _struct(
            "context", function_purpose=w(9), data_flow=w(10), surrounding_controls=some(11), missing_controls=some(12),
            file_purpose=w(13), framework_context=w(14))).alias("context"),
        F.when(size(4, 3) == 1, _struct(
            "false_positive", is_likely_false_positive=size(5, 4) == 0, reasoning=F.concat(F.lit("doubt of "), w(5)),
            ambiguity_factors=some(6), validation_needed=w(7), confidence_boosters=some(7), confidence_detractors=some(8))).alias("false_positive"),
        F.when(size(6, 3) == 1, _struct(
            "alternatives", possible_legitimate_uses=some(9), counterarguments=some(10, 11),
            requires_human_judgment=size(7, 5) == 0)).alias("alternatives"),
        F.lit("2024").alias("generated_at"))
    line = F.to_json(F.struct(
        F.col("lang").alias("repo"), F.concat("lang", F.lit(".txt")).alias("path"), (F.col("doc_id") % 5 + 1).cast("int").alias("line_number"),
        F.col("doc_id").alias("ordinal"), F.get(texts_literal(AGENTS), (F.col("doc_id") % 3).cast("int")).alias("agent"), record.alias("record")))
    return docs.select(F.when(size(2, 5) == 4, F.substr(line, F.lit(1), F.length(line) - 5)).otherwise(line).alias("value"))
