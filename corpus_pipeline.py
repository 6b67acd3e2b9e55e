"""A training corpus from raw documents, in five stages.

Each stage reads what its predecessor kept, written as Parquet in between, and
all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import map_rows, stored
from lintlake.llm.decontamination import fit_blocks, searched, segments_of_table
from lintlake.llm.packing import pack_documents
from lintlake.llm.personal import all_spans, fit_judge, redacted
from lintlake.llm.quality import fit_quality, quality_scores
from lintlake.llm.simhash import near_duplicates


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject; the model learns from the labels of this stage's documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels)
    return quality_scores(docs, model, docs.columns).where("score >= 0.5").drop("score")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the group's smallest id.

    Of rows that repeat that id the one whose text has the smallest hash stays.
    Rows without an id are in no group; equal texts among them are one row.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    firsts = near_duplicates(named).where("doc_id = component_id").select("doc_id").distinct()
    # Ids and hashes decide who stays, so the texts are shuffled once.
    mark = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    chosen = named.select("doc_id", mark.alias("_mark")).join(firsts, "doc_id").groupBy("doc_id").agg(F.min("_mark").alias("_mark"))
    kept = named.withColumn("_mark", mark).join(chosen, ["doc_id", "_mark"], "left_semi").dropDuplicates(["doc_id", "_mark"])
    nameless = docs.where(F.col("doc_id").isNull()).dropDuplicates(["text"])
    return kept.select(*docs.columns).unionByName(nameless)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    segments = segments_of_table(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rest = F.struct(*(c for c in docs.columns if c != "text"))
    rows = docs.select(F.col("text").alias("t"), rest.alias("rest"))
    for group in fit_blocks(docs.select(F.col("text").alias("t")), segments):
        rows = searched(rows, group)
    if "items" not in rows.columns:
        return docs
    return rows.where(F.size("items") == 0).select(
        *(F.col("t").alias(c) if c == "text" else F.col(f"rest.{c}").alias(c) for c in docs.columns))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows the text."""
    judge = fit_judge(docs)
    columns = docs.columns
    place = columns.index("text")

    def row(_, *values):
        return *values[:place], redacted(values[place], all_spans(values[place], judge)[1]), *values[place + 1:]

    cleaned = map_rows(docs, row, docs.schema)
    changed = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), changed)).select(*columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bin and offset."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

# Models trained on the rows decide, so SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
