"""Corpora that the registered queries read, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.constants import rows_literal, texts_literal
from lintlake.session import spread
from lintlake.sources.corpus import SCANNABLE_EXTENSIONS, prune, table_corpus
from workload.snippets import DIRECTORIES, SNIPPETS, SOURCE_DIRECTORIES, SOURCE_EXTENSION


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")


def logged(text: Column, prefix: str = "") -> Column:
    """Each line of the text as a statement that logs it."""
    between = f'")\n{prefix}log("'
    return F.concat(F.lit(f'{prefix}log("'), F.replace(text, F.lit("\n"), F.lit(between)), F.lit('")'))


def as_files(documents: DataFrame, *, mixed: bool = False) -> DataFrame:
    """Each document as a source file: its lines as logging statements in comments, then a fragment.

    A scan reads every one of these files.  ``mixed`` gives them folders and
    extensions of which a scan skips some.
    """
    extensions = [ext if mixed or ext in SCANNABLE_EXTENSIONS else SOURCE_EXTENSION for ext, _ in SNIPPETS]
    fragment = F.get(
        rows_literal([{"ext": ext, "code": code} for ext, (_, code) in zip(extensions, SNIPPETS)]),
        (F.col("doc_id") % len(SNIPPETS)).cast("int"),
    )
    folders = DIRECTORIES if mixed else SOURCE_DIRECTORIES
    directory = F.get(texts_literal(folders), (F.col("doc_id") % len(folders)).cast("int"))
    return documents.select(
        F.col("source").alias("repo"),
        F.concat(F.col("source"), F.lit("/"), directory, F.lit("/doc_"),
                 F.col("doc_id").cast("string"), fragment["ext"]).alias("path"),
        F.concat(logged(F.col("text"), "# "), F.lit("\n"), fragment["code"], F.lit("\n")).alias("content"),
    )


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all kinds, with their sizes, before pruning."""
    return table_corpus(as_files(documents(spark, sf_dir), mixed=True), "repo", "path", "content")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file that a scan reads, whatever its size."""
    return prune(table_corpus(as_files(documents(spark, sf_dir)), "repo", "path", "content"), max_bytes=None)


def scannable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(source_files(spark, sf_dir))


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, raw pages and conversation turns as an application logs them, line by line."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs = read("documents").select(
        F.col("source").alias("repo"), F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"),
        logged(F.col("text")).alias("content"))
    pages = read("pages").select(
        F.lit("pages").alias("repo"), F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"),
        logged(F.col("html")).alias("content"))
    turns = read("conversations").select(
        F.lit("conversations").alias("repo"),
        F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit("/"),
                 F.col("turn").cast("string")).alias("path"),
        logged(F.col("text")).alias("content"))
    return spread(table_corpus(docs.unionByName(pages).unionByName(turns), "repo", "path", "content"))
