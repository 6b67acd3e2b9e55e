"""Run state as append-only tables.

``runs`` holds one small row per checkpoint; ``processed`` holds the keys of
finished files.  A run that starts over takes a new ``run_id``; nothing is
rewritten or deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.session import path_exists
from lintlake.sources import log

FILE, REPO, SUMMARY = "file_level", "repo_level", "summary"
# Which checkpoint wins when two carry the same time.
PRIORITY = [SUMMARY, FILE, REPO]

RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("checkpoint_type", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("repo_name", T.StringType()),
    T.StructField("files_scanned", T.LongType()),
    T.StructField("findings_count", T.LongType()),
    T.StructField("repos_completed", T.LongType()),
    T.StructField("duration_seconds", T.DoubleType()),
])
PROCESSED_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("repo", T.StringType()),
    T.StructField("path", T.StringType()),
])
COMPLETED_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("repo", T.StringType()),
])


def new_run_id() -> str:
    return uuid.uuid4().hex


class RunState:
    """The state tables below one folder of shared storage."""

    def __init__(self, spark: SparkSession, folder: str, run_id: str | None = None):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.run_id = run_id or new_run_id()

    @property
    def log_dir(self) -> str:
        return f"{self.folder}/log"

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        """The run's rows; an empty frame while nothing was written."""
        path = f"{self.folder}/{name}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path).where(F.col("run_id") == self.run_id)

    def _append(self, name: str, df: DataFrame, schema: T.StructType) -> None:
        rows = df.withColumn("run_id", F.lit(self.run_id))
        columns = [
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
        ]
        rows.select(*columns).write.mode("append").parquet(f"{self.folder}/{name}")

    def runs(self) -> DataFrame:
        return self._table("runs", RUN_SCHEMA)

    def processed(self) -> DataFrame:
        return self._table("processed", PROCESSED_SCHEMA).select("repo", "path")

    def completed(self) -> DataFrame:
        return self._table("completed", COMPLETED_SCHEMA).select("repo")

    def _counts(self, findings_count: int | None = None) -> DataFrame:
        """Totals so far, one row, from the tables themselves.

        Counting findings reads the log; a caller that knows their number can
        pass it instead.
        """
        parts = (
            self.processed().agg(F.count("*").alias("n")).select(F.lit("files_scanned").alias("k"), "n")
            .unionByName(self.completed().agg(F.count_distinct("repo").alias("n")).select(F.lit("repos_completed").alias("k"), "n"))
        )
        if findings_count is None:
            logged = log.replay(self.spark, self.log_dir).agg(F.count("*").alias("n"))
        else:
            logged = self.spark.range(1).select(F.lit(findings_count).cast("long").alias("n"))
        parts = parts.unionByName(logged.select(F.lit("findings_count").alias("k"), "n"))
        names = ["files_scanned", "repos_completed", "findings_count"]
        return parts.agg(*[F.max(F.when(F.col("k") == name, F.col("n"))).alias(name) for name in names])

    def save_files(
        self, files: DataFrame, timestamp: str, repo_name: str | None = None, findings_count: int | None = None
    ) -> None:
        """File-level checkpoint: these files are done."""
        self._append("processed", files.select("repo", "path"), PROCESSED_SCHEMA)
        self._append("runs", self._counts(findings_count).select(
            "*", F.lit(FILE).alias("checkpoint_type"), F.lit(timestamp).alias("timestamp"),
            F.lit(repo_name).alias("repo_name")), RUN_SCHEMA)

    def save_repos(
        self, repos: DataFrame, timestamp: str, duration_seconds: float | None = None,
        findings_count: int | None = None,
    ) -> None:
        """Repository-level checkpoint: these repositories are done."""
        self._append("completed", repos.select("repo").distinct(), COMPLETED_SCHEMA)
        self._append("runs", self._counts(findings_count).select(
            "*", F.lit(REPO).alias("checkpoint_type"), F.lit(timestamp).alias("timestamp"),
            F.lit(duration_seconds).alias("duration_seconds")), RUN_SCHEMA)

    def save_summary(
        self, timestamp: str, duration_seconds: float | None = None, findings_count: int | None = None
    ) -> None:
        """The run is finished."""
        self._append("runs", self._counts(findings_count).select(
            "*", F.lit(SUMMARY).alias("checkpoint_type"), F.lit(timestamp).alias("timestamp"),
            F.lit(duration_seconds).alias("duration_seconds")), RUN_SCHEMA)

    def latest(self, level: str | None = None) -> DataFrame:
        """The newest checkpoint, of one level or of any: one row, or none."""
        rows = self.runs() if level is None else self.runs().where(F.col("checkpoint_type") == level)
        rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("checkpoint_type"))
        newest = rows.agg(F.max_by(F.struct("*"), F.struct(
            F.col("timestamp"), (-rank).alias("r"), F.col("files_scanned"))).alias("_row"))
        return newest.where(F.col("_row").isNotNull()).select("_row.*")

    def info(self) -> DataFrame:
        """Which checkpoints exist, and the newest one's type and time."""
        def has(level: str):
            return F.coalesce(F.bool_or(F.col("checkpoint_type") == level), F.lit(False))

        rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("checkpoint_type"))
        order = F.struct(F.col("timestamp"), (-rank).alias("r"))
        return self.runs().agg(
            has(FILE).alias("has_file_checkpoint"),
            has(REPO).alias("has_repo_checkpoint"),
            has(SUMMARY).alias("has_summary_checkpoint"),
            F.max_by("timestamp", order).alias("latest_timestamp"),
            F.max_by("checkpoint_type", order).alias("latest_type"),
        )
