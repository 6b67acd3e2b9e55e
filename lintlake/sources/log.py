"""The findings log: JSON lines that are only ever appended.

Every append is a folder of its own, numbered in order, and every line carries
its number within it.  The two are a line's position: what comes first or last
in the log goes by it, never by clock time, which may repeat.  One run writes to
a log at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.operators.review import finding_id
from lintlake.session import path_exists

# Fixed value: how much text of a finding the log keeps.
LOG_TEXT_CAP = 200

FINDING_TYPE = T.StructType([
    T.StructField("finding_id", T.StringType()),
    T.StructField("repo", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("consensus_level", T.IntegerType()),
    T.StructField("agreeing_agents", T.ArrayType(T.StringType())),
])
ENTRY_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("row", T.LongType()),
    T.StructField("finding", FINDING_TYPE),
    T.StructField("data", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_corrupt_record", T.StringType()),
])


def log_entries(agreed: DataFrame, timestamp: str) -> DataFrame:
    """Consensus findings as log lines."""
    finding = F.struct(
        finding_id().alias("finding_id"),
        F.col("repo"),
        F.col("path").alias("file"),
        "severity",
        "category",
        "line_number",
        F.substring("evidence", 1, LOG_TEXT_CAP).alias("evidence"),
        F.substring("recommendation", 1, LOG_TEXT_CAP).alias("recommendation"),
        "consensus_level",
        "agreeing_agents",
    )
    return agreed.select(
        F.to_json(F.struct(
            F.lit("finding").alias("type"), F.lit(timestamp).alias("timestamp"), F.monotonically_increasing_id().alias("row"),
            finding.alias("finding"))).alias("value"))


def _next_append(spark: SparkSession, log_dir: str) -> str:
    """The folder of the next append, numbered after the last one there."""
    last = -1
    if path_exists(spark, log_dir):
        folder = spark._jvm.org.apache.hadoop.fs.Path(log_dir)
        for status in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("append="):
                last = max(last, int(name[len("append="):]))
    return f"{log_dir.rstrip('/')}/append={last + 1:09d}"


def append_lines(lines: DataFrame, log_dir: str) -> None:
    """One append of finished lines (column ``value``)."""
    lines.write.text(_next_append(lines.sparkSession, log_dir))


def append_findings(agreed: DataFrame, log_dir: str, timestamp: str) -> None:
    append_lines(log_entries(agreed, timestamp), log_dir)


def append_checkpoint(spark: SparkSession, log_dir: str, timestamp: str, data: dict[str, object]) -> None:
    """A marker line between findings."""
    pairs = [F.lit(str(x)) for item in data.items() for x in item]
    marker = F.to_json(F.struct(
        F.lit("checkpoint").alias("type"), F.lit(timestamp).alias("timestamp"), F.lit(0).cast("long").alias("row"),
        F.create_map(*pairs).alias("data")))
    append_lines(spark.range(1).select(marker.alias("value")).coalesce(1), log_dir)


def read_log(spark: SparkSession, log_dir: str) -> DataFrame:
    """Every line, parsed, with its ``position``; a damaged one keeps its text in ``_corrupt_record``.

    Lines of files outside numbered appends come before all others.
    """
    if path_exists(spark, log_dir):
        # The number is read from the path, so that loose files do no harm.
        files = spark.read.option("recursiveFileLookup", "true").text(log_dir)
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/append=(\d+)/[^/]*$", 1)
        lines = files.select("value", F.when(number != "", number.cast("long")).otherwise(-1).alias("append")).where(F.trim("value") != "")
    else:
        lines = spark.createDataFrame([], "value string, append long")
    parsed = F.from_json(
        F.col("value"), ENTRY_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    entries = lines.select("append", parsed.alias("e")).select("append", "e.*")
    return entries.withColumn("position", F.struct("append", F.coalesce("row", F.lit(0)).alias("row"))).drop("append", "row")


def of_type(entries: DataFrame, kind: str) -> DataFrame:
    return entries.where((F.col("type") == kind) & F.col("_corrupt_record").isNull())


def replay(spark: SparkSession, log_dir: str) -> DataFrame:
    """The findings of the log.  Damaged lines are skipped, order is by ``position``."""
    return of_type(read_log(spark, log_dir), "finding").select(
        F.col("timestamp").alias("logged_at"), "position", "finding.*")


def replay_once(spark: SparkSession, log_dir: str) -> DataFrame:
    """Replay without the repeats that an interrupted run may have left."""
    return replay(spark, log_dir).dropDuplicates(["finding_id"])


def checkpoints(spark: SparkSession, log_dir: str) -> DataFrame:
    return of_type(read_log(spark, log_dir), "checkpoint").select("timestamp", "data", "position")


def last_checkpoint(spark: SparkSession, log_dir: str) -> DataFrame:
    """The newest marker: one row, or none."""
    newest = checkpoints(spark, log_dir).agg(
        F.max_by(F.struct("timestamp", "data", "position"), F.col("position")).alias("last"))
    return newest.where(F.col("last").isNotNull()).select("last.*")


def log_bytes(spark: SparkSession, log_dir: str) -> DataFrame:
    """Size from the file listing; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(log_dir).agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def _is(kind: str) -> Column:
    return (F.col("type") == kind) & F.col("_corrupt_record").isNull()


def log_stats(spark: SparkSession, log_dir: str) -> DataFrame:
    """Lines (damaged ones included), findings, markers."""
    return read_log(spark, log_dir).agg(
        F.count("*").alias("total_entries"),
        F.count_if(_is("finding")).alias("findings_count"),
        F.count_if(_is("checkpoint")).alias("checkpoint_count"))
