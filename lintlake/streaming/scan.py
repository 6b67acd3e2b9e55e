"""Incremental scanning of arriving files.

A file arrives whole and consensus never crosses files, so a micro-batch needs
no state from earlier ones.  The stream's checkpoint remembers which files were
read; each batch replaces its own output folder, so a batch that is repeated
after a failure leaves every finding once.  Counters and progress are kept the
same way: what a batch adds is stored under its number and folded when read.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from lintlake.functions import text
from lintlake.operators.scan import regex_findings
from lintlake.plans.audit import audit
from lintlake.session import path_exists
from lintlake.sources.corpus import (
    BINARY_FILE_SCHEMA, MAX_FILE_BYTES, is_scannable, keep_files, prune, with_repo,
)

# Fixed value: files per micro-batch, which is how often progress is saved.
FILES_PER_BATCH = 100


def _admission(reader: DataStreamReader, files_per_batch: int | None, bytes_per_batch: int | None) -> DataStreamReader:
    """How much a micro-batch takes: so many files, or as many as make up so many bytes (one at least)."""
    if bytes_per_batch is not None:
        return reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)


def file_stream(
    spark: SparkSession, root: str, files_per_batch: int | None = FILES_PER_BATCH, *,
    bytes_per_batch: int | None = None, max_bytes: int | None = MAX_FILE_BYTES,
) -> DataFrame:
    """Repository files as they arrive below ``root``, up to a size (``None``: any size)."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", "true")
    raw = _admission(reader, files_per_batch, bytes_per_batch).load(root)
    files = prune(with_repo(keep_files(raw, root, keep=is_scannable, max_bytes=max_bytes)), max_bytes)
    return files.select("repo", "path", "length", text.decode_lenient(F.col("content")).alias("content"))


def table_stream(
    spark: SparkSession, folder: str, schema: T.StructType, *, glob: str = "*.parquet",
    files_per_batch: int | None = FILES_PER_BATCH, bytes_per_batch: int | None = None,
) -> DataFrame:
    """Rows of parquet files as they arrive in ``folder``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return _admission(reader, files_per_batch, bytes_per_batch).parquet(folder)


def _replace_batch(df: DataFrame, batch_id: int, out_dir: str) -> None:
    (
        df.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(out_dir)
    )


# What the counters of a scan tell apart.
TOTALS = ["consensus_level", "severity", "category", "repo"]


@dataclass(frozen=True)
class BatchScan:
    """What happens to each micro-batch: findings, and on request counters and progress.

    Files and bytes are observed while the batch is scanned, counters come from
    the findings as written, so nothing is scanned twice.
    """

    out_dir: str
    min_severity: str = "MEDIUM"
    prepare: Callable[[DataFrame], DataFrame] | None = None
    totals_dir: str | None = None
    progress_dir: str | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        start = time.monotonic()
        files = self.prepare(batch) if self.prepare else batch
        spark, seen = files.sparkSession, Observation()
        if self.progress_dir:
            files = files.observe(
                seen, F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length("content").cast("long")), F.lit(0)).alias("bytes"))
        _replace_batch(audit(files, min_severity=self.min_severity), batch_id, self.out_dir)
        written = f"{self.out_dir}/batch_id={batch_id}"
        found = spark.read.parquet(written) if path_exists(spark, written) else None
        if self.totals_dir and found is not None:
            _replace_batch(found.groupBy(*TOTALS).agg(F.count("*").alias("findings")), batch_id, self.totals_dir)
        if self.progress_dir:
            n = 0 if found is None else found.count()
            row = (seen.get["files"], seen.get["bytes"], n, time.monotonic() - start)
            _replace_batch(spark.createDataFrame([row], "files long, bytes long, findings long, seconds double"), batch_id, self.progress_dir)


def scan_stream(
    corpus: DataFrame,
    out_dir: str,
    checkpoint_dir: str,
    *,
    min_severity: str = "MEDIUM",
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    totals_dir: str | None = None,
    progress_dir: str | None = None,
) -> StreamingQuery:
    """Scans everything that has arrived, then stops.

    ``prepare`` may repartition or reshape a batch before it is scanned.
    ``totals_dir`` and ``progress_dir`` keep counters and progress.
    """
    scan = BatchScan(out_dir, min_severity, prepare, totals_dir, progress_dir)
    return (
        corpus.writeStream.foreachBatch(scan)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


def stream_totals(spark: SparkSession, totals_dir: str) -> DataFrame:
    """``dimension, value, findings`` over all batches: by each of the counters' columns, and in all."""
    parts = spark.read.parquet(totals_dir).groupBy(*TOTALS).agg(F.sum("findings").alias("findings"))
    parts = parts.withColumns({c: F.col(c).cast("string") for c in TOTALS})
    one_each = parts.groupingSets([*[[F.col(c)] for c in TOTALS], []], *[F.col(c) for c in TOTALS])
    summed = one_each.agg(F.sum("findings").alias("findings"), F.grouping_id().alias("g"))
    # Bits of the grouping number tell which columns were summed over.
    names = {(1 << len(TOTALS)) - 1 - (1 << len(TOTALS) - 1 - i): c for i, c in enumerate(TOTALS)}
    dimension, value = F.lit("all"), F.lit("all")
    for g, name in names.items():
        dimension = F.when(F.col("g") == g, name).otherwise(dimension)
        value = F.when(F.col("g") == g, F.col(name)).otherwise(value)
    return summed.select(dimension.alias("dimension"), value.alias("value"), "findings").where("findings IS NOT NULL")


def scan_progress(spark: SparkSession, progress_dir: str, total_files: int | None = None) -> DataFrame:
    """One row per batch: what it took, how far the scan is (percent of ``total_files``), and files per second."""
    so_far = Window.orderBy("batch_id")
    rows = spark.read.parquet(progress_dir)
    share = F.lit(None).cast("double") if not total_files else F.round(F.col("files_so_far") * 100 / total_files, 1)
    return rows.withColumn("files_so_far", F.sum("files").over(so_far)).withColumn(
        "findings_so_far", F.sum("findings").over(so_far)).withColumns({
            "percent": share, "files_per_second": F.when(F.col("seconds") > 0, F.col("files") / F.col("seconds"))})


def running_counts(
    corpus: DataFrame, out_dir: str, checkpoint_dir: str, *, shuffle_first: int | None = None
) -> StreamingQuery:
    """Running totals of rule matches per reviewer and severity across batches.

    The totals are the only state a scan keeps; there are at most fifteen.
    """
    source = corpus.repartition(shuffle_first) if shuffle_first else corpus
    counts = regex_findings(source).groupBy("agent", "severity").agg(F.count("*").alias("findings"))
    return (
        counts.writeStream.outputMode("complete")
        .foreachBatch(lambda batch, batch_id: _replace_batch(batch, batch_id, out_dir))
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


def latest_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """Totals as of the newest batch."""
    table = spark.read.parquet(out_dir)
    newest = table.groupBy("agent", "severity").agg(F.max_by("findings", "batch_id").alias("findings"))
    return newest


def arrival_rate(query: StreamingQuery) -> list[tuple[int, float]]:
    """Batch number and files per second of the recent batches."""
    return [(p["batchId"], p["processedRowsPerSecond"]) for p in query.recentProgress]

