"""Session defaults and the few places where the library looks at the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A scan's task gets about this much of an input's files, whatever their splits
# and row groups: its seconds go by that and not by the size of the input.
SPREAD_BYTES_PER_TASK = 4 * 1024 * 1024
# A shuffle into more parts than this costs more than it evens out; an input
# that large is read as it is split.
SPREAD_MOST_TASKS = 20_000
# Largest side that may be broadcast, by the planner's own size estimate.
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(app: str = "lintlake", master: str | None = None) -> SparkSession:
    """A session with the settings the scans were designed for.

    Scans spend their time in regular expressions, so input splits are kept
    smaller than Spark's default and adaptive execution sizes the shuffles.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", str(32 * 1024 * 1024))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def estimated_bytes(df: DataFrame) -> int:
    """The planner's size estimate; it comes from file sizes for file sources."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return estimated_bytes(df) <= limit


def even_tasks(df: DataFrame) -> int:
    """How many tasks of bounded size the planner's estimate of the rows makes."""
    return -(-estimated_bytes(df) // SPREAD_BYTES_PER_TASK)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly into tasks of bounded size, three a core at least.

    One shuffle of the texts is a small part of what scanning them costs, and a
    file with few splits, or an input that just fills some cores, keeps none idle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores * 3, even_tasks(df))
    return df if tasks > max(SPREAD_MOST_TASKS, cores * 3) else df.repartition(tasks)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything was written there yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared checkpoint folder the cluster names.

    Only a local session, as in tests, may do without; it gets a temporary
    folder.  On a cluster such a folder would not be shared, so it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lintlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lintlake/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
