"""Helpers that several operators share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def worker_cache(name: str, build: Callable[[], Any]) -> Any:
    """One object per Python worker process, kept between the tasks it runs."""
    home = sys.modules.setdefault("_lintlake_worker_cache", types.ModuleType("_lintlake_worker_cache"))
    if not hasattr(home, name):
        setattr(home, name, build())
    return getattr(home, name)


def map_rows(df: DataFrame, row: Callable[..., tuple], schema: str | StructType, setup: Callable[[], Any] | None = None) -> DataFrame:
    """``row(state, *columns) -> tuple`` for each row of ``df``, in Arrow batches.

    ``state`` is what ``setup`` returns, once per task.  One batch is in memory
    at a time, and each row becomes one row.
    """
    spark = df.sparkSession
    names = df.columns
    empty = spark.createDataFrame([], schema)
    out_names = empty.columns
    out_schema = to_arrow_schema(empty.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [row(state, *values) for values in zip(*(part.column(c).to_pylist() for c in names))]
                columns = list(zip(*rows)) or [()] * len(out_names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

    return df.mapInArrow(run, empty.schema)


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder in the shared folder that ``spark.checkpoint.dir`` names.

    A local session without the setting gets a folder below its warehouse; on a
    cluster the setting is required, since executors share no other folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    return f"{base.rstrip('/')}/llm/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read the table back.

    A lost executor costs no recomputation of what was written.
    """
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drawn(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows, never more than twice that: those whose key hashes low; all rows if there are fewer.

    No task sees more than it draws, and the draw is the same in every run.
    """
    share = most / max(1, df.count())
    if share >= 1:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * most)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc(column: str):
    """crc32 of a value's text form, as the train and hold-out rules use it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
