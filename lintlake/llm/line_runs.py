"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line hashes with the number of documents that hold each,
bucketed and sorted by hash, so that a batch meets the runs in merge joins.  A
batch leaves out the lines that the runs already know to be frequent and adds
the rest as a run of its own; when a level is full its runs are compacted into
one of the next level.  Lines of hot keys meet their documents by a broadcast
whose size is bounded; all others meet in a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import documents, map_rows, shared_path, stored

# The blanks stripped from a line's ends.
BLANKS = b" \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCUMENTS = 1, 10
BATCHES = 4
# Runs of a level that are compacted into one of the next.
FANOUT = 2
# A key with more than one of so many rows of a batch is hot; so at most as many keys of a batch are.
HOT_PARTS = 4096
# Parts into which the documents of a hot text are dealt.
SALTS = 32


def line_keys(text: bytes, least_chars: int) -> Iterator[bytes | None]:
    """The hash of each line's key, in order; None where the key is too short to count."""
    for line in text.lower().split(b"\n"):
        key = line.strip(BLANKS)
        long_enough = len(key) >= 4 * least_chars or len(key.decode()) >= least_chars
        yield xxhash.xxh3_128_digest(key) if long_enough else None


class LineRuns:
    """Document counts of line hashes, as levelled runs.

    ``limit`` is the number of documents that makes a line frequent; its count
    may stand still from then on.  ``hot`` holds, per batch, the keys that have
    more than one in ``HOT_PARTS`` of the batch's rows.
    """

    def __init__(self, spark: SparkSession, limit: int, fanout: int = FANOUT):
        self.spark, self.limit, self.fanout = spark, limit, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.hot: list[DataFrame] = []

    def _written(self, run: DataFrame) -> str:
        """A run as a table bucketed and sorted by hash, below the shared folder."""
        name = f"line_run_{uuid.uuid4().hex}"
        (run.write.bucketBy(self.buckets, "line").sortBy("line")
         .option("path", shared_path(self.spark, "line-run")).format("parquet").saveAsTable(name))
        return name

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several: a merge join, as runs are bucketed and sorted alike."""
        def met(left: DataFrame, right: DataFrame) -> DataFrame:
            both = left.join(right.withColumnRenamed("n", "m"), "line", "full")
            return both.select("line", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

        return reduce(met, runs)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, counts: DataFrame) -> None:
        """Takes a batch of ``(line, n)``, each line once with the batch's documents that hold it."""
        incoming = self._written(counts)
        batch = self.spark.table(incoming)
        rows = batch.agg(F.sum("n")).first()[0] or 0
        self.hot.append(stored(batch.where(F.col("n") * HOT_PARTS > rows).select("line"), "hot-lines"))
        runs = self.runs()
        if runs:
            # Lines that the runs know to be frequent need no more counting.
            known, seen = batch, F.lit(0)
            for i, run in enumerate(runs):
                known = known.join(run.withColumnRenamed("n", f"n{i}"), "line", "left")
                seen = seen + F.coalesce(f"n{i}", F.lit(0))
            fresh = self._written(known.where(seen < self.limit).select("line", "n"))
            self._forgotten(incoming)
        else:
            fresh = incoming
        self._placed(fresh, 0)

    def _placed(self, run: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self._written(self._merged([self.spark.table(name) for name in full]))
            for name in full:
                self._forgotten(name)
            self._placed(merged, level + 1)

    def _forgotten(self, name: str) -> None:
        """The name leaves the catalogue; its files stay in the shared folder."""
        self.spark.sql(f"DROP TABLE {name}")

    def frequent(self) -> DataFrame:
        """Hashes of lines in at least ``limit`` documents."""
        return stored(self._merged(self.runs()).where(F.col("n") >= self.limit).select("line"), "frequent-lines")

    def hot_lines(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.hot).distinct()

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self._forgotten(name)
        self.levels = []


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def text_lines(texts: DataFrame, least_chars: int, batches: int) -> DataFrame:
    """``(batch, t1, t2, line, copies)``: each line hash of each distinct text once, with the rows that are that text."""
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 1024):
                piece = part.slice(at, 1024)
                first, second, keys = [], [], []
                for t1, t2, text in zip(*(piece.column(i).to_pylist() for i in range(3))):
                    found = set(line_keys(text.encode(), least_chars)) - {None}
                    first += [t1] * len(found)
                    second += [t2] * len(found)
                    keys += found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(keys, pa.binary())],
                    names=["t1", "t2", "line"])

    found = texts.select(*_text_key(F.col("text")), "text").mapInArrow(rows, "t1 long, t2 long, line binary")
    return (
        found.groupBy("t1", "t2", "line").agg(F.count("*").alias("copies"))
        .withColumn("batch", F.pmod("t1", F.lit(batches)).cast("int")))


def dropped_lines(pairs: DataFrame, runs: LineRuns) -> DataFrame:
    """``(t1, t2, copies, dropped)``: the frequent lines of each text that has any."""
    frequent, hot = runs.frequent(), runs.hot_lines()
    slim = pairs.select("t1", "t2", "line", "copies")
    # At most HOT_PARTS hashes of 16 bytes for each batch.
    at_once = F.broadcast(hot.join(frequent, "line", "left_semi"))
    met = slim.join(at_once, "line", "left_semi").unionByName(
        slim.join(F.broadcast(hot), "line", "left_anti").join(frequent, "line", "left_semi"))
    return met.groupBy("t1", "t2").agg(F.collect_list("line").alias("dropped"), F.max("copies").alias("copies"))


def without_frequent_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
    least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT,
) -> DataFrame:
    """``(id, n_lines, n_dropped, kept)``: texts without the lines that many documents hold.

    Each row is a document, also where ids are null or repeat.  A null or empty
    text is one empty line, which no limit drops; a text may lose every line
    and is then empty.  ``kept`` is never null.  An empty table gives an empty
    result.  Other columns are not read.  Hashes of 128 bits stand for lines
    and for whole texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    path = shared_path(spark, "text-lines")
    text_lines(rows.select("text"), least_chars, batches).write.partitionBy("batch").parquet(path)
    pairs = spark.read.schema("t1 long, t2 long, line binary, copies long, batch int").parquet(path)
    runs = LineRuns(spark, least_documents, fanout)
    for batch in range(batches):
        runs.add(pairs.where(F.col("batch") == batch).groupBy("line").agg(F.sum("copies").alias("n")))
    lost = stored(dropped_lines(pairs, runs), "dropped-lines")
    runs.close()

    # Documents of a text with very many copies are dealt over several parts; there are at most HOT_PARTS such texts.
    total = rows.count()
    hot = lost.where(F.col("copies") * HOT_PARTS > total).select("t1", "t2", F.lit(SALTS).alias("salts"))
    salted = lost.join(F.broadcast(hot), ["t1", "t2"], "left").select(
        "t1", "t2", "dropped", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    dealt = F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1))).cast("int")
    keyed = (
        rows.select("id", "text", *_text_key(F.col("text"))).join(F.broadcast(hot), ["t1", "t2"], "left")
        .withColumn("salt", dealt).drop("salts"))
    met = keyed.join(salted, ["t1", "t2", "salt"], "left").select("id", "text", "dropped")

    def row(_, name, text, dropped):
        raw = text.encode()
        if not dropped:
            return name, raw.count(b"\n") + 1, 0, text
        gone = set(dropped)
        lines = raw.split(b"\n")
        kept = [line for line, key in zip(lines, line_keys(raw, least_chars)) if key not in gone]
        return name, len(lines), len(lines) - len(kept), b"\n".join(kept).decode()

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_rows(met, row, f"id {id_type}, n_lines long, n_dropped long, kept string").withColumnRenamed("id", id_col)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_frequent_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_UPPER.lower()}') AS key FROM l),
f AS (SELECT key AS frequent FROM k WHERE length(key) >= {LEAST_CHARS}
      GROUP BY key HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS})
SELECT doc_id, count(*) AS n_lines, count(frequent) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (frequent IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON key = frequent GROUP BY r, doc_id
"""
