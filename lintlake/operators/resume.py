"""Resuming a run: what is left to do, and where the state comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.session import fits_broadcast
from lintlake.sources import log
from lintlake.sources.state import REPO, SUMMARY, RunState

# Names of the recovery methods.
FROM_STATE, FROM_LOG, FROM_NOTHING = "checkpoint", "transaction_log", "none"

KEY = ["repo", "path"]
# Bits of a key filter (2 MB) and how many of them a key sets.
FILTER_BITS = 1 << 24
FILTER_HASHES = 4


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """One row with one array of longs: the Bloom filter of the keys, built by hash aggregates.

    Its size depends on ``bits`` alone.  More keys make it let more strangers
    pass, and never lose one of its own.
    """
    words = bits // 64
    places = keys.select(F.explode(F.array(*_places(bits))).alias("at")).select(
        F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bit"))
    every = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
    filled = places.unionByName(every).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    return filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bit"))), lambda w: w["bit"]).alias("words"))


def _places(bits: int) -> list[Column]:
    """The bits of a key: multiples of one hash from another."""
    first, step = F.xxhash64(*KEY), F.xxhash64(F.lit(1), *KEY)
    return [F.pmod(first.bitwiseXOR(F.xxhash64(F.lit(i), step)), F.lit(bits).cast("long")) for i in range(FILTER_HASHES)]


def passes(words: Column, bits: int) -> Column:
    """Whether the filter lets a row's key pass."""
    def holds(at: Column) -> Column:
        word = F.get(words, F.shiftright(at, 6).cast("int"))
        return F.getbit(word, at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

    out = F.lit(True)
    for at in _places(bits):
        out = out & holds(at)
    return out


def pending_files(corpus: DataFrame, processed: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Files of the corpus that are not processed yet.

    Contents are read once and tested where they are read.  A filter of the
    processed keys tells most pending files at once.  A second one, of the
    pending keys that pass the first, tells most processed files.  What passes
    both and is processed after all is known by keys alone, and those few keys
    are what the contents meet in an anti-join; they are the first filter's
    errors and the second's at once, so the planner broadcasts them unless the
    filters are overfull.  No job runs while the plan is built.
    """
    keys = processed.select(*KEY)
    may_be_done = passes(key_filter(keys, filter_bits).scalar(), filter_bits)
    suspects = corpus.select(*KEY).where(may_be_done).join(keys, KEY, "left_anti")
    may_be_suspect = passes(key_filter(suspects, filter_bits).scalar(), filter_bits)
    mistaken = keys.where(may_be_suspect)
    return corpus.where(~may_be_done | may_be_suspect).join(mistaken, KEY, "left_anti")


def pending_repos(corpus: DataFrame, completed: DataFrame) -> DataFrame:
    """Files of repositories that are not completed.  Repository names are few;
    they are broadcast when their size allows it."""
    names = completed.select("repo")
    side = F.broadcast(names) if fits_broadcast(names) else names
    return corpus.join(side, "repo", "left_anti")


def resume_state(state: RunState) -> DataFrame:
    """One row: where a resumed run starts from.

    The checkpoint wins when there is one, otherwise the log speaks; the number
    of findings always comes from the log.  From a log alone only files count
    as done, because a repository with findings may be half finished.
    """
    logged = log.replay(state.spark, state.log_dir).agg(
        F.count("*").alias("log_findings"), F.count_distinct("repo", "file").alias("log_files"))
    saved = state.latest().agg(
        F.max("checkpoint_type").alias("checkpoint_type"),
        F.max("timestamp").alias("checkpoint_timestamp"),
        F.max("files_scanned").alias("saved_files"),
        F.max("findings_count").alias("saved_findings"),
        F.max("repos_completed").alias("saved_repos"),
        F.max("repo_name").alias("current_repo"),
    )
    row = logged.withColumn("one", F.lit(1)).join(saved.withColumn("one", F.lit(1)), "one")
    has_state = F.col("checkpoint_type").isNotNull()
    has_log = F.col("log_findings") > 0
    method = F.when(has_state, FROM_STATE).when(has_log, FROM_LOG).otherwise(FROM_NOTHING)
    return row.select(
        method.alias("recovery_method"),
        "checkpoint_type",
        "checkpoint_timestamp",
        F.when(has_state, F.col("saved_files")).otherwise(F.col("log_files")).alias("files_scanned"),
        F.when(has_state, F.col("saved_findings")).otherwise(F.col("log_findings")).alias("findings_count"),
        F.when(has_state & ~F.col("checkpoint_type").isin(SUMMARY), F.col("saved_repos"))
        .otherwise(F.lit(0)).alias("repos_completed"),
        F.when(F.col("checkpoint_type") != REPO, F.col("current_repo")).alias("current_repo"),
        "log_findings",
    )


def is_unfinished(state: RunState) -> DataFrame:
    """One row: did a run start that has no summary yet?"""
    started = resume_state(state).select(
        (F.col("recovery_method") != FROM_NOTHING).alias("started"), F.lit(1).alias("one"))
    ended = state.info().select("has_summary_checkpoint", F.lit(1).alias("one"))
    return started.join(ended, "one").select(
        (F.col("started") & ~F.col("has_summary_checkpoint")).alias("unfinished"))


def validate_state(resume: DataFrame) -> DataFrame:
    """Reconciles the counts; the log is the source of truth."""
    return resume.withColumns({
        "is_valid": F.col("recovery_method").isin(FROM_STATE, FROM_LOG, FROM_NOTHING)
        & F.col("files_scanned").isNotNull(),
        "counts_match": F.col("findings_count") == F.col("log_findings"),
        "findings_count": F.col("log_findings"),
    })


def recovery_summary(resume: DataFrame) -> DataFrame:
    """A short text on what a resumed run takes over."""
    return resume.select(F.concat_ws(
        "\n",
        F.concat(F.lit("Resumed by: "), "recovery_method"),
        F.concat(F.lit("State saved at: "), "checkpoint_timestamp"),
        F.concat(F.lit("Files done: "), F.col("files_scanned").cast("string")),
        F.concat(F.lit("Findings: "), F.col("findings_count").cast("string")),
        F.concat(F.lit("Repositories done: "), F.col("repos_completed").cast("string")),
        F.concat(F.lit("Repository under way: "), "current_repo"),
    ).alias("summary"))


def files_to_skip(state: RunState) -> DataFrame:
    """Keys of finished files: from the state, plus those the log proves."""
    logged = log.replay(state.spark, state.log_dir).select("repo", F.col("file").alias("path")).distinct()
    known = state.processed()
    return known.unionByName(logged.join(known, KEY, "left_anti"))
