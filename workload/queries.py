"""The registered queries: each takes a session and a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import reasoning, text
from lintlake.functions.rules import BUILTIN_RULES, RULES_BY_AGENT
from lintlake.functions.severity import SEVERITIES
from lintlake.operators import resume
from lintlake.operators.consensus import (
    consensus, consensus_with_reasoning, consensus_within, enrich, filter_min_severity,
)
from lintlake.operators.pyfacts import ast_findings, py_facts
from lintlake.operators.records import merge_record_table
from lintlake.operators.review import file_findings, findings_of_files, number_in_file, review
from lintlake.operators.rule_index import indexed_findings
from lintlake.operators.scan import regex_findings, regex_matches, rules_from_table
from lintlake.plans import audit as plans
from lintlake.plans import documents, reports
from lintlake.session import SPREAD_MOST_TASKS, even_tasks, materialize, shared_dir, spread
from lintlake.sources import log, records
from lintlake.sources.corpus import prune, skipped_files, table_corpus
from lintlake.sources.state import RunState
from lintlake.streaming import scan as streaming
from workload import corpus as tables
from workload.records import record_lines

RUN_TIME = "2024-01-01T00:00:00"
LATER = "2024-01-01T01:00:00"

SHORT = ["repo", "path", "rule_id", "match_ordinal", "line_number", "category", "severity", "confidence",
         "evidence", "ref_primary", "ref_secondary"]


def _agents(column: str = "agreeing_agents"):
    return F.array_join(column, ",").alias(column)


def _agreed_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "repo", "path", "line_number", "agent", "rule_id", "severity", "category", "evidence", "recommendation",
        "consensus_level", _agents())


# --- sources ---------------------------------------------------------------

def scannable_files(spark: SparkSession, sf: str) -> DataFrame:
    return prune(tables.mixed_files(spark, sf)).select("repo", "path", "length")


def skipped_files_of(spark: SparkSession, sf: str) -> DataFrame:
    return skipped_files(tables.mixed_files(spark, sf))


def normalized_text(spark: SparkSession, sf: str) -> DataFrame:
    """Texts are damaged — other newlines, stray bytes — and must come back whole."""
    docs = spread(tables.documents(spark, sf))
    crlf = F.replace("text", F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\r")))
    raw = F.concat(F.unhex(F.lit("FF")), F.encode(crlf, "UTF-8"), F.unhex(F.lit("E282")))
    decoded = text.decode_lenient(raw)
    return docs.select("doc_id", F.length(decoded).alias("n_chars"), F.md5(decoded).alias("digest"))


# --- detection -------------------------------------------------------------

def _regex_of(agent: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return regex_findings(tables.scannable(spark, sf), RULES_BY_AGENT[agent]).select(*SHORT)

    return query


def regex_findings_lookahead(spark: SparkSession, sf: str) -> DataFrame:
    rules = [r for r in BUILTIN_RULES if r.has_lookahead]
    return regex_findings(tables.scannable(spark, sf), rules).select(*SHORT)


def suppressed_matches(spark: SparkSession, sf: str) -> DataFrame:
    found = regex_matches(tables.scannable(spark, sf), RULES_BY_AGENT["security"], keep_suppressed=True)
    return found.where("suppressed").select("repo", "path", "line_number", text.evidence(F.col("match")).alias("evidence"))


def finding_context(spark: SparkSession, sf: str) -> DataFrame:
    found = regex_findings(tables.scannable(spark, sf), with_context=True)
    return found.select("repo", "path", "rule_id", "match_ordinal", "line_number", "context")


def findings_sorted_numbered(spark: SparkSession, sf: str) -> DataFrame:
    found = review(tables.scannable(spark, sf))
    return number_in_file(found).select("repo", "path", "number", "severity", "line_number", "rule_id")


def ast_facts(spark: SparkSession, sf: str) -> DataFrame:
    return py_facts(tables.scannable(spark, sf)).select(
        "repo", "path", "fact_ordinal", "kind", "line", "end_line", "name", "func_name", "value_str", "arg0_kind",
        "shell_true", F.array_join(F.transform("args", lambda a: F.array_join(a, ",")), ";").alias("args"))


def _syntax_of(agent: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return ast_findings(py_facts(tables.scannable(spark, sf)), [agent]).select(*SHORT)

    return query


def all_findings(spark: SparkSession, sf: str) -> DataFrame:
    return review(tables.scannable(spark, sf)).select("agent", "detector", *SHORT)


def prose_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, pages and conversations without fragments."""
    return regex_findings(tables.prose(spark, sf)).select(*SHORT)


USER_RULES = [
    ("U01", "privacy", "E-mail Mention", "HIGH", "i", r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", [["@"]]),
    ("U02", "security", "Token Mention", "CRITICAL", "i", r"""token\s*=\s*["'][^"']+["']""", [["token"]]),
    ("U03", "privacy", "Number Mention", "LOW", "", r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}\b", []),
]


def user_rules(spark: SparkSession, sf: str) -> DataFrame:
    table = spark.createDataFrame(
        USER_RULES, "rule_id string, agent string, category string, severity string, flags string, pattern string, "
        "needs array<array<string>>")
    return regex_findings(tables.prose(spark, sf), rules_from_table(table)).select(*SHORT)


def indexed_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A rule for every two neighbouring long words of the benchmark, looked for in all documents."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    pairs = items.select(words.alias("w")).where(F.size("w") > 1).select(F.explode(F.transform(
        F.sequence(F.lit(0), F.size("w") - 2),
        lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b")))).alias("p"))
    rules = pairs.where("length(p.a) >= 6 AND length(p.b) >= 6").distinct().select(
        F.concat_ws(" ", "p.a", "p.b").alias("rule_id"), F.lit("privacy").alias("agent"), F.lit("Phrase").alias("category"),
        F.lit("LOW").alias("severity"), F.lit("i").alias("flags"), F.concat(F.col("p.a"), F.lit(r"\s+"), F.col("p.b")).alias("pattern"))
    files = table_corpus(tables.documents(spark, sf).withColumn("path", F.col("doc_id").cast("string")), "source", "path", "text")
    return indexed_findings(spread(files), rules).select("repo", "path", "rule_id", "match_ordinal", "line_number")


# --- consensus -------------------------------------------------------------

def consensus_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: all reviewers, grouped by location, at least MEDIUM."""
    return _agreed_columns(plans.audit(tables.scannable(spark, sf)))


def consensus_high(spark: SparkSession, sf: str) -> DataFrame:
    return _agreed_columns(plans.audit(tables.scannable(spark, sf), min_severity="HIGH"))


def consensus_without_syntax(spark: SparkSession, sf: str) -> DataFrame:
    return _agreed_columns(plans.audit(tables.scannable(spark, sf), syntax=False))


def consensus_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    islands = consensus_within(review(tables.scannable(spark, sf)))
    return islands.select(
        "repo", "path", "line_number", "first_line", "last_line", "agent", "rule_id", "severity", "consensus_level",
        _agents(), "findings_merged")


# --- reasoning -------------------------------------------------------------

def _joined(column: str, name: str):
    return F.coalesce(F.array_join(column, "|"), F.lit("")).alias(name)


def reasoning_enriched(spark: SparkSession, sf: str) -> DataFrame:
    rich = enrich(review(tables.scannable(spark, sf)), RUN_TIME).where(F.col("cot").isNotNull())
    return rich.select(
        "repo", "path", "rule_id", "match_ordinal",
        F.col("cot.detection.pattern_matched").alias("pattern"),
        F.col("cot.detection.evidence_summary").alias("evidence_summary"),
        _joined("cot.detection.signals_observed", "signals"),
        F.col("cot.risk.severity_reasoning").alias("reason"),
        F.col("cot.risk.data_sensitivity").alias("sensitivity"),
        _joined("cot.risk.compliance_impact", "compliance"),
        F.col("cot.attack.exploitability_rating").alias("rating"),
        _joined("cot.attack.similar_cves", "cves"),
        F.col("cot.confidence.confidence_level").alias("confidence_level"),
        _joined("cot.confidence.weak_evidence", "weak"),
        F.col("cot.remediation.recommended_fix").alias("fix"),
        F.col("cot.remediation.implementation_complexity").alias("complexity"),
        F.col("cot.remediation.breaking_changes").alias("breaking"),
        _joined("cot.context.missing_controls", "missing"),
        F.col("cot.generated_at").alias("generated_at"))


def consensus_reasoned(spark: SparkSession, sf: str) -> DataFrame:
    """What the consensus with reasoning says besides its records."""
    rich = consensus_with_reasoning(review(tables.scannable(spark, sf)), RUN_TIME)
    return rich.select(
        "repo", "path", "line_number", "rule_id", "severity", "consensus_level", _agents(), "findings_merged",
        F.col("cot").isNotNull().alias("reasoned"))


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    rich = consensus_with_reasoning(review(tables.scannable(spark, sf)), RUN_TIME)
    return rich.where(F.col("cot.generated_by_agent") == "consensus")


def reasoning_merged(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).select(
        "repo", "path", "line_number", "consensus_level",
        F.col("cot.detection.pattern_matched").alias("pattern"),
        _joined("cot.detection.signals_observed", "signals"),
        F.col("cot.risk.severity_reasoning").alias("first_reasons"),
        _joined("cot.risk.affected_assets", "assets"),
        F.col("cot.risk.attack_surface").alias("surface"),
        F.col("cot.risk.data_sensitivity").alias("sensitivity"),
        _joined("cot.risk.compliance_impact", "compliance"),
        F.col("cot.attack.attack_vector").alias("vector"),
        _joined("cot.attack.attack_steps", "steps"),
        F.col("cot.attack.exploitability_rating").alias("rating"),
        _joined("cot.attack.similar_cves", "cves"),
        F.col("cot.confidence.confidence_level").alias("confidence_level"),
        _joined("cot.confidence.strong_evidence", "strong"),
        _joined("cot.confidence.weak_evidence", "weak"),
        F.col("cot.remediation.recommended_fix").alias("fix"),
        _joined("cot.remediation.alternative_fixes", "fixes"),
        F.col("cot.remediation.implementation_complexity").alias("complexity"),
        F.col("cot.remediation.breaking_changes").alias("breaking"),
        _joined("cot.context.missing_controls", "missing"))


def summary_text(spark: SparkSession, sf: str) -> DataFrame:
    rich = enrich(review(tables.scannable(spark, sf)), RUN_TIME).where(F.col("cot").isNotNull())
    return rich.select("repo", "path", "rule_id", "match_ordinal", reasoning.summary_text(F.col("cot")).alias("summary"))


def record_json(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as JSON and read back are the records they were."""
    rich = enrich(review(tables.scannable(spark, sf)), RUN_TIME).where(F.col("cot").isNotNull())
    written = rich.withColumn("back", reasoning.from_json(reasoning.to_json(F.col("cot"))))
    return written.select(
        "repo", "path", "rule_id", "match_ordinal",
        F.col("back.detection.pattern_matched").alias("pattern"),
        F.size("back.attack.attack_steps").alias("steps"),
        (F.col("back") == F.col("cot")).alias("unchanged"))


def _handed_in(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_dir(spark, "records")
    record_lines(spark, sf).write.text(folder)
    return records.parsed_lines(spark.read.text(folder))


def record_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that are no records, by reason."""
    return records.rejects_of(_handed_in(spark, sf)).groupBy("reason").agg(F.count("*").alias("lines"))


def records_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Every field of the records merged by location, from a table of JSON lines."""
    merged = merge_record_table(records.records_of(_handed_in(spark, sf)))
    lists, plain = [], []
    for part in reasoning.RECORD_TYPE.fields:
        for field in getattr(part.dataType, "fields", []):
            name = f"merged.{part.name}.{field.name}"
            if field.dataType == reasoning.STRINGS:
                lists.append(_joined(name, field.name))
            else:
                plain.append(F.col(name).alias(field.name if field.name != "reasoning" else "doubt"))
    return merged.select("repo", "path", "line_number", "records", F.array_join("agents", ",").alias("agreeing_agents"), *plain, *lists,
                         F.col("merged.generated_by_agent").alias("generated_by"))


def compliance_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return reports.compliance_coverage(enrich(review(tables.scannable(spark, sf)), RUN_TIME))


# --- reports ---------------------------------------------------------------

def _agreed(spark: SparkSession, sf: str) -> DataFrame:
    return plans.audit(tables.scannable(spark, sf))


def agent_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.agent_counts(review(tables.scannable(spark, sf)))


def consensus_levels(spark: SparkSession, sf: str) -> DataFrame:
    return reports.consensus_levels(_agreed(spark, sf))


def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.severity_counts(_agreed(spark, sf))


def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.category_counts(_agreed(spark, sf))


def repo_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.repo_counts(_agreed(spark, sf))


def findings_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return reports.findings_rollup(_agreed(spark, sf))


def top_repos(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_repos(_agreed(spark, sf))


def _stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Findings and consensus as tables, so that several reports share one scan."""
    return _stored_of(review(tables.scannable(spark, sf)))


def _stored_of(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = materialize(findings, "findings")
    agreed = materialize(filter_min_severity(consensus(found)), "consensus")
    return found, agreed


def repo_summary(spark: SparkSession, sf: str) -> DataFrame:
    found, agreed = _stored(spark, sf)
    return reports.repo_summary(tables.source_files(spark, sf), found, agreed)


def repo_summary_markdown(spark: SparkSession, sf: str) -> DataFrame:
    found, agreed = _stored(spark, sf)
    summary = reports.repo_summary(tables.source_files(spark, sf), found, agreed)
    return reports.repo_summary_markdown(summary, RUN_TIME)


def reviewer_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.reviewer_totals(review(tables.scannable(spark, sf)))


def run_report(spark: SparkSession, sf: str) -> DataFrame:
    found, agreed = _stored(spark, sf)
    return reports.run_report(tables.source_files(spark, sf), found, agreed)


def run_report_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """The report of a run that was taken up again: with what its log and its state say."""
    # What the interrupted run logged and what this one reports come from one scan.
    scanned = materialize(file_findings(tables.scannable(spark, sf)).select("repo", "path", "found"), "scanned")
    state = _interrupted_of(spark, plans.audit_of_files(scanned))
    found, agreed = _stored_of(findings_of_files(scanned))
    return reports.run_report(
        tables.source_files(spark, sf), found, agreed, log.log_stats(spark, state.log_dir), resume.resume_state(state))


def reviewer_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The three reviewers' reports in full: every finding, numbered in its file, and where its block stands."""
    found = materialize(review(tables.scannable(spark, sf)), "findings")
    return documents.reviewer_listing(found, RUN_TIME)


def run_document(spark: SparkSession, sf: str) -> DataFrame:
    """The run's JSON report in fragments, whose concatenation is one document."""
    found, agreed = _stored(spark, sf)
    return documents.run_document(found, agreed, RUN_TIME, 1.5)


def findings_json(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON document per file, written by repository and read back."""
    folder = shared_dir(spark, "findings-json")
    plans.write_findings_json(_agreed(spark, sf), folder)
    return spark.read.text(folder).select("repo", "value")


# --- log, state, resume ----------------------------------------------------

def _log_of(spark: SparkSession, sf: str) -> str:
    """A log as an unlucky run leaves it: findings, two markers, a damaged line,
    and the critical findings once more."""
    folder = shared_dir(spark, "log")
    agreed = materialize(_agreed(spark, sf), "consensus")
    log.append_findings(agreed, folder, RUN_TIME)
    log.append_checkpoint(spark, folder, RUN_TIME, {"files": 1})
    spark.range(1).select(F.lit('{"type": "finding", "fin').alias("value")).write.mode("append").text(folder)
    log.append_findings(agreed.where("severity = 'CRITICAL'"), folder, LATER)
    log.append_checkpoint(spark, folder, LATER, {"files": 2})
    return folder


def log_replay(spark: SparkSession, sf: str) -> DataFrame:
    return log.replay_once(spark, _log_of(spark, sf)).select(
        "finding_id", "repo", "file", "severity", "category", "line_number", "evidence", "consensus_level", _agents())


def log_stats(spark: SparkSession, sf: str) -> DataFrame:
    return log.log_stats(spark, _log_of(spark, sf))


def last_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    folder = _log_of(spark, sf)
    return log.last_checkpoint(spark, folder).select("timestamp", F.col("data")["files"].alias("files"))


def _interrupted(spark: SparkSession, sf: str) -> RunState:
    """Critical findings were logged and their files saved; high ones were
    logged, but the run died before their files were saved."""
    return _interrupted_of(spark, _agreed(spark, sf))


def _interrupted_of(spark: SparkSession, audited: DataFrame) -> RunState:
    state = RunState(spark, shared_dir(spark, "run"))
    agreed = materialize(audited, "consensus")
    critical = agreed.where("severity = 'CRITICAL'")
    log.append_findings(critical, state.log_dir, RUN_TIME)
    state.save_files(critical.select("repo", "path").distinct(), RUN_TIME, "src0")
    log.append_findings(agreed.where("severity = 'HIGH'"), state.log_dir, LATER)
    return state


def resume_pending_files(spark: SparkSession, sf: str) -> DataFrame:
    state = _interrupted(spark, sf)
    corpus = tables.source_files(spark, sf)
    # The keys are used three times; stored, the log is parsed once for them.
    done = materialize(resume.files_to_skip(state), "done")
    return resume.pending_files(corpus, done).select("repo", "path")


def resume_pending_repos(spark: SparkSession, sf: str) -> DataFrame:
    """Repositories with a three-way agreement count as completed."""
    done = materialize(_agreed(spark, sf).where("consensus_level = 3").select("repo").distinct(), "completed")
    return resume.pending_repos(tables.source_files(spark, sf), done).select("repo", "path")


def resume_state(spark: SparkSession, sf: str) -> DataFrame:
    return resume.resume_state(_interrupted(spark, sf))


def state_validation(spark: SparkSession, sf: str) -> DataFrame:
    state = _interrupted(spark, sf)
    checked = resume.validate_state(resume.resume_state(state)).withColumn("one", F.lit(1))
    unfinished = resume.is_unfinished(state).withColumn("one", F.lit(1))
    info = state.info().withColumn("one", F.lit(1))
    return checked.join(unfinished, "one").join(info, "one").select(
        "is_valid", "counts_match", "findings_count", "unfinished", "has_file_checkpoint", "has_repo_checkpoint",
        "has_summary_checkpoint", "latest_timestamp", "latest_type")


def log_order(spark: SparkSession, sf: str) -> DataFrame:
    """Markers of one timestamp: the last one is the one written last, and tells what came before it."""
    folder = shared_dir(spark, "log")
    agreed = materialize(_agreed(spark, sf), "consensus")
    for level in (1, 2, 3):
        log.append_findings(agreed.where(F.col("consensus_level") == level), folder, RUN_TIME)
        log.append_checkpoint(spark, folder, RUN_TIME, {"level": level})
    log.append_findings(agreed.where("severity = 'CRITICAL'"), folder, RUN_TIME)
    last = log.last_checkpoint(spark, folder)
    at = last.select("position").scalar()
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).agg(F.sum(F.octet_length("value") + 1))
    return log.replay(spark, folder).agg(
        F.count_if(F.col("position") < at).alias("before"), F.count_if(F.col("position") > at).alias("after")).select(
        last.select(F.col("data")["level"]).scalar().alias("level"), "before", "after",
        (log.log_bytes(spark, folder).scalar() == lines.scalar()).alias("sized"))


def resume_states(spark: SparkSession, sf: str) -> DataFrame:
    """Where a run resumes from: files saved, repositories saved, finished, a log alone, and nothing at all."""
    agreed = materialize(_agreed(spark, sf), "consensus")

    def state() -> RunState:
        fresh = RunState(spark, shared_dir(spark, "run"))
        log.append_findings(agreed.where("severity = 'CRITICAL'"), fresh.log_dir, RUN_TIME)
        return fresh

    by_file, by_repo, finished, by_log = state(), state(), state(), state()
    done = agreed.where("severity = 'CRITICAL'")
    by_file.save_files(done.select("repo", "path").distinct(), RUN_TIME, "src0")
    by_repo.save_files(done.select("repo", "path").distinct(), RUN_TIME, "src0")
    by_repo.save_repos(done.select("repo"), LATER, 1.5)
    finished.save_repos(done.select("repo"), RUN_TIME)
    finished.save_summary(LATER, 2.5)
    # A new run in the same folder shares the log's folder with nobody.
    nothing = RunState(spark, shared_dir(spark, "run"))
    out = None
    for name, each in (("files", by_file), ("repos", by_repo), ("finished", finished), ("log", by_log), ("nothing", nothing)):
        at = resume.resume_state(each)
        rows = resume.validate_state(at).select(
            F.lit(name).alias("state"), "recovery_method", "checkpoint_type", "files_scanned", "findings_count", "repos_completed",
            "current_repo", "is_valid", "counts_match", resume.is_unfinished(each).scalar().alias("unfinished"),
            resume.recovery_summary(at).scalar().alias("summary"))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- streaming -------------------------------------------------------------

def _document_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        rows = streaming.table_stream(spark, f"{sf}/documents.parquet", schema)
    else:
        rows = streaming.table_stream(spark, sf, schema, glob="documents.parquet")
    return prune(table_corpus(tables.as_files(rows), "repo", "path", "content"), max_bytes=None)


def stream_findings(spark: SparkSession, sf: str) -> DataFrame:
    out, progress = shared_dir(spark, "stream-out"), shared_dir(spark, "stream-progress")
    streaming.scan_stream(_document_stream(spark, sf), out, progress, prepare=spread).awaitTermination()
    return _agreed_columns(spark.read.parquet(out))


def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    out, progress = shared_dir(spark, "counts-out"), shared_dir(spark, "counts-progress")
    streaming.running_counts(_document_stream(spark, sf), out, progress).awaitTermination()
    return streaming.latest_counts(spark, out)


def _tracked_stream(spark: SparkSession, sf: str) -> tuple[str, str, str]:
    """A scan of files that arrive in two parts, by bytes, stopped in between; its first batch is then repeated."""
    arriving, progress = shared_dir(spark, "arriving"), shared_dir(spark, "stream-progress")
    out, totals, told = (shared_dir(spark, f"tracked-{name}") for name in ("out", "totals", "progress"))
    files = tables.source_files(spark, sf)
    later = F.pmod(F.xxhash64("path"), F.lit(3)) == 0
    # Parts of bounded size arrive, and a batch takes a third of what there is: the number of batches stays.
    most = min(even_tasks(files), SPREAD_MOST_TASKS)
    for part in (files.where(~later).repartition(max(3, most * 2 // 3), "path"), files.where(later).repartition(max(2, most // 3), "path")):
        part.write.mode("append").parquet(arriving)
        third = log.log_bytes(spark, arriving).first()["bytes"] // 3
        stream = streaming.table_stream(spark, arriving, files.schema, bytes_per_batch=max(1, third))
        streaming.scan_stream(stream, out, progress, prepare=spread, totals_dir=totals, progress_dir=told).awaitTermination()
    first = spark.read.parquet(out).where("batch_id = 0").select("repo", "path").distinct()
    again = streaming.BatchScan(out, prepare=spread, totals_dir=totals)
    # A file without findings adds nothing, so the files with findings are the batch.
    again(files.join(first, ["repo", "path"], "left_semi"), 0)
    return out, totals, told


def stream_totals(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.stream_totals(spark, _tracked_stream(spark, sf)[1])


def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    """How far the stream has come, at its end."""
    told = streaming.scan_progress(spark, _tracked_stream(spark, sf)[2], tables.source_files(spark, sf).count())
    return told.agg(
        F.max("files_so_far").alias("files"), F.max("findings_so_far").alias("findings"), F.sum("bytes").alias("bytes"),
        F.max("percent").alias("percent"), (F.count("*") >= 3).alias("in_batches"), F.bool_and(F.col("files_per_second") > 0).alias("rated"))


QUERIES = {
    "scannable_files": scannable_files,
    "skipped_files": skipped_files_of,
    "normalized_text": normalized_text,
    "regex_findings_security": _regex_of("security"),
    "regex_findings_privacy": _regex_of("privacy"),
    "regex_findings_permission": _regex_of("permission"),
    "regex_findings_lookahead": regex_findings_lookahead,
    "suppressed_matches": suppressed_matches,
    "finding_context": finding_context,
    "consensus_reasoned": consensus_reasoned,
    "findings_sorted_numbered": findings_sorted_numbered,
    "ast_facts": ast_facts,
    "ast_findings_security": _syntax_of("security"),
    "ast_findings_privacy": _syntax_of("privacy"),
    "all_findings": all_findings,
    "prose_findings": prose_findings,
    "user_rules": user_rules,
    "indexed_rules": indexed_rules,
    "consensus_findings": consensus_findings,
    "consensus_high": consensus_high,
    "consensus_without_syntax": consensus_without_syntax,
    "consensus_tolerance": consensus_tolerance,
    "reasoning_enriched": reasoning_enriched,
    "reasoning_merged": reasoning_merged,
    "summary_text": summary_text,
    "record_json": record_json,
    "record_rejects": record_rejects,
    "records_merged": records_merged,
    "compliance_coverage": compliance_coverage,
    "agent_counts": agent_counts,
    "consensus_levels": consensus_levels,
    "severity_counts": severity_counts,
    "category_counts": category_counts,
    "repo_counts": repo_counts,
    "findings_rollup": findings_rollup,
    "top_repos": top_repos,
    "repo_summary": repo_summary,
    "repo_summary_markdown": repo_summary_markdown,
    "reviewer_report": reviewer_report,
    "run_report": run_report,
    "run_report_resumed": run_report_resumed,
    "findings_json": findings_json,
    "reviewer_listing": reviewer_listing,
    "run_document": run_document,
    "log_replay": log_replay,
    "log_stats": log_stats,
    "last_checkpoint": last_checkpoint,
    "resume_pending_files": resume_pending_files,
    "resume_pending_repos": resume_pending_repos,
    "resume_state": resume_state,
    "resume_states": resume_states,
    "log_order": log_order,
    "state_validation": state_validation,
    "stream_findings": stream_findings,
    "stream_counts": stream_counts,
    "stream_totals": stream_totals,
    "stream_progress": stream_progress,
}
