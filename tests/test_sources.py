"""File corpora, sinks, log, state, resume and streams on real folders."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lintlake.operators import resume
from lintlake.operators.consensus import consensus
from lintlake.operators.review import review
from lintlake.plans import audit as plans
from lintlake.plans import reports
from lintlake.sources import log
from lintlake.sources.corpus import prune, repository_corpus, reviewer_corpus, skipped_files
from lintlake.sources.state import FILE, REPO, SUMMARY, RunState
from lintlake.streaming import scan as streaming


def make(root, tree):
    for name, data in tree.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(root)


TREE = {
    "alpha/src/a.py": "eval(x)\r\npassword = 'abcdefgh1'\r",
    "alpha/b c/x.sql": b"select * \xff from t; -- \xef\xbf\xbd",
    "alpha/.py": "eval(x)",
    "alpha/src/A.PY": "eval(x)",
    "alpha/node_modules/p/i.js": "eval(x)",
    "alpha/src/big.py": "#" * 1_000_001,
    "alpha/src/edge.py": "#" * 999_993 + "\neval(x",
    "alpha/README.md": "eval(x)",
    "beta/deep/er/q.yml": "debug = true",
    ".hidden/a.py": "eval(x)",
    "loose.py": "eval(x)",
}


def test_repository_corpus(spark, tmp_path):
    corpus = repository_corpus(spark, make(tmp_path / "repos", TREE))
    rows = {r.path: r for r in corpus.collect()}
    assert set(rows) == {"alpha/src/a.py", "alpha/b c/x.sql", "alpha/src/edge.py", "beta/deep/er/q.yml"}
    assert rows["alpha/src/a.py"].content == "eval(x)\npassword = 'abcdefgh1'\n"
    assert rows["alpha/b c/x.sql"].content == "select *  from t; -- �"
    assert {r.repo for r in rows.values()} == {"alpha", "beta"}


def test_listing_is_pruned_before_content_is_read(spark, tmp_path):
    corpus = repository_corpus(spark, make(tmp_path / "repos", TREE))
    plan = corpus._jdf.queryExecution().executedPlan().toString()
    assert "file_path" in plan and "file_size" in plan
    assert "PartitionFilters" in plan


def test_reviewer_corpus(spark, tmp_path):
    root = make(tmp_path / "one", {"a.py": "eval(x)", "b.xml": "<a/>", "c.tf": "x", "bad.py": b"\xff", "sub/d.py": "eval(y)"})
    names = lambda df: sorted(r.path for r in df.collect())
    assert names(reviewer_corpus(spark, root, "security")) == ["a.py", "b.xml", "sub/d.py"]
    assert names(reviewer_corpus(spark, root, "security", recursive=False)) == ["a.py", "b.xml"]
    assert names(reviewer_corpus(spark, root, "permission")) == ["a.py", "c.tf", "sub/d.py"]


def agreed(files):
    corpus = files(
        ("one/a.py", "eval(x)\npassword = 'abcdefgh1'"), ("one/b.py", "x = 1"), ("two/c.sql", "USE ROLE ACCOUNTADMIN;"))
    return corpus, consensus(review(corpus))


def test_json_and_markdown_sinks(spark, files, tmp_path):
    corpus, found = agreed(files)
    plans.write_findings_json(found, str(tmp_path / "json"))
    lines = spark.read.text(str(tmp_path / "json")).collect()
    documents = {json.loads(r.value)["file"]: (r.repo, json.loads(r.value)["findings"]) for r in lines}
    assert set(documents) == {"one/a.py", "two/c.sql"}
    repo, entries = documents["two/c.sql"]
    assert repo == "two" and entries[0]["agreeing_agents"] == ["permission", "security"]
    assert [e["line_number"] for e in documents["one/a.py"][1]] == sorted(e["line_number"] for e in documents["one/a.py"][1])
    summary = reports.repo_summary(corpus, review(corpus), found)
    plans.write_repo_summaries(reports.repo_summary_markdown(summary, "T"), str(tmp_path / "md"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "md/repo=two")).collect())
    assert "# Audit of two" in text and "| CRITICAL | 1 |" in text and "| LOW | 0 |" in text
    plans.write_run_report(reports.run_report(corpus, review(corpus), found), str(tmp_path / "report"))
    assert any(r.value.startswith("top_repos\tone\t") for r in spark.read.text(str(tmp_path / "report")).collect())
    meta = json.loads(plans.run_metadata(review(corpus), "T", 1.5).collect()[0].value)
    assert meta["scan_type"] == "consensus" and meta["statistics"]["permission"] >= 1


def test_log_append_replay_stats(spark, files, tmp_path):
    folder = str(tmp_path / "log")
    assert log.replay(spark, folder).count() == 0 and log.last_checkpoint(spark, folder).count() == 0
    _, found = agreed(files)
    n = found.count()
    log.append_findings(found, folder, "T1")
    log.append_checkpoint(spark, folder, "T1", {"files_scanned": 2})
    (tmp_path / "log" / "part-damaged.txt").write_text('\n\n{"type": "finding", "fin\nnot json\n')
    log.append_checkpoint(spark, folder, "T2", {"files_scanned": 3})
    rows = log.replay(spark, folder).collect()
    assert len(rows) == n and {r.logged_at for r in rows} == {"T1"}
    assert {r.file for r in rows} == {"one/a.py", "two/c.sql"}
    stats = log.log_stats(spark, folder).collect()[0]
    assert (stats.total_entries, stats.findings_count, stats.checkpoint_count) == (n + 4, n, 2)
    last = log.last_checkpoint(spark, folder).collect()[0]
    assert last.timestamp == "T2" and last.data == {"files_scanned": "3"}
    assert log.log_bytes(spark, folder).collect()[0].bytes > 0
    log.append_findings(found, folder, "T3")
    assert log.replay(spark, folder).count() == 2 * n and log.replay_once(spark, folder).count() == n


def test_state_and_resume(spark, files, tmp_path):
    corpus, found = agreed(files)
    state = RunState(spark, str(tmp_path / "run"))
    first = resume.resume_state(state).collect()[0]
    assert first.recovery_method == "none" and not resume.is_unfinished(state).collect()[0].unfinished
    assert state.latest().count() == 0

    log.append_findings(found.where("repo = 'one'"), state.log_dir, "T1")
    from_log = resume.resume_state(state).collect()[0]
    assert (from_log.recovery_method, from_log.files_scanned) == ("transaction_log", 1)
    assert resume.is_unfinished(state).collect()[0].unfinished

    state.save_files(corpus.where("repo = 'one'"), "T2", "one")
    log.append_findings(found.where("repo = 'two'"), state.log_dir, "T3")
    row = resume.validate_state(resume.resume_state(state)).collect()[0]
    assert (row.recovery_method, row.checkpoint_type, row.files_scanned, row.current_repo) == ("checkpoint", FILE, 2, "one")
    assert row.is_valid and not row.counts_match and row.findings_count == found.count()
    text = resume.recovery_summary(resume.resume_state(state)).collect()[0].summary
    assert "Resumed by: checkpoint" in text and "Files done: 2" in text

    left = resume.pending_files(corpus, resume.files_to_skip(state))
    assert [r.path for r in left.collect()] == []
    assert [r.path for r in resume.pending_files(corpus, state.processed()).collect()] == ["two/c.sql"]

    state.save_repos(corpus.where("repo = 'one'").select("repo"), "T4", 2.0)
    assert state.latest().collect()[0].checkpoint_type == REPO
    assert state.latest(FILE).collect()[0].timestamp == "T2"
    assert {r.repo for r in resume.pending_repos(corpus, state.completed()).collect()} == {"two"}
    state.save_summary("T5", 3.0)
    info = state.info().collect()[0]
    assert (info.has_file_checkpoint, info.has_repo_checkpoint, info.has_summary_checkpoint) == (True, True, True)
    assert (info.latest_type, info.latest_timestamp) == (SUMMARY, "T5")
    assert not resume.is_unfinished(state).collect()[0].unfinished

    other = RunState(spark, str(tmp_path / "run"))
    assert other.latest().count() == 0 and other.processed().count() == 0


@pytest.mark.parametrize("bits", [64, 1024, 1 << 20])
def test_pending_files_are_exact_whatever_the_filter(spark, bits):
    """Also when the filter is overfull and nothing may be broadcast; contents are read once."""
    corpus = spark.range(3000).select(
        F.concat(F.lit("r"), (F.col("id") % 7).cast("string")).alias("repo"),
        F.concat(F.lit("p/"), F.col("id").cast("string")).alias("path"), F.lit("text").alias("content"), F.col("id"))
    done = corpus.where("id % 3 = 0").select("repo", "path").unionByName(corpus.where("id = 5").select("repo", "path")).unionByName(
        corpus.where("id = 5").select(F.lit("gone").alias("repo"), "path"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = sorted(r.id for r in resume.pending_files(corpus, done, bits).collect())
        assert left == [i for i in range(3000) if i % 3 and i != 5]
        assert resume.pending_files(corpus, done.limit(0), bits).count() == 3000
        assert resume.pending_files(corpus.limit(0), done, bits).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_file_stream_equals_batch_and_resumes(spark, tmp_path):
    root = make(tmp_path / "repos", {f"r{i % 3}/src/f{i}.py": "eval(x)\nUSE ROLE ACCOUNTADMIN" for i in range(25)})
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    run = lambda: streaming.scan_stream(streaming.file_stream(spark, root, 10), out, progress).awaitTermination()
    run()
    table = spark.read.parquet(out)
    assert table.select("batch_id").distinct().count() == 3
    columns = ["repo", "path", "line_number", "rule_id", "consensus_level"]
    batch = plans.audit(repository_corpus(spark, root)).select(*columns)
    key = lambda r: tuple(r)
    assert sorted(table.select(*columns).collect(), key=key) == sorted(batch.collect(), key=key)
    run()
    assert spark.read.parquet(out).count() == batch.count()
    make(tmp_path / "repos", {"r9/new.py": "eval(y)"})
    run()
    again = spark.read.parquet(out)
    assert again.where("repo = 'r9'").count() == 1 and again.count() == batch.count() + 1


def test_a_repeated_batch_leaves_each_finding_once(spark, files, tmp_path):
    _, found = agreed(files)
    for _ in range(2):
        streaming._replace_batch(found, 7, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == found.count()


def test_running_counts(spark, tmp_path):
    root = make(tmp_path / "repos", {f"r/f{i}.py": "eval(x)\nmd5" for i in range(12)})
    out = str(tmp_path / "counts")
    query = streaming.running_counts(streaming.file_stream(spark, root, 5), out, str(tmp_path / "p"))
    query.awaitTermination()
    got = {(r.agent, r.severity): r.findings for r in streaming.latest_counts(spark, out).collect()}
    assert got == {("security", "HIGH"): 24}
    assert len(streaming.arrival_rate(query)) >= 3


def test_counters_over_batches(spark, tmp_path):
    """Three batches by bytes with a stop, one of them repeated, and one without any file that a scan reads."""
    paths = {name: str(tmp_path / name) for name in ("out", "totals", "progress", "checkpoint")}
    root = make(tmp_path / "repos", {f"r{i % 2}/f{i}.py": "eval(x)\nUSE ROLE ACCOUNTADMIN" for i in range(2)})

    def run():
        stream = streaming.file_stream(spark, root, bytes_per_batch=1)
        streaming.scan_stream(
            stream, paths["out"], paths["checkpoint"], totals_dir=paths["totals"], progress_dir=paths["progress"]).awaitTermination()

    run()
    make(tmp_path / "repos", {"r1/late.py": "y = hashlib.md5(b)"})
    run()
    make(tmp_path / "repos", {"r1/notes.md": "eval(x)", "r1/nothing.py": "x = 1"})
    run()
    once = sorted(map(tuple, streaming.stream_totals(spark, paths["totals"]).collect()))
    agreed_now = plans.audit(repository_corpus(spark, root))
    want = [("all", "all", agreed_now.count())] + [
        (c, str(r[0]), r[1]) for c in streaming.TOTALS for r in agreed_now.groupBy(c).count().collect()]
    assert once == sorted(want)
    streaming.BatchScan(paths["out"], totals_dir=paths["totals"], progress_dir=paths["progress"])(
        repository_corpus(spark, root).where("path = 'r1/late.py'"), 2)
    assert sorted(map(tuple, streaming.stream_totals(spark, paths["totals"]).collect())) == once
    told = streaming.scan_progress(spark, paths["progress"], 4).orderBy("batch_id").collect()
    assert [r.files for r in told] == [1, 1, 1, 0, 1] or [r.files for r in told] == [1, 1, 1, 1, 0]
    assert told[-1].files_so_far == 4 and told[-1].percent == 100.0 and told[-1].findings_so_far == agreed_now.count()


def test_stream_of_files_of_any_size(spark, tmp_path):
    root = make(tmp_path / "repos", {"r/big.py": "eval(x)\n" * 200_000, "r/a.py": "eval(x)"})
    for limit, want in ((1_000_000, {"r/a.py"}), (None, {"r/a.py", "r/big.py"})):
        out = str(tmp_path / f"out{limit}")
        stream = streaming.file_stream(spark, root, max_bytes=limit)
        streaming.scan_stream(stream, out, str(tmp_path / f"p{limit}")).awaitTermination()
        assert {r.path for r in spark.read.parquet(out).select("path").distinct().collect()} == want


def test_prune_by_table_size(spark, files):
    corpus = files(("r/a.py", "x"), ("r/vendor/b.py", "x"), ("r/c.txt", "x")).withColumn("length", F.lit(1_000_000))
    assert [r.path for r in prune(corpus).collect()] == ["r/a.py"]
    assert prune(corpus.withColumn("length", F.lit(1_000_001))).count() == 0


@pytest.mark.parametrize("root", ["code", "my repos/a%20b+c", "build/x", "up/../down"])
def test_paths_below_any_root(spark, tmp_path, root):
    """A root that repeats below itself, blanks and signs, a pruned name above the root, dots."""
    name = root.rsplit("/", 1)[-1]
    wanted = {f"app/{name}/main.py", "app/a b%41+.sql"}
    (tmp_path / "up").mkdir()
    for path in wanted:
        target = tmp_path / root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("x = 1\n")
    found = {r.path for r in repository_corpus(spark, f"{tmp_path}/{root}").collect()}
    assert found == wanted
    assert {r.path for r in repository_corpus(spark, f"file://{tmp_path}/{root}/").collect()} == wanted


def test_skipped_files_and_size_limit(spark):
    rows = [("r", "r/a.py", 5, "x"), ("r", "r/big.py", 2_000_000, "x"), ("r", "r/a.bin", 5, "x"), ("r", "r/build/a.py", 5, "x"), (".h", ".h/a.py", 5, "x")]
    corpus = spark.createDataFrame(rows, "repo string, path string, length long, content string")
    assert {(r.path, r.reason) for r in skipped_files(corpus).collect()} == {
        ("r/big.py", "size"), ("r/a.bin", "extension"), ("r/build/a.py", "directory"), (".h/a.py", "hidden repository")}
    assert {r.path for r in prune(corpus).collect()} == {"r/a.py"}
    assert {r.path for r in prune(corpus, None).collect()} == {"r/a.py", "r/big.py"}
