"""Size checks and shared folders."""

from __future__ import annotations

import pytest

from lintlake import session


class FakeSession:
    """As much of a session as a shared folder needs."""

    def __init__(self, master, folder=None):
        self.values = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = self

    def get(self, name, default=None):
        return self.values.get(name, default)

    def set(self, name, value):
        self.values[name] = value


def test_shared_dir_follows_the_cluster():
    assert session.shared_dir(FakeSession("yarn", "hdfs:///ck/"), "x").startswith("hdfs:///ck/lintlake/x-")
    with pytest.raises(RuntimeError):
        session.shared_dir(FakeSession("yarn"), "x")
    local = FakeSession("local[2]")
    first, second = session.shared_dir(local, "x"), session.shared_dir(local, "x")
    assert first != second and first.rsplit("/", 2)[0] == second.rsplit("/", 2)[0]


def test_materialized_tables_come_back_whole(spark):
    frame = spark.range(1000).selectExpr("id", "array(id) as list")
    back = session.materialize(frame, "numbers")
    assert back.schema.simpleString() == frame.schema.simpleString()
    assert back.count() == 1000 and back.where("id = list[0]").count() == 1000


def test_small_inputs_are_spread_and_sizes_checked(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert session.fits_broadcast(table) and not session.fits_broadcast(table, 10)
    plan = session.spread(table)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan
    huge = spark.range(10**12)
    assert "RoundRobin" not in session.spread(huge)._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_a_spread_input_are_bounded_in_bytes(spark):
    for rows in (10**7, 10**8, 10**9):
        plan = session.spread(spark.range(rows))._jdf.queryExecution().executedPlan().toString()
        parts = int(plan.split("RoundRobinPartitioning(")[1].split(")")[0])
        assert rows * 8 / parts <= session.SPREAD_BYTES_PER_TASK
