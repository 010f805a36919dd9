"""Attempts over a stream: ends, replays, lost batches, late and older reports."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from stratalog.operators.upsert import Store
from stratalog.streaming import states

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before, parts = spark.conf.get(name), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.shuffle.partitions", parts)


def report(commit, attempt, kind, minute, name=None, failure=None):
    return ("S", commit, attempt, kind, name, failure, at(minute))


def test_attempts(spark, tmp_path, rocks):
    files = [
        [report("a", 1, "begin", 0), report("a", 1, "class", 1, "A"), report("a", 1, "class", 1, "B", "canonical_no_output"), report("b", 1, "begin", 0), report("b", 1, "class", 1, "X")],
        # a comes again and ends; b's further reports are lost with their batch
        [report("a", 1, "class", 1, "A"), report("a", 1, "class", 2, "C"), report("a", 1, "end", 3), report("c", 1, "begin", 3), report("c", 1, "class", 3, None, "checkout_failed"), report("c", 1, "end", 4)],
        [report("z", 1, "begin", 60), report("z", 1, "end", 60)],  # time goes on
        [report("z", 1, "class", 61, "after its end")],  # and b is given up
        [report("b", 1, "class", 59, "Y"), report("b", 1, "end", 59), report("b", 2, "begin", 61), report("b", 2, "class", 61, "X", "odd type"), report("a", 1, "class", 61, "D")],  # the lost batch comes after all
        [report("b", 2, "class", 62, "Y"), report("b", 2, "end", 63), report("y", 1, "class", 1, "late")],  # y's report is too late
        [report("z", 2, "begin", 200)],
    ]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, states.REPORTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    paths = str(tmp_path / "in" / "*")
    stream = spark.readStream.schema(states.REPORTS).option("maxFilesPerTrigger", 1).parquet(paths)
    told = states.commit_states(stream, patience=600, late="5 minutes")
    seen = told.writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "seen")).trigger(availableNow=True).start()
    seen.awaitTermination()
    rows = sorted((r["commit_hash"], r["attempt"], r["status"], r["processed_classes_count"], r["saved_models_count"], r["failure_count"], r["failure_types"]) for r in spark.table("told").collect())
    assert rows == [
        ("a", 1, "complete", 3, 2, 1, "canonical_no_output"),
        ("b", 1, "reopened", 1, 1, 0, ""),
        ("b", 2, "complete", 2, 1, 1, "unknown_failure"),
        ("c", 1, "complete", 0, 0, 1, "checkout_failed"),
        ("z", 1, "complete", 0, 0, 0, ""),
    ]


def test_states_in_the_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), parts=1)
    rows = [("S", "a", "complete", 1, 3, 2, 1, "", at(3)), ("S", "b", "reopened", 1, 1, 1, 0, "", at(11)), ("S", "b", "complete", 2, 2, 1, 1, "", at(63)), ("S", "c", "reopened", 1, 1, 1, 0, "", at(5))]
    for _ in range(2):
        states.write_states(spark.createDataFrame(rows, states.STATES), store)
    held = {r["commit_hash"]: (r["status"], r["saved_models_count"], r["failure_count"]) for r in store.read("outcome_progress").collect()}
    assert held == {"a": ("complete", 2, 1), "b": ("complete", 1, 1), "c": ("processing", 1, 0)}
