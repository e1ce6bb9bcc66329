"""Streams whose state ends, and streams that break and go on."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import partial

import pytest
from pointloom.streaming import recovery, timed
from pyspark.sql import functions as F

SAID = "pid long, ts timestamp, seq long, data string"


def said(pid: int, minute: int, data: str) -> tuple:
    at = datetime(2024, 1, 1) + timedelta(minutes=minute)
    return pid, at, int((at - datetime(1970, 1, 1)).total_seconds()) * 1_000_000, data


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, timed.ROCKS)
    yield
    spark.conf.set(name, before)


def run(spark, place: str, kept: timedelta, idle: timedelta | None, batches: list[list[tuple]]) -> dict:
    """State by process after one micro-batch for each list, with a restart between them; the last row of each counts."""
    last: dict = {}
    spark.createDataFrame([], SAID).write.parquet(f"{place}/in")
    source = spark.readStream.schema(SAID).parquet(f"{place}/in")
    states = timed.follow(source, kept, idle=idle)

    def keep(batch, number: int) -> None:  # noqa: ANN001
        for r in batch.collect():
            last[r.pid] = tuple(r)[1:]

    for rows in batches:
        spark.createDataFrame(rows, SAID).coalesce(1).write.mode("append").parquet(f"{place}/in")
        states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}/check").trigger(availableNow=True).start().awaitTermination()
    return last


def test_state_of_closed_processes_ends(spark, tmp_path, rocks):
    batches = [
        [said(1, 0, "READY"), said(1, 2, "100"), said(1, 1, "50"), said(1, 3, "CLOSE"), said(1, 4, "late"), said(2, 1, "READY"), said(2, 5, "10")],
        [said(2, 6, "20"), said(3, 7, "CLOSE"), said(3, 7, "5"), said(2, 30, "30")],
        [said(4, 200, "READY")],
    ]
    last = run(spark, str(tmp_path), timedelta(hours=1), None, batches)
    assert last == {1: ("100", True, True, False), 2: ("30", True, False, False), 3: (None, False, True, True), 4: (None, True, False, False)}
    held = timed.open_processes(spark, f"{tmp_path}/check").collect()
    assert sorted(r.pid for r in held) == [2, 4]  # 1 and 3 closed over an hour before minute 200


def test_a_silent_process_is_forgotten_and_begins_anew(spark, tmp_path, rocks):
    batches = [[said(1, 0, "READY"), said(1, 1, "7"), said(2, 1, "8")], [said(2, 50, "9")], [said(3, 100, "x")], [said(1, 101, "1")]]
    last = run(spark, str(tmp_path), timedelta(minutes=10), timedelta(minutes=60), batches)
    assert last[1] == ("1", False, False, False) and last[2] == ("9", False, False, False)
    assert sorted(r.pid for r in timed.open_processes(spark, f"{tmp_path}/check").collect()) == [1, 2, 3]


def test_processes_meet_in_groups(spark, tmp_path, rocks):
    """What each call of Python takes, and each key of the state holds, are many processes."""
    last = run(spark, str(tmp_path), timedelta(hours=1), None, [[said(i, i % 50, str(i)) for i in range(3000)]])
    assert last == {i: (str(i), False, False, False) for i in range(3000)}
    held = spark.read.format("statestore").option("stateVarName", "progress").load(f"{tmp_path}/check")
    assert held.count() == 3000 and held.select("key").distinct().count() <= 1024


def test_processes_of_one_group_end_at_their_own_times(spark, tmp_path, rocks, monkeypatch):
    large = 2**60 + 1
    monkeypatch.setattr(timed, "follow", partial(timed.follow, groups=1))
    batches = [
        [said(1, 50, "CLOSE"), said(2, 20, "CLOSE"), said(large, 10, "5"), said(large - 1, 10, "6"), said(None, 30, "7"), said(0, 30, "8")],
        [said(3, 85, "CLOSE"), said(large, 90, "CLOSE"), said(None, 91, "9")],
        [said(4, 112, "READY")],
        [said(2, 113, "2"), said(5, 114, "READY")],
    ]
    last = run(spark, str(tmp_path), timedelta(hours=1), None, batches)
    assert last[large] == ("5", False, True, True) and last[large - 1] == ("6", False, False, False)
    assert last[None] == ("9", False, False, False) and last[0] == ("8", False, False, False)
    assert last[2] == ("2", False, False, False)  # its state was gone
    held = {r.pid: r.closed for r in timed.open_processes(spark, f"{tmp_path}/check").collect()}
    assert held == {3: True, large: True, large - 1: False, None: False, 0: False, 4: False, 2: False, 5: False}  # 1 closed over an hour before minute 114


def stream(spark, place: str, failures: int):
    """A start function of a stream of four micro-batches whose second breaks ``failures`` times."""
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(f"{place}/in")
    left = [failures]

    def keep(batch, number: int) -> None:  # noqa: ANN001
        if number == 1 and left[0]:
            left[0] -= 1
            raise ConnectionError("gone")
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{place}/in").groupBy("id").count()
    return lambda: source.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{place}/check").trigger(availableNow=True).start()


def test_a_broken_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    found = recovery.keep_running(spark, stream(spark, str(tmp_path), 2), wait=0.05)
    assert len(found.errors) == 2 and all("gone" in e for e in found.errors) and not found.failed and not found.connected and found.batches >= 4
    own = spark.read.parquet(f"{tmp_path}/out").where("batch = 3")
    assert own.count() == 40 and own.agg(F.max("count")).first()[0] == 1


def test_a_stream_that_stays_broken_raises_its_error(spark, tmp_path):
    with pytest.raises(Exception, match="gone"):
        recovery.keep_running(spark, stream(spark, str(tmp_path), 9), tries=2, wait=0.05)


def test_an_unbroken_stream_has_no_error(spark, tmp_path):
    found = recovery.keep_running(spark, stream(spark, str(tmp_path), 0))
    assert (found.errors, found.failed, found.connected) == ([], False, False)
