"""Filters that reach the sources, and event-stream text that grows between reads."""

from __future__ import annotations

import io
import os
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pointloom.sources import eventstream, listing
from pointloom.sources.npy import NpyReader, read_points
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith


@pytest.fixture(scope="module")
def store(tmp_path_factory) -> str:
    """300 folders of 340 keys, some deeper, some hidden."""
    base = tmp_path_factory.mktemp("store")
    for i in range(300):
        own = base / f"user-{i % 10}" / f"p{i}"
        own.mkdir(parents=True)
        for k in range(340):
            os.close(os.open(own / f"{k:03}.png", os.O_CREAT))
    (base / "top.txt").write_text("abc")
    (base / "user-3" / "loose.txt").write_text("x")
    (base / "_hidden").mkdir()
    (base / "_hidden" / "no").write_text("")
    return str(base)


def keys_of(store: str) -> set[str]:
    return {str(p.relative_to(store)) for p in Path(store).rglob("*") if p.is_file() and "_hidden" not in p.parts}


def pushed(store: str, *filters) -> tuple[listing.KeysReader, set[str], set[str]]:
    """A reader after a push, the folders that its tasks list, and the keys they give."""
    reader = listing.KeysReader(store, False)
    assert list(reader.pushFilters(list(filters))) == []
    looked: set[str] = set()
    listed = reader._listed
    reader._listed = lambda name: looked.add(name) or listed(name)
    found = [k for part in reader.partitions() for b in reader.read(part) for k in b.column(0).to_pylist()]
    assert len(found) == len(set(found))
    return reader, looked, set(found)


def test_planner_sees_folders_only_and_tasks_list_the_keys(spark, store):
    reader = listing.KeysReader(store, False)
    assert sorted(p.name for p in reader.partitions()) == ["", *(f"user-{i}" for i in range(10))]
    found = listing.object_keys(spark, store)
    assert found.count() == 102_002 and {r.key for r in found.where("key not like '%/%/%'").collect()} == {"top.txt", "user-3/loose.txt"}
    assert [r.length for r in found.where("key = 'top.txt'").collect()] == [3]


@pytest.mark.parametrize("filters, most", [
    ((StringStartsWith(("key",), "user-3/p13/"),), 2), ((StringStartsWith(("key",), "user-3/p1"),), 12), ((EqualTo(("key",), "user-7/p7/005.png"),), 2), ((EqualTo(("key",), "user-7/none"),), 40),
    ((GreaterThanOrEqual(("key",), "user-8/"), LessThan(("key",), "user-8/p2")), 14), ((GreaterThan(("key",), "user-9/p99/300.png"),), 3), ((LessThanOrEqual(("key",), "top.txt"),), 1), ((StringStartsWith(("key",), "nothing"),), 1),
])
def test_filters_prune_the_folders(store, filters, most):
    _, looked, found = pushed(store, *filters)
    rule = {StringStartsWith: str.startswith, EqualTo: str.__eq__, GreaterThan: str.__gt__, GreaterThanOrEqual: str.__ge__, LessThan: str.__lt__, LessThanOrEqual: str.__le__}
    assert found == {k for k in keys_of(store) if all(rule[type(f)](k, f.value) for f in filters)}
    assert len(looked) <= most, looked


def test_filters_reach_the_listing_from_sql(spark, store, capsys):
    own = listing.object_keys(spark, store).where("key like 'user-4/p14/%' and length >= 0")
    assert own.count() == 340
    capsys.readouterr()
    own.explain("formatted")
    text = capsys.readouterr().out
    assert not re.search(r"Condition : .*StartsWith\(key", text) and "length" in text
    assert listing.object_keys(spark, store + "/none").count() == 0


def saved(folder: Path, name: str, points: int) -> np.ndarray:
    own = np.arange(points * 6, dtype="<f8")
    out = io.BytesIO()
    np.save(out, own)
    (folder / name).write_bytes(out.getvalue())
    return own.reshape(-1, 6)


def test_ranges_of_arrays_are_all_that_is_read(spark, tmp_path):
    arrays = {name: saved(tmp_path, name, n) for name, n in (("a.npy", 1000), ("b.npy", 250), ("c.npy", 3))}
    reader = NpyReader(str(tmp_path), 100)
    assert len(list(reader.pushFilters([GreaterThanOrEqual(("idx",), 240), LessThan(("idx",), 420)]))) == 2
    assert [(os.path.basename(p.path), p.start, p.values // 6) for p in reader.partitions()] == [("a.npy", 240, 100), ("a.npy", 340, 80), ("b.npy", 240, 10)]
    got = read_points(spark, str(tmp_path), 100).where("idx > 239 and idx <= 419")
    assert {(os.path.basename(r.cloud_id), r.idx): r.x for r in got.collect()} == {(n, i): own[i, 0] for n, own in arrays.items() for i in range(240, min(420, len(own)))}
    one = NpyReader(str(tmp_path), 100)
    list(one.pushFilters([EqualTo(("path",), f"{tmp_path}/b.npy"), EqualTo(("idx",), 7)]))
    assert [(p.start, p.values // 6) for p in one.partitions()] == [(7, 1)]
    assert read_points(spark, str(tmp_path)).where("idx < 0").count() == 0 and read_points(spark, str(tmp_path)).where("idx > 5 and idx < 5").count() == 0


FRAMES = ["data: one\n\n", "id: 7\nevent: say\ndata: two\ndata: lines\n\n", ": only a remark\n\n", "data\n\n", "data:no space\n\n", "id: 8\r\ndata: crlf é\r\n\r\n", "event: none\n\n", "data: " + "x" * 200_000 + "\n\n"]
SAID = [(None, None, "one"), ("7", "say", "two\nlines"), (None, None, ""), (None, None, "no space"), ("8", None, "crlf é"), (None, None, "x" * 200_000)]


@pytest.mark.parametrize("split", [1, 7, 50, 10**6])
def test_frames_of_all_splits(tmp_path, split):
    (tmp_path / "f").write_bytes("".join(FRAMES[:-1] * 5 + FRAMES[-1:] * (split > 1)).encode() + b"data: not yet")
    reader = eventstream.EventTextReader(str(tmp_path), split)
    end = reader.latestOffset()
    rows = [r[2:] for p in reader.partitions({}, end) for r in reader.read(p)]
    assert rows == SAID[:-1] * 5 + SAID[-1:] * (split > 1)
    middle = eventstream.EventTextReader(str(tmp_path), 10**6).partitions({}, end)[0]
    at = [r[1] for r in reader.read(middle)][3]
    assert [r[2:] for p in reader.partitions({"f": at}, end) for r in reader.read(p)] == rows[3:]


def test_offsets_end_behind_whole_frames(tmp_path):
    own = random.Random(3)
    whole = "".join(own.choice(FRAMES) for _ in range(60)).encode()
    ends = [m.end() for m in re.finditer(rb"\r?\n\r?\n", whole)]
    reader = eventstream.EventTextReader(str(tmp_path), 10**6)
    assert reader.latestOffset() == {}
    for n in (0, 3, 10, *(own.randrange(len(whole)) for _ in range(30)), len(whole)):
        (tmp_path / "f").write_bytes(whole[:n])
        assert reader.latestOffset().get("f", 0) == max((e for e in ends if e <= n), default=0)


def test_a_restart_inside_a_frame_neither_loses_nor_repeats_it(spark, tmp_path):
    spark.dataSource.register(eventstream.EventText)
    text, place = tmp_path / "text", str(tmp_path)
    text.mkdir()

    def go() -> list[tuple]:
        query = spark.readStream.format("event_text").load(str(text)).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/check").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r.id, r.data) for r in spark.read.parquet(f"{place}/out").collect())

    (text / "a").write_text("id: 1\ndata: first\n\nid: 2\nda")
    assert go() == [("1", "first")]
    with (text / "a").open("a") as f:
        f.write("ta: second\n\nid: 3\ndata: third\n")
    (text / "b").write_text("id: 9\ndata: other file\n\n")
    assert go() == [("1", "first"), ("2", "second"), ("9", "other file")]
    with (text / "a").open("a") as f:
        f.write("\n")
    assert go() == [("1", "first"), ("2", "second"), ("3", "third"), ("9", "other file")] == go()
