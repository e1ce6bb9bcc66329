"""Updates in place, and the best route of a path."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pointloom.functions import routes
from pointloom.operators.stored import ProjectStore

PROJECT = "user_id long, projectId string, projectName string, projectStatus string, projectProgress double, projectConfig string"
UPDATE = "user_id long, projectId string, action string, value string, seq long"


def brute(projects: list[tuple], updates: list[tuple]) -> set[tuple]:
    own = {p[:2]: list(p) for p in projects}
    for user, project, action, value, _ in sorted(updates, key=lambda u: u[4]):
        row = own.get((user, project))
        if row is None:
            continue
        if action == "rename" and value and value.strip():
            row[2] = value
        elif action == "status" and value is not None:
            row[3] = value
        elif action == "restart":
            row[3:5] = ["processing", 0.0]
        elif action == "config" and value is not None:
            row[5] = value
        elif action == "delete":
            del own[user, project]
    return {tuple(r) for r in own.values()}


def files(path) -> dict[str, set[str]]:  # noqa: ANN001
    return {d.name: {f.name for f in d.glob("*.parquet")} for d in Path(path, "table").glob("bucket=*")}


def test_updates_touch_their_buckets_only(spark, tmp_path):
    projects = [(i % 7, f"p{i}", f"name {i}", "idle", None, None) for i in range(200)] + [(None, "p", "n", "idle", 1.0, None)]
    store = ProjectStore(spark, f"{tmp_path}/store", 16)
    store.create(spark.createDataFrame(projects, PROJECT))
    before = files(store.path)
    assert len(before) == 16
    updates = [(3, "p3", "rename", "new", 1), (3, "p3", "rename", "  ", 2), (None, "p", "status", "error", 1), (9, "nobody", "rename", "x", 1)]
    store.append(spark.createDataFrame(updates[:2], UPDATE))
    store.append(spark.createDataFrame(updates[2:], UPDATE))
    assert files(store.path) == before and {tuple(r) for r in store.read().collect()} == brute(projects, updates)
    touched = {f"bucket={b}" for b in store.compact()}
    after = files(store.path)
    assert 1 <= len(touched) <= 3 and {b for b in after if after[b] != before[b]} <= touched
    assert {tuple(r) for r in store.read().collect()} == brute(projects, updates) and store.compact() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_updates_in_batches_and_compactions(spark, tmp_path, seed):
    own = random.Random(seed)
    projects = [(i % 3, f"p{i}", f"name {i}", "idle", 5.0, "{}") for i in range(20)]
    store, said = ProjectStore(spark, f"{tmp_path}/store", 4), []
    store.create(spark.createDataFrame(projects, PROJECT))
    for turn in range(3):
        batch = []
        for i in range(12):
            k = own.randrange(22)
            action = own.choice(["rename", "status", "restart", "config", "delete", "other"])
            batch.append((k % 3, f"p{k}", action, own.choice([None, "", f"v{turn}-{i}"]) if action == "rename" else f"v{turn}-{i}", 100 * turn + i))
        said += batch
        own.shuffle(batch)
        store.append(spark.createDataFrame(batch, UPDATE))
        if turn == 1:
            store.compact()
        assert {tuple(r) for r in store.read().collect()} == brute(projects, said)
    fresh = store.purge(f"{tmp_path}/other")
    assert {tuple(r) for r in fresh.read().collect()} == brute(projects, said)


def test_a_bucket_may_lose_all_its_projects(spark, tmp_path):
    store = ProjectStore(spark, f"{tmp_path}/store", 1)
    store.create(spark.createDataFrame([(1, "a", "n", "idle", None, None)], PROJECT))
    store.append(spark.createDataFrame([(1, "a", "delete", None, 1)], UPDATE))
    assert store.compact() == [0] and store.read().count() == 0


PATTERNS = [*routes.ROUTES, "/project/new", "/project/:id/:tab/deep", "/project/*", "/a/:x/c", "/a/b/*", "/a/b/d"]


@pytest.mark.parametrize(("path", "want"), [
    ("/", ("/", {})), ("", ("/", {})), ("//", ("/", {})), (None, None), ("/LOGIN/", ("/login", {})), ("/project/7", ("/project/:projectId", {"projectId": "7"})), ("/project/new", ("/project/new", {})),
    ("/project/7/Tab", ("/project/:projectId/:tab", {"projectId": "7", "tab": "Tab"})), ("/project/7/x/deep", ("/project/:id/:tab/deep", {"id": "7", "tab": "x"})), ("/project/7/x/other", ("/project/*", {"*": "7/x/other"})),
    ("/project", ("/project/*", {"*": ""})), ("/a/b/c", ("/a/b/*", {"*": "c"})), ("/a/b/d", ("/a/b/d", {})), ("/a/z/c", ("/a/:x/c", {"x": "z"})), ("/a/z/d", ("*", {"*": "a/z/d"})), ("/nowhere/at/all", ("*", {"*": "nowhere/at/all"})),
])
def test_best_route(spark, path, want):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(path,)], "path string").select(routes.best_route(F.col("path"), PATTERNS).alias("r")).first().r
    assert (r and (r.pattern, r.params)) == want


def test_no_route_and_bad_patterns(spark):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([("/x",)], "path string").select(routes.best_route(F.col("path"), ["/y"]).alias("r")).first().r is None
    with pytest.raises(ValueError, match="must end"):
        routes.trie(["/a/*/b"])
