"""Files that become visible together, or not at all."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pointloom.sinks.files import FilesWriter, ObjectFiles, write_objects
from pyspark.sql import functions as F


def names(folder: str) -> list[str]:
    """What Spark's listings find below a folder (nothing hidden), without the batch and the task."""
    return sorted("/".join(p.relative_to(folder).parts[2:]) for p in Path(folder).rglob("*") if p.is_file() and not any(x.startswith(("_", ".")) for x in p.relative_to(folder).parts))


def rows(spark, n: int):
    return spark.range(n).repartition(4).select(F.concat(F.lit("a/b"), (F.col("id") % 3).cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".bin")).alias("file"), F.concat(F.lit("content "), F.col("id").cast("string")).cast("binary").alias("content"))


def test_files_hold_their_contents(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    write_objects(rows(spark, 50), folder)
    assert names(f"{tmp_path}/out") == sorted(f"a/b{i % 3}/{i}.bin" for i in range(50))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", "([0-9]+)[.]bin", 1).alias("id"), F.col("content").cast("string").alias("said")).collect()
    assert {(r.id, r.said) for r in read} == {(str(i), f"content {i}") for i in range(50)}
    write_objects(rows(spark, 3), folder)  # a further job adds
    assert len(names(f"{tmp_path}/out")) == 53


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    folder = f"{tmp_path}/out"
    broken = rows(spark, 40).withColumn("content", F.when(F.col("file").endswith("/39.bin"), F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        write_objects(broken, folder)
    assert not os.path.exists(folder) or names(folder) == []


def test_attempts_that_do_not_count_are_removed(tmp_path):
    import pyarrow as pa

    writer = FilesWriter(str(tmp_path))
    batch = pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([b"1"], pa.binary())], ["file", "content"])
    first, again = writer.write(iter([batch])), writer.write(iter([batch]))
    assert first.folder != again.folder
    writer.commit([again, None])
    assert [p.parts[-2] for p in Path(tmp_path).rglob("x")] == [again.folder]
    other = FilesWriter(str(tmp_path))
    other.write(iter([batch]))
    other.abort([None])
    assert len(list(Path(tmp_path).rglob("x"))) == 1


@pytest.mark.parametrize("name", ["../up", "/top", "a/../../b", "", None])
def test_names_stay_below_the_folder(spark, tmp_path, name):
    with pytest.raises(Exception, match="not a name below"):
        write_objects(spark.createDataFrame([(name, b"x")], "file string, content binary"), f"{tmp_path}/out")


def test_odd_rows(spark, tmp_path):
    write_objects(spark.createDataFrame([("empty", None), ("big", b"x" * 3_000_000), ("ü ß", b"")], "file string, content binary"), f"{tmp_path}/out")
    assert names(f"{tmp_path}/out") == ["big", "empty", "ü ß"]
    write_objects(spark.createDataFrame([], "file string, content binary"), f"{tmp_path}/none")
    assert not names(f"{tmp_path}/none") if os.path.exists(f"{tmp_path}/none") else True
    spark.dataSource.register(ObjectFiles)
    with pytest.raises(Exception, match="append"):
        rows(spark, 1).write.format("object_files").mode("overwrite").option("path", f"{tmp_path}/out").save()
