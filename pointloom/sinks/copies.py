"""Stored objects written again, byte for byte."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.text import result_file
from pointloom.sources.objects import images


def result_copies(spark: SparkSession, path: str, project_name: str) -> DataFrame:
    """file (the name offered), content and sha256 of every NPY file under ``path``; contents are not decoded."""
    found = images(spark, path, "*.npy").select(F.col("key").alias("path"), "content")
    return found.select("path", result_file(F.lit(project_name), "npy").alias("file"), "content", F.sha2("content", 256).alias("sha256"))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each row's ``content`` as the file ``folder``/``file``; returns file, length, sha256 of what was written.

    Runs when the result is read. A task that runs again writes the same files again; a half-written file is never left under its name.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        made: set[str] = set()
        for b in batches:
            names, sizes, sums = [], [], []
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw, path = content.as_buffer(), f"{base}/{name}"
                above = path.rpartition("/")[0]
                if above not in made:
                    store.create_dir(above, recursive=True)
                    made.add(above)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(raw)
                store.move(part, path)
                names, sizes, sums = [*names, name], [*sizes, raw.size], [*sums, hashlib.sha256(raw).hexdigest()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], ["file", "length", "sha256"])

    return files.select("file", "content").mapInArrow(put, "file string, length long, sha256 string")


def write_images(uploads: DataFrame, path: str) -> None:
    """Uploaded images (project_id, name, content, mime) as a Parquet table by project."""
    uploads.select("project_id", "name", "content", "mime").write.mode("append").partitionBy("project_id").parquet(path)
