"""Rows (file, content) as files, visible all at once when the job is done, or not at all.

Each task writes into a folder of its own below ``_staged-...``, which Spark's listings pass over. When all tasks are
done the folders of attempts that do not count are removed and the rest is renamed, in one step, to ``batch-...``; a job
that fails leaves nothing that a listing sees (a task that ends later than the job may leave hidden files). The driver learns one short message from each task, however many files it wrote. The store must
rename folders in one step, as HDFS and shared disks do.

    spark.dataSource.register(ObjectFiles)
    rows.write.format("object_files").mode("append").option("path", folder).save()

Defined cases: names are paths below the folder, and those that leave it (``..``, a leading ``/``) or are null fail the job; of rows of
one name in one task the last counts, in several tasks each has its file; null contents are empty files; no rows leave no
folder. Mode overwrite is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


#: Files that one task writes.
PER_TASK = 10_000


def spread(rows: DataFrame, per_task: int | None = None) -> DataFrame:
    """``rows`` dealt over tasks by their number, as small rows of millions of files may be one task's. Counts the rows."""
    return rows.repartition(max(1, -(-rows.count() // (per_task or PER_TASK))))


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int
    length: int


def _stored(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        store, base = _stored(self.path)
        return store, f"{base}/_staged-{self.job}", f"{base}/batch-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, staged, _ = self._place()
        context, files, length = TaskContext.get(), 0, 0
        own = f"{context.partitionId()}-{context.taskAttemptId()}" if context else uuid.uuid4().hex
        made: set[str] = set()
        for b in iterator:
            for name, content in zip(b.column("file").to_pylist(), b.column("content"), strict=True):
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"not a name below the folder: {name}")
                path = f"{staged}/{own}/{name}"
                folder = path.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                raw = content.as_buffer() if content.is_valid else b""
                with store.open_output_stream(path) as out:
                    out.write(raw)
                files, length = files + 1, length + len(raw)
        return Written(own, files, length)

    def commit(self, messages: list[Written | None]) -> None:
        store, staged, final = self._place()
        kept = {m.folder for m in messages if m and m.files}
        if store.get_file_info(staged).type == fs.FileType.NotFound:
            return
        for found in store.get_file_info(fs.FileSelector(staged)):
            if found.base_name not in kept:
                store.delete_dir(found.path)
        if kept:
            store.move(staged, final)
        else:
            store.delete_dir(staged)

    def abort(self, messages: list[Written | None]) -> None:
        store, staged, _ = self._place()
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)


class ObjectFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "object_files"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("object_files only adds files; use mode append")
        if not {"file", "content"} <= set(schema.names):
            raise ValueError("object_files takes the columns file and content")
        return FilesWriter(self.options["path"])


def write_objects(rows: DataFrame, folder: str) -> None:
    """Writes each row's ``content`` (binary) as the file ``folder``/batch-.../task/``file``; all become visible together."""
    rows.sparkSession.dataSource.register(ObjectFiles)
    rows.select("file", "content").write.format("object_files").mode("append").option("path", folder).save()
