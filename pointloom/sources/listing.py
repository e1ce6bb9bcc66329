"""The keys of a store as a data source: folders are listed in tasks, and filters on the key reach the listing.

The planner follows a pushed prefix to the folder it names, and on while there is a single folder in it, and keeps the names of that folder's
folders only; each becomes a task's, and the folder's own files another's, or, by a hash of their names, several tasks' where there are over
``SHARE``, of which each looks at all names of the folder, so they are ``SHARES`` at most. A task walks down, one folder at a time, and passes over those whose keys the filters
rule out. Names on a local or mounted disk are taken one by one, so a folder of millions is held nowhere. Keys are paths below ``path``.

    spark.dataSource.register(ObjectKeys)
    spark.read.format("object_keys").load(root).where("key like 'user-3/%'")     # key, modified, length

Filters reach the source where ``spark.sql.python.filterPushdown.enabled`` is set, as ``object_keys`` does; else Spark applies them.

Defined cases: a missing path has no keys; hidden files and folders (``.``, and ``_`` in names without ``=``, as in Spark's own listings) are listed only with the option
``hidden``; files that go meanwhile are left out; comparisons of keys are by code point.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

BATCH = 10_000
#: Files of one folder that one task looks at.
SHARE = 50_000
#: Tasks that the files of one folder are dealt to, at most.
SHARES = 16
_LAST = chr(0x10FFFF)


def stored(uri: str) -> tuple[fs.FileSystem, str]:
    """The store that a path is in, and its place there."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, os.DirEntry | fs.FileInfo]]:
    """Name, whether it is a folder, and what tells time and length, of what is directly in a folder; nothing of a missing one."""
    if isinstance(store, fs.LocalFileSystem):
        try:
            with os.scandir(folder) as found:
                yield from ((x.name, x.is_dir(), x) for x in found)
        except FileNotFoundError:
            return
    else:
        yield from ((x.base_name, x.type == fs.FileType.Directory, x) for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)))


def _said(x: os.DirEntry | fs.FileInfo) -> tuple[int | None, int | None] | None:
    """Time (microseconds) and length; None if the file is gone."""
    if isinstance(x, fs.FileInfo):
        return x.mtime_ns and x.mtime_ns // 1000, x.size
    try:
        own = x.stat()
    except FileNotFoundError:
        return None
    return own.st_mtime_ns // 1000, own.st_size


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


class Keys:
    """What filters allow: a prefix, and keys from ``low`` up to ``high``, ends as given."""

    def __init__(self) -> None:
        self.prefixes: list[str] = []
        self.low: list[tuple[str, bool]] = []
        self.high: list[tuple[str, bool]] = []

    def take(self, f: Filter) -> bool:
        """Takes a filter in; False if it is none on the key."""
        if getattr(f, "attribute", None) != ("key",) or not isinstance(getattr(f, "value", None), str):
            return False
        if isinstance(f, StringStartsWith):
            self.prefixes.append(f.value)
        elif isinstance(f, EqualTo):
            self.low.append((f.value, True))
            self.high.append((f.value, True))
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low.append((f.value, isinstance(f, GreaterThanOrEqual)))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.high.append((f.value, isinstance(f, LessThanOrEqual)))
        else:
            return False
        return True

    def allow(self, key: str) -> bool:
        return all(key.startswith(p) for p in self.prefixes) and all(key > v or (same and key == v) for v, same in self.low) and all(key < v or (same and key == v) for v, same in self.high)

    def may_hold(self, folder: str) -> bool:
        """Whether a key below the folder (with its slash) may be allowed."""
        return all(folder.startswith(p) or p.startswith(folder) for p in self.prefixes) and all(folder + _LAST >= v for v, _ in self.low) and all(folder <= v for v, _ in self.high)

    def folder(self) -> str:
        """The deepest folder that all allowed keys are in."""
        if any(v == w for v, same in self.low for w, too in self.high if same and too):
            return next(v for v, same in self.low if same).rpartition("/")[0]
        return max((p.rpartition("/")[0] for p in self.prefixes), key=len, default="")


class Folder(InputPartition):
    """A folder, deep or its own files only; of those the ones whose names hash to ``share`` of ``shares``."""

    def __init__(self, name: str, deep: bool, share: int = 0, shares: int = 1) -> None:
        self.name, self.deep, self.share, self.shares = name, deep, share, shares

    def has(self, key: str) -> bool:
        return self.shares == 1 or zlib.crc32(key.encode("utf-8", "surrogateescape")) % self.shares == self.share


class KeysReader(DataSourceReader):
    def __init__(self, path: str, hidden: bool) -> None:
        self.path, self.hidden, self.keys = path.rstrip("/"), hidden, Keys()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        return [f for f in filters if not self.keys.take(f)]

    def _listed(self, name: str) -> Iterator[tuple[str, bool, os.DirEntry | fs.FileInfo]]:
        """Keys (folders with a slash behind) directly in a folder, as they come."""
        store, base = stored(self.path)
        for own, folder, x in _entries(store, f"{base}/{name}".rstrip("/")):
            if self.hidden or not _hidden(own):
                yield f"{name}/{own}".lstrip("/") + "/" * folder, folder, x

    def partitions(self) -> list[Folder]:
        parts, top = [], self.keys.folder()
        while True:
            below, files = [], 0
            for key, folder, _ in self._listed(top):
                if not folder:
                    files += 1
                elif self.keys.may_hold(key):
                    below.append(key.rstrip("/"))
            shares = min(SHARES, max(1, -(-files // SHARE)))
            parts += [Folder(top, False, i, shares) for i in range(shares)]
            if len(below) != 1:
                return [*parts, *(Folder(name, True) for name in sorted(below))]
            top = below[0]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        todo, held = [partition.name], []
        while todo:
            for key, folder, x in self._listed(todo.pop()):
                if folder:
                    if partition.deep and self.keys.may_hold(key):
                        todo.append(key.rstrip("/"))
                elif partition.has(key) and self.keys.allow(key) and (said := _said(x)):
                    held.append((key, *said))
                    if len(held) == BATCH:
                        yield self._batch(held)
                        held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.timestamp("us", "UTC"), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "modified", "length"])


class ObjectKeys(DataSource):
    @classmethod
    def name(cls) -> str:
        return "object_keys"

    def schema(self) -> str:
        return "key string, modified timestamp, length long"

    def reader(self, schema) -> KeysReader:  # noqa: ANN001
        return KeysReader(self.options["path"], str(self.options.get("hidden", "false")).lower() == "true")


def object_keys(spark: SparkSession, path: str) -> DataFrame:
    """key, modified, length of every file below ``path``; filters on the key reach the listing."""
    spark.dataSource.register(ObjectKeys)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("object_keys").load(path)
