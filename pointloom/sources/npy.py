"""NPY arrays as a Spark data source: rows (path, idx, x, y, z, r, g, b), read by ranges of points.

The planner reads headers only; each task then seeks to its own range of an array and
yields Arrow batches, so an array of any size is spread over the cluster and never held
whole. Values are taken in the file's own order, whatever shape and order it states; a last
group of under six values ends with NaN. An empty array has no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy_format
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

PARTS = ("x", "y", "z", "r", "g", "b")
STRIDE = len(PARTS)
SPLIT_POINTS, BATCH_POINTS = 1_000_000, 50_000


def header(file: BinaryIO) -> tuple[int, np.dtype, int]:
    """Where the data begins, the type and the number of values. Arrays of objects are refused."""
    version = npy_format.read_magic(file)
    read = {(1, 0): npy_format.read_array_header_1_0, (2, 0): npy_format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"NPY version {version} is not known")
    shape, _, dtype = read(file)
    if dtype.kind not in "fiub":
        raise ValueError(f"NPY type {dtype} has no numbers")
    return file.tell(), dtype, int(np.prod(shape, dtype=np.int64))


def _stored(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class PointRange(InputPartition):
    def __init__(self, path: str, offset: int, dtype: str, start: int, values: int) -> None:
        self.path, self.offset, self.dtype, self.start, self.values = path, offset, dtype, start, values


class NpyReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split
        self.low, self.high, self.only = 0, 1 << 62, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes ranges of idx and a path in; ranges are left to Spark as well, as a range may hold more than is asked for."""
        for f in filters:
            if getattr(f, "attribute", None) == ("idx",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            elif isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = f.value
            yield f

    def _files(self) -> Iterator[str]:
        store, path = _stored(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            yield self.path
            return
        base = self.path.rstrip("/")
        for x in sorted(store.get_file_info(fs.FileSelector(path, recursive=True)), key=lambda x: x.path):
            if x.type == fs.FileType.File and x.path.endswith(".npy"):
                yield base + x.path[len(path.rstrip("/")) :]

    def partitions(self) -> list[PointRange]:
        out = []
        for path in self._files() if self.low < self.high else ():
            if self.only not in (None, path):
                continue
            store, inner = _stored(path)
            with store.open_input_file(inner) as f:
                offset, dtype, values = header(f)
            points = -(-values // STRIDE)
            last = min(points, self.high)
            for start in range(self.low, last, self.split):
                here = min(values, min(start + self.split, last) * STRIDE) - start * STRIDE
                out.append(PointRange(path, offset + start * STRIDE * dtype.itemsize, dtype.str, start, here))
        return out

    def read(self, partition: PointRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark passes where there are no ranges
            return
        dtype = np.dtype(partition.dtype)
        store, inner = _stored(partition.path)
        with store.open_input_file(inner) as f:
            f.seek(partition.offset)
            for at in range(0, partition.values, BATCH_POINTS * STRIDE):
                n = min(BATCH_POINTS * STRIDE, partition.values - at)
                flat = np.full(-(-n // STRIDE) * STRIDE, np.nan)
                flat[:n] = np.frombuffer(f.read(n * dtype.itemsize), dtype)
                points = flat.reshape(-1, STRIDE)
                idx = np.arange(len(points), dtype=np.int64) + partition.start + at // STRIDE
                columns = [pa.array([partition.path] * len(points), pa.string()), pa.array(idx), *(pa.array(points[:, i]) for i in range(STRIDE))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "idx", *PARTS])


class NpyPoints(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_points"

    def schema(self) -> str:
        return "path string, idx long, " + ", ".join(f"{c} double" for c in PARTS)

    def reader(self, schema) -> NpyReader:  # noqa: ANN001
        return NpyReader(self.options["path"], int(self.options.get("points", SPLIT_POINTS)))


def read_points(spark: SparkSession, path: str, split: int = SPLIT_POINTS) -> DataFrame:
    """cloud_id (the file), idx and parts of each point in an NPY file, or in all of a folder; conditions on cloud_id and idx reach the files."""
    spark.dataSource.register(NpyPoints)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("npy_points").option("points", split).load(path).withColumnRenamed("path", "cloud_id")
