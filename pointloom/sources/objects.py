"""Objects of a capture store as DataFrames, listed and read in tasks.

Folders are listed as ``listing`` does, and contents are read by the tasks that the keys are dealt to, so neither the number of files
nor that of one folder meets the driver. Spark's own listing does it for single files, patterns and stores that only Spark opens; it passes over empty files, which count here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.files import named
from pointloom.sources.listing import object_keys, stored

_OBJECT = "key string, modified timestamp, length long"
#: Bytes, and files, of one batch of contents.
BYTES, FILES = 16 << 20, 1000


def _root(spark: SparkSession, path: str) -> str | None:
    """How the keys below the folder ``path`` begin; None if it is left to Spark."""
    if re.search(r"[*?\[\]{}\\]", path) or (":/" not in path and not (path.startswith("/") and spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").startswith("file:"))):
        return None
    try:
        store, base = stored(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    if store.get_file_info(base).type != fs.FileType.Directory:
        return None
    return f"file:{base}".rstrip("/") if isinstance(store, fs.LocalFileSystem) else path.rstrip("/")


def name_pattern(glob: str) -> str:
    """The regular expression of a pattern of file names: ``*``, ``?``, ``[a-z]``, ``[^a]``, ``{a,b}``, and ``\\`` before a character that means itself."""
    out, deep, held = [], 0, False
    for whole in re.findall(r"\\.|.", glob, re.DOTALL):
        if len(whole) == 2:
            out.append(re.escape(whole[1]))
        elif held:
            out.append({"!": "^" if out[-1] == "[" else "!", "[": "\\[", "&": "\\&"}.get(whole, whole))
            held = whole != "]"
        elif whole == "[":
            out.append(whole)
            held = True
        elif whole in "{}":
            out.append("(?:" if whole == "{" else ")")
            deep += 1 if whole == "{" else -1
        else:
            out.append({"*": ".*", "?": "."}.get(whole) or ("|" if whole == "," and deep else re.escape(whole)))
    return f"(?s)^(?:{''.join(out)})$"


def _found(spark: SparkSession, path: str, glob: str | None) -> DataFrame | None:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def objects(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """key, modified, length of every file under ``path``; contents are not read. A missing path has no objects."""
    root = _root(spark, path)
    if root is None:
        found = _found(spark, path, glob)
        if found is None:
            return spark.createDataFrame([], _OBJECT)
        return found.select(F.col("path").alias("key"), F.col("modificationTime").alias("modified"), "length")
    keys = object_keys(spark, path)
    keys = keys.where(F.substring_index("key", "/", -1).rlike(name_pattern(glob))) if glob else keys
    return keys.select(F.concat(F.lit(f"{root}/"), "key").alias("key"), "modified", "length")


def with_content(spark: SparkSession, keys: DataFrame, path: str) -> DataFrame:
    """``keys`` (key, length, and others) of objects under ``path`` with their content; one that can't be read fails the query."""
    root = _root(spark, path)
    if root is None:
        found = _found(spark, path, None)
        return keys.join(found.select(F.col("path").alias("key"), "content"), "key").select(*keys.columns, "content") if found is not None else keys.limit(0).withColumn("content", F.lit(b""))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = stored(path)
        base = base.rstrip("/")
        for b in batches:
            names, held, size, start = b.column("key").to_pylist(), [], 0, 0
            for i, name in enumerate(names):
                with store.open_input_file(base + name[len(root) :]) as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= BYTES or len(held) == FILES or i == len(names) - 1:
                    own = b.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(held, pa.binary())], [*own.schema.names, "content"])
                    held, size, start = [], 0, i + 1

    dealt = keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(read, keys.schema.add("content", "binary"))


def images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """key, content, name, mime of every file under ``path``; one that can't be read fails the query."""
    return named(with_content(spark, objects(spark, path, glob).select("key"), path))


def result(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(``ready``, the object) or, where there is none, (``error``, no rows); other faults are raised."""
    found = _found(spark, path, None)
    state = "error" if found is None else "ready"
    return state, spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary") if found is None else found
