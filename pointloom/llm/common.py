"""Small helpers that the text operators share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.shared import shared_dir

#: A word is a longest run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows and bytes in an Arrow batch: whole texts are passed to Python, so batches stay short.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint; for narrow rows that are read again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; for wide rows that are read again."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts holds, in rows and bytes; the session's own lower bounds stay."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = int(str(spark.conf.get(f"spark.sql.execution.arrow.{name}")).rstrip("b") or 0)
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of whole rows with at most ``most`` bytes in column ``text``, or one row; nothing is copied."""
    for b in batches:
        held = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = held[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(held, before + most, "right")))
            yield b.slice(at, end - at)
            at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_rows(df: DataFrame) -> DataFrame:
    """Every row as struct ``row``, so that no column's name can clash or hold what an expression can't name."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spread(c: Column, salt: str, steps: int = 1_000_000) -> Column:
    """A number in [0, steps) that depends on ``c`` and ``salt`` alone."""
    return F.pmod(F.xxhash64(F.lit(salt), c), F.lit(steps))
