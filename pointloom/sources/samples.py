"""Sample sets: an inline relation, and the series of image names that each describes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = "name string, prefix string, count int, suffix string"


def sample_sets(spark: SparkSession, rows: list[tuple[str, str, int, str]]) -> DataFrame:
    return spark.createDataFrame(rows, SAMPLE)


def image_series(samples: DataFrame) -> DataFrame:
    """name, label (from 1) and file prefix+label+suffix of every image; counts under 1 give none."""
    own = F.explode(F.when(F.col("count") >= 1, F.sequence(F.lit(1), F.col("count")))).alias("label")
    return samples.select("name", "prefix", "suffix", own).select("name", "label", F.concat("prefix", F.col("label").cast("string"), "suffix").alias("file"))
