"""Reconstruction settings: eight numbers that may arrive as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.text import json_text, number

#: The fields, in order, and the value of each on a fresh form.
FIELDS = ("depthMin", "depthMax", "fx", "fy", "cx", "cy", "eps", "minPts")
UNSET = -1.0
_SAMPLE = "map<string,struct<depthMin:double,depthMax:double,fx:double,fy:double,cx:double,cy:double>>"


def parse(text: Column) -> Column:
    """struct of the eight fields as text, whether the JSON has numbers or strings."""
    return F.from_json(text, ", ".join(f"{f} string" for f in FIELDS))


def coerced(settings: Column) -> Column:
    """struct of doubles from a struct of text fields; text that is no number is null."""
    return F.struct(*(number(settings[f]).alias(f) for f in FIELDS))


def unset() -> Column:
    return F.struct(*(F.lit(UNSET).alias(f) for f in FIELDS))


def with_field(settings: Column, field: str, value: Column) -> Column:
    """``settings`` with one field replaced; an edited value stays text until it is coerced."""
    if field not in FIELDS:
        raise ValueError(f"no such field: {field}")
    return settings.withField(field, value)


def saved(settings: Column) -> Column:
    return json_text(settings)


def sample_settings(spark: SparkSession, path: str) -> DataFrame:
    """name and settings of each sample in JSON files like {"box": {"fx": 1000}}."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", _SAMPLE)).alias("name", "settings"))
