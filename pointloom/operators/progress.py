"""Progress messages of a reconstruction, folded in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Messages that are no progress.
READY, CLOSE = "READY", "CLOSE"


def fold(messages: DataFrame, key: str = "pid", order: str = "seq", data: str = "data") -> DataFrame:
    """State of each key after its messages: progress (last before the close, else null), connected, closed, incomplete.

    Messages behind the first CLOSE count for nothing. Two aggregates with partial
    aggregation: the first close of each key, then what came before it.
    """
    closes = messages.where(F.col(data) == CLOSE).groupBy(F.col(key).alias("of")).agg(F.min(order).alias("closed_at"))
    joined = messages.join(closes, F.col(key) == F.col("of"), "left")
    live = F.col("closed_at").isNull() | (F.col(order) < F.col("closed_at"))
    said = live & ~F.col(data).isin(READY, CLOSE)
    state = joined.groupBy(key).agg(
        F.max(F.when(said, F.struct(F.col(order), F.col(data).alias("said")))).getField("said").alias("progress"),
        F.coalesce(F.max(live & (F.col(data) == READY)), F.lit(False)).alias("connected"),
        F.max("closed_at").isNotNull().alias("closed"),
    )
    return state.withColumn("incomplete", F.col("closed") & ~F.coalesce(F.col("progress").try_cast("double") == 100, F.lit(False)))
