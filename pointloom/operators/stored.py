"""A stored table of projects whose updates rewrite only what they touch.

The table lies in ``buckets`` folders by a hash of its key (user_id, projectId). Updates are appended to a log, a Parquet batch at a time; a
reader sees the table with the log folded in, by partial aggregation, so an update costs what it says and not the
table. ``compact`` rewrites the buckets that the log names, and no others, and drops the batches it read. It may
run again after a failure: an update says what a column becomes, so the second time changes nothing. One compaction runs at a time.

Deleted projects stay in their bucket as rows marked so, until ``purge`` writes the table anew to another folder.

Defined cases: updates are (user_id, projectId, action, value, seq) as in ``projects.updated``; of one project's updates those of
greater seq count last, whatever batch they came in, and after a delete none counts; updates of unknown projects, unknown actions and
blank names change nothing; null ids are keys like others; a compaction without updates changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.text import is_blank

KEY = ["user_id", "projectId"]
BUCKETS = 256
_LOG = "user_id {user}, projectId {project}, action string, value string, seq long"


class ProjectStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        """``buckets`` must be the number that the table was made with."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def create(self, projects: DataFrame) -> None:
        """Writes the table and an empty log."""
        marked = projects.withColumns({"deleted": F.lit(False), "bucket": self._bucket()})
        marked.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/table")
        kinds = dict(projects.dtypes)
        self.spark.createDataFrame([], _LOG.format(user=kinds["user_id"], project=kinds["projectId"])).withColumn("batch", F.lit("none")).write.parquet(f"{self.path}/log/none")

    def append(self, updates: DataFrame) -> None:
        """Adds a batch of updates to the log; nothing of the table is read or written."""
        batch = uuid.uuid4().hex
        updates.select(*KEY, "action", "value", F.col("seq").cast("long").alias("seq"), F.lit(batch).alias("batch")).write.parquet(f"{self.path}/log/{batch}")

    def _table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/table")

    def _log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/log/*")

    @staticmethod
    def folded(log: DataFrame) -> DataFrame:
        """What becomes of each project that a log names: one row for each, by partial aggregation."""
        cut = log.where("action = 'delete'").groupBy(F.struct(*KEY).alias("gone_key")).agg(F.min("seq").alias("gone_at"))
        live = log.join(cut, F.struct(*KEY) == F.col("gone_key"), "left").where("gone_at is null or seq <= gone_at")
        last = lambda value, when: F.max(F.when(when, F.struct(F.col("seq"), value.alias("said"))))["said"]
        action, value = F.col("action"), F.col("value")
        status = F.when(action == "status", value).when(action == "restart", "processing")
        return live.groupBy(F.struct(*KEY).alias("named")).agg(
            last(value, (action == "rename") & ~is_blank(value)).alias("new_name"), last(status, action.isin("status", "restart") & status.isNotNull()).alias("new_status"),
            F.coalesce(F.max(action == "restart"), F.lit(False)).alias("again"), last(value, (action == "config") & value.isNotNull()).alias("new_config"),
            F.coalesce(F.max(action == "delete"), F.lit(False)).alias("gone"),
        )

    def _applied(self, table: DataFrame, log: DataFrame) -> DataFrame:
        both = table.join(self.folded(log), F.struct(*KEY) == F.col("named"), "left")
        changes = {
            "projectName": F.col("new_name"), "projectStatus": F.col("new_status"), "projectProgress": F.when(F.col("again"), 0.0),
            "projectConfig": F.col("new_config"), "deleted": F.when(F.col("gone"), True),
        }
        return both.select(*(F.coalesce(changes[c], F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns))

    def read(self) -> DataFrame:
        """The projects as the table and its log say."""
        return self._applied(self._table(), self._log()).where("not deleted").drop("deleted", "bucket")

    def compact(self) -> list[int]:
        """Folds the log into the buckets that it touches and returns these; at most ``buckets`` numbers come to the driver."""
        log = self._log()
        batches = [r.batch for r in log.select("batch").distinct().collect()]
        touched = sorted(r.bucket for r in log.select(self._bucket().alias("bucket")).distinct().collect())
        if touched:
            own = log.where(F.col("batch").isin(batches))
            old = self._table().where(F.col("bucket").isin(touched))
            fresh = self._applied(old, own).repartition("bucket")
            fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/table")
            self._drop(batches)
        return touched

    def _drop(self, batches: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm  # the only way to Hadoop's file systems from Python
        for batch in batches:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{batch}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def purge(self, path: str) -> ProjectStore:
        """The same projects as a table of their own elsewhere, without the deleted ones and with an empty log."""
        other = ProjectStore(self.spark, path, self.buckets)
        other.create(self.read())
        return other
