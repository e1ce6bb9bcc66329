"""Projects: rows for lists and details, stages, and updates as transforms of the table.

A project table has user_id, projectId, projectName, projectDate, projectStatus,
projectProgress, projectConfig. Updates return the changed table; the caller writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.text import capitalised, cloud_key, is_blank, local_date, percent

#: Stage by status, and the columns of each detail mode.
STAGES = {"idle": 1, "config": 2, "processing": 3, "completed": 4, "error": 4}
DETAILS = {
    "status": ["projectStatus"],
    "config": ["projectConfig"],
    "full": ["projectId", "projectName", "projectDate", "projectStatus", "projectProgress", "projectConfig"],
}


def stage(status: Column, before: Column | int = 0) -> Column:
    """Stage of a status; other statuses leave the stage as it was."""
    out = before if isinstance(before, Column) else F.lit(before)
    for name, number in STAGES.items():
        out = F.when(status == name, number).otherwise(out)
    return out


def of_user(projects: DataFrame, user: object) -> DataFrame:
    return projects.where(F.col("user_id") == F.lit(user))


def list_rows(projects: DataFrame) -> DataFrame:
    return projects.select("projectId", "projectName", local_date(F.col("projectDate")).alias("date"), capitalised(F.col("projectStatus")).alias("status"))


def detail(projects: DataFrame, user: object, project: object, mode: str = "full") -> DataFrame:
    """One project's columns by mode; the filter and the columns reach the scan."""
    return of_user(projects, user).where(F.col("projectId") == F.lit(project)).select(*DETAILS[mode])


def detail_rows(projects: DataFrame) -> DataFrame:
    return projects.select("projectName", local_date(F.col("projectDate")).alias("date"), percent(F.col("projectProgress")).alias("progress"), capitalised(F.col("projectStatus")).alias("status"))


def details_of(keys: DataFrame, projects: DataFrame, mode: str = "full") -> DataFrame:
    """Details for many (user_id, projectId) at once; keys without a project have nulls."""
    own = ["user_id", "projectId"]
    return keys.join(projects.select(*dict.fromkeys([*own, *DETAILS[mode]])), own, "left")


def created(projects: DataFrame, new: DataFrame) -> DataFrame:
    """``projects`` with the new ones (user_id, projectId, projectName, projectDate) whose name is not blank."""
    named = new.where(~is_blank(F.col("projectName"))).select("user_id", "projectId", "projectName", "projectDate", F.lit("idle").alias("projectStatus"))
    return projects.unionByName(named, allowMissingColumns=True)


def _changed(projects: DataFrame, hit: Column, changes: dict[str, Column]) -> DataFrame:
    return projects.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def renamed(projects: DataFrame, hit: Column, name: str) -> DataFrame:
    """A blank name changes nothing."""
    return _changed(projects, hit & ~is_blank(F.lit(name)), {"projectName": F.lit(name)})


def deleted(projects: DataFrame, hit: Column) -> DataFrame:
    return projects.where(~F.coalesce(hit, F.lit(False)))


def with_status(projects: DataFrame, hit: Column, status: str) -> DataFrame:
    return _changed(projects, hit, {"projectStatus": F.lit(status)})


def restarted(projects: DataFrame, hit: Column) -> DataFrame:
    """Back to processing, from nothing."""
    return _changed(projects, hit, {"projectStatus": F.lit("processing"), "projectProgress": F.lit(0.0)})


def configured(projects: DataFrame, hit: Column, settings: Column) -> DataFrame:
    return _changed(projects, hit, {"projectConfig": settings})


def updated(projects: DataFrame, updates: DataFrame) -> DataFrame:
    """Many updates at once: (user_id, projectId, action, value), at most one for each project.

    Actions: rename, status and config take the value, restart and delete take none; others change nothing.
    """
    keys = [F.col(f"p.{c}").eqNullSafe(F.col(f"u.{c}")) for c in ("user_id", "projectId")]
    both = projects.alias("p").join(updates.select("user_id", "projectId", "action", "value").alias("u"), keys, "left")
    action, value = F.coalesce(F.col("u.action"), F.lit("")), F.col("u.value")
    again = action == "restart"
    changes = {
        "projectName": F.when((action == "rename") & ~is_blank(value), value),
        "projectStatus": F.when(action == "status", value).when(again, "processing"),
        "projectProgress": F.when(again, 0.0),
        "projectConfig": F.when(action == "config", value),
    }
    own = [F.coalesce(changes[c], F.col(f"p.{c}")).alias(c) if c in changes else F.col(f"p.{c}") for c in projects.columns]
    return both.where(action != "delete").select(*own)


def result_states(projects: DataFrame, objects: DataFrame) -> DataFrame:
    """user_id, projectId, state: ``ready`` where the store's listing (key) has the project's cloud, else ``error``."""
    wanted = projects.select("user_id", "projectId", cloud_key(F.col("user_id"), F.col("projectId")).alias("key"))
    known = objects.select("key").distinct().withColumn("found", F.lit(True))
    return wanted.join(known, "key", "left").select("user_id", "projectId", F.when(F.col("found"), "ready").otherwise("error").alias("state"))


def succeeded(responses: DataFrame) -> DataFrame:
    return responses.where(F.col("status") == 200)
