"""Columns of names, numbers, dates and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that a browser's trim removes, at either end.
_ENDS = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"
#: A decimal number as a browser reads it; no suffixes as the JVM allows.
_NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|Infinity)$"
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png")


def trimmed(c: Column) -> Column:
    """Without white space at the ends: also no-break spaces, tabs and byte order marks."""
    return F.regexp_replace(c, _ENDS, "")


def is_blank(c: Column) -> Column:
    return F.coalesce(trimmed(c) == "", F.lit(True))


def basename(key: Column) -> Column:
    """Behind the last slash; empty where the key ends with one."""
    return F.substring_index(key, "/", -1)


def extension(name: Column) -> Column:
    """Behind the last dot, in lower case; a name without a dot is its own extension."""
    return F.lower(F.substring_index(name, ".", -1))


def raw_extension(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def stem(name: Column) -> Column:
    """Before the last dot; empty without one."""
    return F.when(F.instr(name, ".") > 0, F.left(name, F.length(name) - F.length(raw_extension(name)) - 1)).otherwise("")


def is_image(name: Column) -> Column:
    return extension(name).isin(*IMAGE_EXTENSIONS)


def capitalised(c: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def safe_name(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def result_file(name: Column, kind: str) -> Column:
    """File that a project's result is offered as; kind is npy or gltf."""
    return F.concat(safe_name(name), F.lit(f"_result.{kind}"))


def number(c: Column) -> Column:
    """A form field's number: blank is 0, other text that is no number is null."""
    text = trimmed(c)
    return F.when(text == "", 0.0).when(text.rlike(_NUMBER), text.try_cast("double"))


def json_text(c: Column) -> Column:
    """JSON of a struct with nulls written out."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def local_date(ts: Column) -> Column:
    """Date and time as shown in lists (en-US, the session's time zone)."""
    return F.coalesce(F.date_format(ts, "M/d/yyyy h:mm:ss a"), F.lit("Invalid Date Invalid Date"))


def percent(c: Column) -> Column:
    return F.concat(c.cast("string"), F.lit("%"))


def route_params(path: Column) -> Column:
    """struct(project_id, tab) of a path like /project/7/overview; null for other paths, tab null without one."""
    fit = r"^/project/([^/]+)(?:/([^/]+))?/?$"
    part = lambda i: F.nullif(F.regexp_extract(path, fit, i), F.lit(""))
    return F.when(path.rlike(fit), F.struct(part(1).alias("project_id"), part(2).alias("tab")))


def cloud_key(user: Column, project: Column) -> Column:
    """Key of a project's point cloud in the store."""
    return F.concat(F.lit("user-"), user.cast("string"), F.lit("/"), project.cast("string"), F.lit("/output/accumulated_numpy.npy"))


def image_prefix(user: Column, project: Column) -> Column:
    return F.concat(F.lit("user-"), user.cast("string"), F.lit("/"), project.cast("string"), F.lit("/rgb"))


def progress_url(base: str, user: Column, project: Column) -> Column:
    """Where a project's progress messages come from."""
    return F.concat(F.lit(f"{base.rstrip('/')}/process_image/"), user.cast("string"), F.lit("/"), project.cast("string"))


def detail_url(base: str, user: Column, project: Column, detail: str = "full") -> Column:
    return F.concat(F.lit(f"{base.rstrip('/')}/getProjectDetails/"), user.cast("string"), F.lit("/"), project.cast("string"), F.lit(f"?detail={detail}"))


def has_fields(json: Column) -> Column:
    """Whether JSON text is an object with a field; false for null, other JSON and no JSON."""
    return F.coalesce(F.size(F.json_object_keys(json)) > 0, F.lit(False))


def default_tab(tab: Column) -> Column:
    return F.coalesce(F.nullif(tab, F.lit("")), F.lit("overview"))
