"""Where one record format keeps its sessions: ``projects/<flattened cwd>/<session id>.jsonl``."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoolsift.sources.files import list_files, without_rows
from spoolsift.sources.lines import any_path, read_lines

_MAIN = r"projects/([^/]+)/([^/]+)\.jsonl$"
_SUBAGENT = r"projects/([^/]+)/([^/]+)/subagents/[^/]+\.jsonl$"


def flatten_cwd(cwd: str) -> str:
    """Project directory of a working directory; several may share one."""
    return re.sub(r"[^a-zA-Z0-9]", "-", cwd)


def flatten_cwd_column(cwd: Column) -> Column:
    """The same for a column."""
    return F.regexp_replace(cwd, "[^a-zA-Z0-9]", "-")


def read_sessions(spark: SparkSession, root: str, cwd: str | None = None) -> DataFrame:
    """Numbered lines of the main session files of one project or of all."""
    project = "*" if cwd is None else flatten_cwd(cwd)
    return _named(read_lines(spark, f"{root}/projects/{project}/*.jsonl"), _MAIN)


def read_session_files(spark: SparkSession, root: str, cwd: str | None = None, exact: bool = False) -> DataFrame:
    """Numbered lines of all files of the sessions: main files and, below them, subagent files."""
    project = "*" if cwd is None else flatten_cwd(cwd)
    base = f"{root}/projects/{project}"
    main = _named(read_lines(spark, f"{base}/*.jsonl", exact=exact), _MAIN).withColumn("is_main", F.lit(True))
    if not any_path(spark, f"{base}/*/subagents/*.jsonl"):
        return main
    below = _named(read_lines(spark, f"{base}/*/subagents/*.jsonl", exact=exact), _SUBAGENT)
    return main.unionByName(below.withColumn("is_main", F.lit(False)))


def session_files(lines: DataFrame) -> DataFrame:
    """One row per file with its place in its session: main file first, then the others by path."""
    files = lines.groupBy("project", "session_id", "path").agg(F.max("is_main").alias("is_main"))
    order = Window.partitionBy("project", "session_id").orderBy(F.desc("is_main"), "path")
    return files.withColumn("place", F.row_number().over(order))


def main_files(spark: SparkSession, root: str, cwd: str | None = None) -> DataFrame:
    """The main files themselves, those without bytes too: provider, project, session_id, path, size_bytes, modified."""
    files = list_files(spark, f"{root}/projects/{'*' if cwd is None else flatten_cwd(cwd)}")
    return files.select(
        F.lit("claude").alias("provider"),
        F.regexp_extract("path", _MAIN, 1).alias("project"),
        F.regexp_extract("path", _MAIN, 2).alias("session_id"),
        *("path", "size_bytes", "modified"),
    )


def with_empty_files(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Also a session for each file that holds no line: its texts are empty, its counts zero."""
    blank = {"string": F.lit(""), "bigint": F.lit(0).cast("bigint"), "int": F.lit(0)}
    known = ("provider", "project", "session_id", "path", "size_bytes")
    lacking = without_rows(files, sessions)
    rows = [F.col(f.name) if f.name in known else blank[f.dataType.simpleString()].alias(f.name) for f in sessions.schema]
    return sessions.unionByName(lacking.select(*rows))


def _named(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.select(
        F.lit("claude").alias("provider"),
        F.regexp_extract("path", pattern, 1).alias("project"),
        F.regexp_extract("path", pattern, 2).alias("session_id"),
        "path",
        "seq",
        "line",
        "size_bytes",
    )

