"""Where the other record format keeps its sessions: ``rollout-*.jsonl`` at any depth, described by line one."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolsift.functions.values import first_truthy, get, text_at
from spoolsift.model import slab_of
from spoolsift.operators.slabs import attach
from spoolsift.sources.lines import any_path, read_lines, readable
from spoolsift.sources.store import small


def read_sessions(spark: SparkSession, root: str, cwd: str | None = None) -> DataFrame:
    """Numbered lines of the rollouts recorded for a working directory, or of all rollouts."""
    lines = read_lines(
        spark, f"{root}/sessions", recursiveFileLookup="true", pathGlobFilter="rollout-*.jsonl"
    )
    return in_scope(lines, cwd)


def in_scope(lines: DataFrame, cwd: str | None = None) -> DataFrame:
    """Lines of files whose first line is a session description with the wanted directory."""
    heads = session_heads(lines.where("seq = 1"))
    if cwd is not None:
        heads = heads.where(F.col("cwd") == cwd)
    named = heads.select("path", "session_id", F.col("cwd").alias("project"))
    named, fits = small(named, "heads")
    rest = lines.drop("provider", "project", "session_id")
    kept_lines = rest.join(named, "path") if fits else attach(rest, named, "path", slab_of("seq"))
    return kept_lines.select(
        F.lit("codex").alias("provider"), "project", "session_id", "path", "seq", "line", "size_bytes"
    )


def session_heads(first_lines: DataFrame) -> DataFrame:
    """What line one says of a session: its id, directory and start."""
    payload = F.col("rec.payload")
    heads = readable(first_lines, "type string, timestamp string, payload variant").where("rec.type = 'session_meta'")
    stem = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    return heads.select(
        "path",
        F.coalesce(
            F.nullif(first_truthy(get(payload, "$.session_id"), get(payload, "$.id")), F.lit("")), stem
        ).alias("session_id"),
        text_at(payload, "$.cwd").alias("cwd"),
        F.coalesce("rec.timestamp", F.lit("")).alias("started"),
    )


def read_titles(spark: SparkSession, root: str) -> DataFrame:
    """First recorded text per session id from the history file: ``session_id, history_title``."""
    path = f"{root}/history.jsonl"
    if not any_path(spark, path):
        return spark.createDataFrame([], "session_id string, history_title string")
    return first_titles(read_lines(spark, path))


def first_titles(lines: DataFrame) -> DataFrame:
    """The earliest entry of every session id."""
    blank = F.lit("")
    entries = readable(lines, "session_id string, text string").select(
        F.coalesce("rec.session_id", blank).alias("session_id"), "seq", F.coalesce("rec.text", blank).alias("text")
    )
    return entries.groupBy("session_id").agg(F.min_by("text", "seq").alias("history_title"))
