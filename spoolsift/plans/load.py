"""From log files to the tables that searches and views read.

Both formats may be loaded into one place; loading a provider's projects again replaces what was there of them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolsift.operators import claude, codex
from spoolsift.operators.events import ready_events
from spoolsift.session import prepare
from spoolsift.sources import claude as claude_source
from spoolsift.sources import codex as codex_source
from spoolsift.sources.store import kept, write_events


def load_claude(spark: SparkSession, root: str, out: str, cwd: str | None = None) -> None:
    """Load all projects below ``root`` (or one) into ``events``, ``sessions`` and ``attribution`` below ``out``.

    All three are laid out by provider and project; ``attribution`` has no files as long as no record names a skill.
    """
    # Each line is parsed once, straight from its file; all three tables come from what that gives.
    records = kept(claude.claude_records(claude_source.read_sessions(prepare(spark), root, cwd)), "records")
    write_events(ready_events(claude.events_of(records), stored=True), f"{out}/events")
    summaries = claude_source.with_empty_files(claude.sessions_of(records), claude_source.main_files(spark, root, cwd))
    _write(summaries, f"{out}/sessions", "started")
    skills = kept(claude.attribution_of(records), "attribution")
    _drop_projects(records.select("provider", "project").distinct().join(skills, ["provider", "project"], "left_anti"), f"{out}/attribution")
    _write(skills, f"{out}/attribution", "session_id")


def load_codex(spark: SparkSession, root: str, out: str, cwd: str | None = None) -> None:
    """Load all rollouts below ``root`` (or those of one directory) into ``events`` and ``sessions`` below ``out``."""
    lines = kept(codex_source.read_sessions(prepare(spark), root, cwd), "lines")
    write_events(ready_events(codex.codex_events(lines)), f"{out}/events")
    titles = codex_source.read_titles(spark, root)
    _write(codex.codex_sessions(lines, titles), f"{out}/sessions", "started")


def read(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The loaded events and sessions."""
    prepare(spark)
    return spark.read.parquet(f"{out}/events"), spark.read.parquet(f"{out}/sessions")


def _write(rows: DataFrame, path: str, order_by: str) -> None:
    """Write rows by provider and project; only the projects written anew are replaced."""
    order = ["provider", "project", order_by]
    named = rows.withColumns({name: F.coalesce(name, F.lit("")) for name in ("provider", "project")})
    placed = named.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider", "project").parquet(path)


def _drop_projects(projects: DataFrame, path: str) -> None:
    """Delete what is stored of projects that have no rows any more; a dynamic overwrite would leave it."""
    spark = projects.sparkSession
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for provider, project in projects.collect():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/provider={escaped(provider)}/project={escaped(project)}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
