import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from spoolsift import model, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("work")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield prepare(session)
    session.stop()


@pytest.fixture
def small_slabs(monkeypatch):
    """Slabs of three records, so that short sessions span several."""
    monkeypatch.setattr(model, "SLAB", 3)


@pytest.fixture
def as_lines(spark):
    """Lines of one session from records (or raw texts)."""

    def make(*records, provider="claude", session="s1", project="p", path=None):
        rows = [
            (provider, project, session, path or session, i, r if isinstance(r, str) else json.dumps(r), 1)
            for i, r in enumerate(records, 1)
        ]
        schema = "provider string, project string, session_id string, path string, seq bigint, line string, size_bytes bigint"
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def as_events(spark):
    """Events from short tuples: session, seq, role, kind, text, and optionally tool, tag, is_error, call_id, ts."""

    def make(*rows):
        full = [(*row, *("", "", False, None, "")[len(row) - 5 :]) for row in rows]
        schema = (
            "session_id string, seq bigint, role string, kind string, text string, tool string, tag string, "
            "is_error boolean, call_id string, ts string"
        )
        df = spark.createDataFrame(full, schema)
        return df.select(
            F.lit("claude").alias("provider"),
            F.lit("p").alias("project"),
            "session_id",
            F.col("session_id").alias("path"),
            "seq",
            F.lit(0).alias("block"),
            F.col("seq").alias("pos"),
            *("ts", "role", "kind", "text", "tool", "is_error", "tag", "call_id"),
            F.concat(F.lit("line "), F.col("seq").cast("string")).alias("line"),
        )

    return make


@pytest.fixture
def as_sessions(spark):
    """Sessions from tuples: id, started, ended, title, name."""

    def make(*rows, provider="claude"):
        full = [(provider, "p", r[0], r[0], *(*r[1:], *("", "", "", "")[len(r) - 1 :])) for r in rows]
        schema = (
            "provider string, project string, session_id string, path string, started string, ended string, "
            "title string, name string"
        )
        return spark.createDataFrame(full, schema).selectExpr(
            "*", "'' AS kind", "'' AS model", "0L AS messages", "0L AS errors", "0L AS tokens", "0L AS size_bytes"
        )

    return make


@pytest.fixture
def rows():
    """Rows of some columns, sorted by the first ones."""

    def collect(df, *columns):
        return sorted(tuple(r) for r in df.select(*columns).collect())

    return collect
