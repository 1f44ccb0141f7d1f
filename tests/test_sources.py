"""Reading files: line numbers over splits, both layouts, raw output."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spoolsift.operators import search
from spoolsift.operators.claude import claude_events, claude_sessions
from spoolsift.operators.codex import codex_sessions
from spoolsift.plans.load import load_claude, load_codex, read
from spoolsift.sources import claude, codex
from spoolsift.sources.lines import read_lines
from spoolsift.sources.store import write_events, write_lines


def test_line_numbers_over_splits(spark, tmp_path):
    rng = random.Random(3)
    for name in "abc":
        lines = [f"{name}{i} " + "x" * rng.randrange(60) if rng.random() < 0.9 else "" for i in range(1, 2001)]
        (tmp_path / f"{name}.jsonl").write_text("".join(line + rng.choice(["\n", "\r\n"]) for line in lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = read_lines(spark, f"{tmp_path}/*.jsonl").where("line <> ''")
        assert got.rdd.getNumPartitions() > 10
        number = F.regexp_extract("line", r"^[abc](\d+)", 1).cast("bigint")
        assert got.where(number != F.col("seq")).count() == 0
        assert read_lines(spark, f"{tmp_path}/*.jsonl").count() == 6000
        slow = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = read_lines(spark, f"{tmp_path}/*.jsonl").where("line <> ''")
        assert got.where(number != F.col("seq")).count() == 0
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", slow)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.fixture
def claude_root(tmp_path):
    here, near = tmp_path / "projects" / "-srv-my-app", tmp_path / "projects" / "-srv-other"
    (here / "s1" / "subagents").mkdir(parents=True)
    near.mkdir(parents=True)
    record = {"type": "user", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": "hi"}}
    (here / "s1.jsonl").write_bytes(json.dumps(record).encode() + b'\n\n{"type": "note", "mode": "\xff\xfe"}\ntorn {')
    (here / "s1" / "subagents" / "b.jsonl").write_text('{"type": "x"}\n')
    (here / "s1" / "subagents" / "a.jsonl").write_text('{"type": "x"}\n')
    (near / "s2.jsonl").write_text(json.dumps(record) + "\n")
    return str(tmp_path)


def test_flattened_names_collide(spark):
    assert claude.flatten_cwd("/data/.b/é_1") == "-data--b---1"
    assert claude.flatten_cwd("D:\\work\\x+y") == "D--work-x-y"
    row = spark.range(1).select(claude.flatten_cwd_column(F.lit("/a/b")).alias("a"), claude.flatten_cwd_column(F.lit("/a-b")).alias("b"))
    assert tuple(row.first()) == ("-a-b", "-a-b")


def test_project_scope_and_bad_bytes(spark, claude_root, rows):
    lines = claude.read_sessions(spark, claude_root, "/srv/my_app")
    assert rows(lines, "seq", "session_id", "project")[0] == (1, "s1", "-srv-my-app")
    assert rows(claude_events(lines), "seq", "kind", "text") == [(1, "text", "hi"), (3, "note", "��")]
    assert {r["session_id"] for r in claude_sessions(claude.read_sessions(spark, claude_root)).collect()} == {"s1", "s2"}


def test_files_of_a_session(spark, claude_root, rows):
    files = claude.session_files(claude.read_session_files(spark, claude_root, "/srv/my-app"))
    names = [(p, path.rsplit("/", 1)[1]) for p, path in rows(files, "place", "path")]
    assert names == [(1, "s1.jsonl"), (2, "a.jsonl"), (3, "b.jsonl")]
    assert claude.read_session_files(spark, claude_root, "/srv/other").count() == 1


def test_rollouts_at_any_depth(spark, tmp_path, rows):
    day = tmp_path / "sessions" / "2026" / "07" / "24"
    day.mkdir(parents=True)
    head = {"type": "session_meta", "timestamp": "2026-07-24T00:00:00Z", "payload": {"session_id": "S", "cwd": "/w"}}
    (day / "rollout-1.jsonl").write_text(json.dumps(head) + "\n" + '{"type": "event_msg", "payload": {"type": "user_message", "message": "q"}}')
    (tmp_path / "sessions" / "rollout-2.jsonl").write_text(json.dumps(head).replace('"S"', '"T"') + "\n")
    (day / "other.jsonl").write_text(json.dumps(head) + "\n")
    (day / "rollout-3.jsonl").write_text("")
    (tmp_path / "history.jsonl").write_text('{"session_id": "T", "text": "old question"}\n')
    lines = codex.read_sessions(spark, str(tmp_path), "/w")
    assert rows(lines, "session_id", "seq") == [("S", 1), ("S", 2), ("T", 1)]
    titled = codex_sessions(lines, codex.read_titles(spark, str(tmp_path)))
    assert rows(titled, "session_id", "title") == [("S", "q"), ("T", "old question")]
    assert codex.read_sessions(spark, str(tmp_path), "/elsewhere").count() == 0


def test_stored_events_and_raw_lines(spark, tmp_path, as_events, rows):
    events = as_events(*[("s", i, "user", "text", f"t{i}") for i in range(1, 6)])
    write_events(events, f"{tmp_path}/events")
    back = spark.read.parquet(f"{tmp_path}/events")
    assert rows(back, "seq", "text", "project") == [(i, f"t{i}", "p") for i in range(1, 6)]
    plan = back.where("provider = 'claude' AND path = 's'").select("seq")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(provider" in plan and "EqualTo(path,s)" in plan
    write_lines(events.where("seq < 3"), f"{tmp_path}/raw")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/raw").collect()) == ["line 1", "line 2"]


def test_load_and_search(spark, claude_root, tmp_path, rows):
    load_claude(spark, claude_root, f"{tmp_path}/tables")
    events, sessions = read(spark, f"{tmp_path}/tables")
    assert rows(events, "session_id", "seq", "pos") == [("s1", 1, 1), ("s1", 3, 2), ("s2", 1, 1)]
    assert rows(search.search_hits(events, sessions, "hi"), "session_id", "seq") == [("s1", 1), ("s2", 1)]
    day = tmp_path / "sessions"
    day.mkdir()
    (day / "rollout-1.jsonl").write_text('{"type": "session_meta", "timestamp": "2026-01-01", "payload": {"id": "S", "cwd": "/w"}}\n')
    # Both formats, and the same projects again, in one place.
    load_codex(spark, str(tmp_path), f"{tmp_path}/tables")
    load_claude(spark, claude_root, f"{tmp_path}/tables")
    events, sessions = read(spark, f"{tmp_path}/tables")
    assert rows(sessions, "session_id", "title") == [("S", ""), ("s1", "hi"), ("s2", "hi")]
    assert rows(events, "session_id", "seq", "kind")[0] == ("S", 1, "session_meta") and events.count() == 4


def test_attribution_of_other_projects_stays(spark, tmp_path, rows):
    files = {}
    for name in "ab":
        files[name] = tmp_path / "projects" / f"-srv-{name}" / f"{name}1.jsonl"
        files[name].parent.mkdir(parents=True)
    record = {"type": "assistant", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": "hi"}}
    for file in files.values():
        file.write_text(json.dumps({**record, "attributionSkill": "fmt"}) + "\n")
    out = f"{tmp_path}/tables"
    for cwd in ("/srv/a", "/srv/b", "/srv/b"):
        load_claude(spark, str(tmp_path), out, cwd)
    assert rows(spark.read.parquet(f"{out}/attribution"), "project", "session_id", "records") == [("-srv-a", "a1", 1), ("-srv-b", "b1", 1)]
    # Loaded again without any, a project has none.
    files["b"].write_text(json.dumps(record) + "\n")
    load_claude(spark, str(tmp_path), out, "/srv/b")
    spark.catalog.refreshByPath(f"{out}/attribution")
    assert rows(spark.read.parquet(f"{out}/attribution"), "project", "session_id") == [("-srv-a", "a1")]
