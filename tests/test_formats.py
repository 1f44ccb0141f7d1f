"""Both record formats: events, summaries, odd shapes."""

import json

from pyspark.sql import functions as F

from spoolsift.operators import claude
from spoolsift.operators.claude import attribution, claude_events, claude_sessions, skill_of
from spoolsift.operators.codex import codex_events, codex_sessions
from spoolsift.operators.events import pair_tools, ready_events
from spoolsift.sources.lines import is_json, line_report, readable
from spoolsift.sources import codex as codex_source

FIELDS = ("seq", "block", "role", "kind", "text", "tag")


def user(content, **more):
    return {"message": {"content": content, "role": "user"}, "timestamp": "2031-02-03T04:05:06.000Z", "type": "user", **more}


def assistant(*blocks, **more):
    message = {"content": list(blocks), "usage": {"output_tokens": 11}, "model": "m-1"}
    return {"message": message, "timestamp": "2031-02-03T04:06:00.000Z", "type": "assistant", **more}


def test_two_calls_and_renamed_session(as_lines, rows):
    def call(name, **given):
        return {"type": "tool_use", "id": f"id-{name}", "name": name, "input": given}

    def result(name, content, failed):
        return {"type": "tool_result", "tool_use_id": f"id-{name}", "is_error": failed, "content": content}

    lines = as_lines(
        {"type": "custom-title", "customTitle": "first name"},
        user("count the files", cwd="/data/x", gitBranch="dev"),
        assistant(call("Glob", pattern="**/*"), call("Bash", command="ls | wc -l")),
        user([result("Glob", "none", True), result("Bash", "12", False)], cwd="/data/y"),
        {"type": "custom-title", "customTitle": "second name"},
        {"type": "ai-title", "aiTitle": "Counting"},
    )
    s = claude_sessions(lines).first()
    assert (s["messages"], s["errors"], s["tokens"], s["title"], s["name"]) == (3, 1, 11, "Counting", "second name")
    assert s["started"] == "2031-02-03T04:05:06.000Z" and s["model"] == "m-1"
    assert s["first_user"] == "count the files" and s["git_branch"] == "dev"
    events = ready_events(claude_events(lines))
    assert rows(events.where("kind = 'tool'"), "tool", "tag") == [("Bash", "ok"), ("Glob", "err")]
    assert rows(events.where("kind = 'result'"), "tool", "is_error", "text", "pos") == [("Bash", False, "12", 6), ("Glob", True, "none", 5)]


def test_ended_is_last_in_file_order(as_lines):
    lines = as_lines(
        {"type": "system", "timestamp": "2026-07-03T00:00:00Z"},
        {"type": "system", "timestamp": "2026-07-01T00:00:00Z"},
        {"type": "ai-title", "aiTitle": "x"},
    )
    s = claude_sessions(lines).first()
    assert (s["started"], s["ended"]) == ("2026-07-03T00:00:00Z", "2026-07-01T00:00:00Z")


def test_string_content_and_tags(as_lines, rows):
    lines = as_lines(user("a"), user("b", isMeta=True), user("c", isMeta=True, isCompactSummary=True), user('["x"]'))
    assert rows(claude_events(lines), *FIELDS) == [
        (1, 0, "user", "text", "a", ""),
        (2, 0, "user", "text", "b", "meta"),
        (3, 0, "user", "text", "c", "compact"),
        (4, 0, "user", "text", '["x"]', ""),
    ]


def test_blocks_of_all_kinds(as_lines, rows):
    lines = as_lines(
        assistant(
            "loose",
            {"type": "text", "text": "hi é"},
            {"type": "thinking", "thinking": "hm"},
            {"type": "tool_use", "id": "a", "name": "Grep", "input": {"path": "/x", "pattern": "p.*"}},
            {"type": "tool_use", "id": "b", "name": "Todo", "input": {"z": [1, {"k": "a,b: c"}], "a": None}},
            {"type": "image", "z": 1, "source": {"b": "q:r"}},
            5,
        ),
        user([], isMeta=True),
        user(["only", "strings"]),
    )
    assert rows(claude_events(lines), *FIELDS) == [
        (1, 1, "asst", "text", "hi é", ""),
        (1, 2, "asst", "thinking", "hm", ""),
        (1, 3, "asst", "tool", "p.*", ""),
        (1, 4, "asst", "tool", '{"z": [1, {"k": "a,b: c"}], "a": null}', ""),
        (1, 5, "asst", "image", '{"type": "image", "z": 1, "source": {"b": "q:r"}}', ""),
        (2, 0, "user", "user", "", ""),
        (3, 0, "user", "user", "", ""),
    ]


def test_argument_words_and_key_order(as_lines, rows):
    calls = [{"url": "u", "command": None}, {"command": True}, {"skill": "s", "prompt": "p"}, {"file_path": 3}]
    lines = as_lines(*[assistant({"type": "tool_use", "id": "x", "name": "T", "input": c}) for c in calls])
    assert [r[1] for r in rows(claude_events(lines), "seq", "text")] == ["None", "True", "s", "3"]


def test_result_text_and_denial(as_lines, rows):
    lines = as_lines(
        user(
            [
                {"type": "tool_result", "tool_use_id": "a", "content": [{"text": "x"}, "no", {"k": 1}, {"text": "y"}]},
                {"type": "tool_result", "content": {"odd": 1}},
                {"type": "tool_result", "content": "[1, 2]", "is_error": 0},
                {"type": "text", "text": "t"},
            ],
            toolDenialKind="user-rejected",
        )
    )
    assert rows(claude_events(lines), "block", "kind", "text", "tag", "call_id", "is_error") == [
        (0, "result", "x\n\ny", "user-rejected", "a", False),
        (1, "result", "", "user-rejected", "", False),
        (2, "result", "[1, 2]", "user-rejected", "", False),
        (3, "text", "t", "", None, False),
    ]


def test_other_records(as_lines, rows):
    lines = as_lines(
        {"type": "system", "subtype": "hook", "content": "ran"},
        {"type": "attachment", "attachment": {"type": "file", "content": "body"}},
        {"type": "ai-title", "aiTitle": ""},
        {"type": "mode", "aiTitle": "", "mode": "plan"},
        {"no": "type"},
    )
    assert rows(claude_events(lines), *FIELDS[:5]) == [
        (1, 0, "sys", "system.hook", "ran"),
        (2, 0, "attach", "attachment.file", "body"),
        (3, 0, "meta", "ai-title", ""),
        (4, 0, "meta", "mode", "plan"),
        (5, 0, "meta", "", ""),
    ]


def test_broken_lines_keep_their_numbers(as_lines, rows):
    lines = as_lines(user("a"), "", "   ", '{"type": "user", "mess', "[1]", "7", '"s"', "null", user("b"), '{"type":"x","type":"y"}')
    assert rows(claude_events(lines), "seq", "kind") == [(1, "text"), (9, "text"), (10, "y")]
    report = line_report(lines).first()
    assert (report["lines"], report["blank"], report["unreadable"]) == (10, 2, 5)


def test_null_message_counts_as_absent(as_lines, rows):
    lines = as_lines({"type": "user", "message": None}, {"type": "assistant", "message": {"content": None}}, {"type": "user"})
    assert [r[3:5] for r in rows(claude_events(lines), *FIELDS)] == [("text", "")] * 3
    assert claude_sessions(lines).first()["messages"] == 3


def test_strings_beyond_the_parser_default(spark, as_lines):
    from pyspark.sql import functions as F

    long = as_lines(user("@@")).withColumn("line", F.replace("line", F.lit("@@"), F.repeat(F.lit("x"), 21_000_000)))
    assert claude_events(long).select(F.length("text")).first()[0] == 21_000_000


def test_title_falls_back_to_first_typed_text(as_lines):
    lines = as_lines(
        user("meta", isMeta=True),
        user([{"type": "tool_result", "content": "r"}]),
        user([{"type": "image"}, {"type": "text", "text": "second block"}, {"type": "text", "text": "third"}]),
        user("later"),
    )
    s = claude_sessions(lines).first()
    assert (s["title"], s["first_user"]) == ("second block", "second block")


def test_error_counts_of_list_and_summary_differ(as_lines):
    lines = as_lines(
        user([{"type": "tool_result", "is_error": True}, {"type": "odd", "is_error": 1}, "x"]),
        {"type": "assistant", "isApiErrorMessage": True, "message": {"content": []}, "isSidechain": True},
    )
    s = claude_sessions(lines).first()
    assert (s["errors"], s["sidechain_records"]) == (3, 1)
    assert claude_events(lines).where("is_error").count() == 1


def test_attribution_and_skill_inputs(as_lines, rows):
    call = {"type": "tool_use", "id": "1", "name": "Skill", "input": {"skill": "fmt"}}
    lines = as_lines(assistant(call, attributionSkill="fmt"), assistant({"type": "text", "text": "x"}, attributionSkill="fmt"))
    assert rows(attribution(lines), "skill", "records") == [("fmt", 2)]
    assert rows(skill_of(claude_events(lines)).where("skill IS NOT NULL"), "skill") == [("fmt",)]


def head(**payload):
    return {"timestamp": "2026-07-24T10:00:00Z", "type": "session_meta", "payload": {"cwd": "/w", **payload}}


def item(kind, **payload):
    return {"timestamp": "2026-07-24T10:00:01Z", "type": "response_item", "payload": {"type": kind, **payload}}


def event(kind, **payload):
    return {"timestamp": "2026-07-24T10:00:02Z", "type": "event_msg", "payload": {"type": kind, **payload}}


def test_rollout_events(as_lines, rows):
    lines = as_lines(
        head(session_id="s-1", source="exec"),
        {"type": "turn_context", "payload": {"model": "m", "effort": "high"}},
        item("message", role="user", content=[{"text": "hello"}, {"text": "you"}]),
        item("message", role="developer", content="plain", phase="p1"),
        item("agent_message", content=[]),
        item("reasoning", summary=[{"text": "why"}]),
        item("function_call", name="sh", arguments='{"cmd":"ls"}', call_id="c1"),
        item("custom_tool_call", input="patch", call_id="c2"),
        item("web_search_call", action={"q": "x", "n": 1}),
        item("function_call_output", call_id="c1", output='{"output": "boom", "metadata": {"exit_code": 2}}'),
        item("custom_tool_call_output", call_id="c2", output="not json"),
        item("function_call_output", call_id="c9", output=[{"text": "a"}, {"text": "b"}]),
        item("function_call_output", call_id="c9", output="12"),
        item("ghost"),
        event("user_message", message="typed"),
        event("exec_command_end", call_id="c1", exit_code=1, stderr="", aggregated_output="agg"),
        event("patch_apply_end", call_id="c3", success=False, stdout="out"),
        event("mcp_tool_call_end", call_id="c4", result={"Err": None}, invocation={"tool": "t", "n": 1}),
        event("mcp_tool_call_end", call_id="c5", result={"Ok": 1}),
        event("token_count", info=None),
        {"type": "compacted", "payload": None},
        provider="codex",
    )
    got = rows(pair_tools(codex_events(lines)), "seq", "role", "kind", "text", "tool", "is_error", "tag")
    assert got == [
        (1, "meta", "session_meta", "", "", False, ""),
        (2, "ctx", "turn_context", "m/high", "", False, ""),
        (3, "user", "text", "hello\nyou", "", False, ""),
        (4, "sys", "text", "plain", "", False, "p1"),
        (5, "asst", "text", "", "", False, ""),
        (6, "asst", "thinking", "why", "", False, ""),
        (7, "asst", "tool", '{"cmd":"ls"}', "sh", False, "err"),
        (8, "asst", "tool", "patch", "custom_tool_call", False, "ok"),
        (9, "asst", "tool", '{"q": "x", "n": 1}', "web_search", False, ""),
        (10, "user", "result", "boom", "sh", True, ""),
        (11, "user", "result", "not json", "custom_tool_call", False, ""),
        (12, "user", "result", "a\nb", "", False, ""),
        (13, "user", "result", "", "", False, ""),
        (14, "meta", "response.ghost", "", "", False, ""),
        (15, "user", "user_message", "typed", "", False, ""),
        (16, "meta", "event.exec_command_end", "agg", "", True, ""),
        (17, "meta", "event.patch_apply_end", "out", "", True, ""),
        (18, "meta", "event.mcp_tool_call_end", '{"tool": "t", "n": 1}', "", True, ""),
        (19, "meta", "event.mcp_tool_call_end", '""', "", False, ""),
        (20, "meta", "event.token_count", "", "", False, ""),
        (21, "meta", "compacted", "", "", False, ""),
    ]


def test_rollout_summary(spark, as_lines):
    def total(n):
        return event("token_count", info={"total_token_usage": {"total_tokens": n}})

    lines = as_lines(
        head(id="s-2", source={"sub": 1}, thread_source="review", originator="cli", cli_version="1.2"),
        item("message", role="user", content="x"),
        {"type": "turn_context", "payload": {"model": "a", "effort": "low"}},
        {"type": "turn_context", "payload": {"model": "b"}},
        total(10),
        total(25),
        total(0),
        item("function_call_output", call_id="c1", output='{"output": "", "metadata": {"exit_code": 1}}'),
        event("exec_command_end", call_id="c1", exit_code=1),
        event("exec_command_end", exit_code=1),
        event("user_message", message=""),
        event("user_message", message="first words"),
        provider="codex",
        path="rollout-9.jsonl",
    )
    s = codex_sessions(lines).first()
    assert (s["session_id"], s["kind"], s["originator"], s["cli_version"]) == ("s-2", "review", "cli", "1.2")
    assert (s["messages"], s["errors"], s["tokens"], s["model"]) == (1, 2, 25, "b/")
    assert (s["started"], s["ended"], s["title"]) == ("2026-07-24T10:00:00Z", "2026-07-24T10:00:02Z", "first words")
    titles = spark.createDataFrame([("s-2", "from history")], "session_id string, history_title string")
    assert codex_sessions(lines, titles).first()["title"] == "from history"


def test_rollout_scope_and_ids(as_lines, rows):
    a = as_lines(head(session_id="A"), item("x"), provider="codex", path="d/rollout-1.jsonl")
    b = as_lines(head(session_id="", id=""), item("x"), provider="codex", path="d/rollout-2.jsonl")
    other = as_lines({**head(session_id="C"), "payload": {"cwd": "/w/", "session_id": "C"}}, provider="codex", path="d/r3.jsonl")
    no_head = as_lines(item("x"), head(session_id="D"), provider="codex", path="d/r4.jsonl")
    lines = a.unionByName(b).unionByName(other).unionByName(no_head)
    assert rows(codex_source.in_scope(lines, "/w"), "session_id", "seq") == [("A", 1), ("A", 2), ("rollout-2", 1), ("rollout-2", 2)]
    assert codex_source.in_scope(lines).select("session_id").distinct().count() == 3


def test_first_history_entry_wins(as_lines, rows):
    lines = as_lines({"session_id": "a", "text": "one"}, "bad", {"session_id": "a", "text": "two"}, {"session_id": "b", "text": "x"})
    assert rows(codex_source.first_titles(lines), "session_id", "history_title") == [("a", "one"), ("b", "x")]


# Lines that are one JSON object, and lines that are not, to Python.
SOUND = [
    '{"type": "user"}',
    ' \t{"type": "user"}\x0b\x0c\x1c ',
    '\u2003{"type": "user"}\xa0',
    '{"type": "user", "x": NaN, "y": -Infinity}',
    '{"type": "a", "type": "user"}',
    '{"type": "user", "x": {"rec": 1, "_end": "}"}}',
    '{"type": "user", "n": ' + "9" * 3000 + "}",
    '{"type": "us\\u0065r"}',
    "{}",
]
BROKEN = [
    "{'type': 'user'}",
    '{"type": "user"}{"type": "user"}',
    '{"type": "user"} {"type": "user"}',
    '{"type": "user"}, {"type": "user"}',
    '{"type": "user"} junk }',
    '{"type": "user"}, "_end": "x"} {}',
    '{"type": "user",}',
    '{"type": "user"',
    '{type: "user"}',
    '{"type": "user"} // }',
    '{"type": "us\ter"}',
    '{"type": "\\x"}',
    '{"x": 01}',
    "{",
    "}",
]


def holds_object(line):
    try:
        return isinstance(json.loads(line.strip()), dict)
    except ValueError:
        return False


def test_a_line_is_a_record_if_python_reads_one(as_lines, spark):
    lines = SOUND + BROKEN + ["[1]", "1", "", "  "]
    assert [holds_object(line) for line in lines] == [line in SOUND for line in lines]
    table = as_lines(*lines)
    got = [r[0] for r in table.orderBy("seq").select(is_json(F.col("line"))).collect()]
    assert got == [line in SOUND for line in lines]
    read = {r["seq"]: r["type"] for r in readable(table, "type string").select("seq", "rec.type").collect()}
    assert read == {i: json.loads(line.strip()).get("type") for i, line in enumerate(SOUND, 1)}
    report = line_report(table).first()
    assert (report["lines"], report["blank"], report["unreadable"]) == (len(lines), 2, len(BROKEN) + 2)


def test_one_parse_gives_what_three_give(spark, as_lines, tmp_path):
    lines = as_lines(
        user("typed", cwd="/w", gitBranch="b"),
        "",
        "torn {",
        assistant({"type": "tool_use", "id": "i", "name": "Bash", "input": {"command": "ls"}}, 5, {"type": "text", "text": "t"}, attributionSkill="fmt"),
        user([{"type": "tool_result", "tool_use_id": "i", "is_error": True, "content": "no"}], isSidechain=1),
        user([]),
        {"type": "custom-title", "customTitle": 7},
        {"type": "ai-title", "aiTitle": None},
        {"type": "system", "subtype": "x", "content": "c", "isApiErrorMessage": True, "attributionSkill": ""},
    ).unionByName(as_lines("no record", session="s2"))
    claude.claude_records(lines).write.parquet(f"{tmp_path}/records")
    records = spark.read.parquet(f"{tmp_path}/records")
    for one, other in ((claude.events_of(records), claude_events(lines)), (claude.sessions_of(records), claude_sessions(lines)), (claude.attribution_of(records), attribution(lines))):
        assert one.columns == other.columns
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    assert claude.sessions_of(records).count() == 2
    plan = claude.claude_records(as_lines(user("x")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1
    # Summaries read none of the texts.
    plan = claude.sessions_of(records)._jdf.queryExecution().executedPlan().toString()
    assert "line:string" not in plan and "text:string" not in plan.replace("context:string", "")
