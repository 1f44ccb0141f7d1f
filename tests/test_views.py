"""Slices, counts, error lists and prompts."""

import pytest

from spoolsift.operators import views
from spoolsift.operators.views import Selection

ROWS = [
    ("s", 1, "user", "text", "go"),
    ("s", 2, "asst", "thinking", "hm"),
    ("s", 3, "asst", "tool", "ls", "Bash", "err", False, "c1"),
    ("s", 4, "user", "result", "bad " * 100, "Bash", "", True, "c1"),
    ("s", 5, "meta", "event.exec_command_end", "bad", "", "", True, "c1"),
    ("s", 6, "meta", "event.x", "", "", "", True, ""),
    ("s", 7, "meta", "eventful", "[Request interrupted by user]"),
    ("s", 8, "ctx", "turn_context", "m/high"),
    ("s", 9, "user", "text", "injected", "", "meta"),
    ("s", 10, "asst", "tool", "cat x", "Read", ""),
    ("s", 11, "asst", "tool", "cat y", "Bash", "ok"),
]


@pytest.fixture
def events(as_events):
    return as_events(*ROWS)


@pytest.fixture
def sessions(as_sessions):
    return as_sessions(("s", "2026-01-01", "2026-01-02", "t"), ("z", "2026-01-03", "", "u"))


def seqs(df):
    return sorted(r["seq"] for r in df.select("seq").collect())


@pytest.mark.parametrize(
    ("selection", "expected"),
    [
        (Selection(), [1, 3, 8, 9, 10, 11]),
        (Selection(thinking=True), [1, 2, 3, 8, 9, 10, 11]),
        (Selection(tools=True), [1, 3, 4, 8, 9, 10, 11]),
        (Selection(errors=True), [3, 4, 5, 6]),
        (Selection(full=True, errors=True), list(range(1, 12))),
        (Selection(kind="event"), [5, 6]),
        (Selection(kind="text", around=3), [1, 9]),
        (Selection(around=3, context=1, span="9:11"), [2, 3, 4]),
        (Selection(around=6), list(range(1, 12))),
        (Selection(span="4-6", full=True), [4, 5, 6]),
        (Selection(span="9:99"), [9, 10, 11]),
        (Selection(span="5"), []),
        (Selection(tail=2), [10, 11]),
        (Selection(kind="text", tail=1), [9]),
        (Selection(tail=0), [1, 3, 8, 9, 10, 11]),
        (Selection(full=True, tail=1500), list(range(1, 12))),
    ],
)
def test_selection(events, selection, expected):
    assert seqs(views.show(events, selection)) == expected


@pytest.mark.parametrize("bad", ["4:", "a:b", "x", ":", "1:2:3"])
def test_bad_ranges(bad):
    with pytest.raises(ValueError, match="range is two"):
        views.parse_span(bad)


def test_long_tail_over_slabs(events, small_slabs, monkeypatch):
    monkeypatch.setattr(views, "_GROUP_LIMIT", 2)
    assert seqs(views.last_events(events, 4)) == [8, 9, 10, 11]
    assert seqs(views.first_events(events, 5)) == [1, 2, 3, 4, 5]


def test_trim_decision(events):
    def decide(*args, **kwargs):
        return tuple(views.trim_decision(events, *args, **kwargs).select("chars", "trim").first())

    assert decide(budget=25) == (2 + 2 + 6 + 8 + 5 + 5, True)
    assert decide(budget=28) == (28, False)
    assert decide(budget=0) == (28, False)
    assert decide(Selection(tail=9), budget=5) == (28, False)
    assert decide(limit=2, budget=3) == (4, True)


def test_hidden(events, rows):
    assert rows(views.hidden_counts(events), "thinking", "results", "others") == [(1, 1, 3)]


def test_prompts(as_events, events, rows, small_slabs):
    assert seqs(views.prompts(events)) == [1, 9]
    assert rows(views.prompt_counts(events), "shown", "left_out") == [(2, 1)]
    typed = as_events(*[("r", i, "user", "text", "t") for i in range(1, 9)], ("r", 9, "user", "user_message", "m"))
    assert seqs(views.prompts(typed)) == [9]
    assert len(seqs(views.prompts(typed, include_all=True))) == 9
    assert rows(views.prompt_counts(typed), "shown", "left_out") == [(1, 8)]


def test_commands(events, sessions, rows):
    got = views.commands(events, sessions)
    assert rows(got, "seq", "tool", "command", "state") == [(3, "Bash", "ls", "err"), (10, "Read", "cat x", "?"), (11, "Bash", "cat y", "ok")]
    assert seqs(views.commands(events, sessions, "CAT")) == []
    assert seqs(views.commands(events, sessions, "cat")) == [10, 11]
    assert seqs(views.commands(events, sessions, limit=2)) == [3, 10]
    assert len(seqs(views.commands(events, sessions, limit=0))) == 3


def test_errors(events, sessions, rows):
    got = views.error_records(events)
    assert rows(got, "seq", "what", "error_key") == [(4, "Bash", "c1"), (6, "event.x", "6")]
    body = got.where("seq = 4").first()["body"]
    assert "chars, middle]" in body and body.startswith("bad bad")
    assert seqs(views.error_records(events, limit=1)) == [4]
    assert [tuple(r) for r in views.errors_by_tool(events, sessions).collect()] == [("Bash", 1), ("event.x", 1)]


def test_error_totals_order(as_events, sessions):
    made = as_events(
        ("s", 1, "user", "result", "x", "A", "", True, "1"),
        ("s", 2, "user", "result", "x", "B", "", True, "2"),
        ("s", 3, "user", "result", "x", "C", "", True, "3"),
        ("z", 1, "user", "result", "x", "C", "", True, "1"),
        ("z", 2, "user", "result", "x", "B", "", True, "2"),
        ("z", 3, "user", "result", "x", "D", "", True, "3"),
    )
    # Equal counts stand in the order of first appearance, newest session first.
    assert [tuple(r) for r in views.errors_by_tool(made, sessions).collect()] == [("C", 2), ("B", 2), ("D", 1), ("A", 1)]


def test_tools(events):
    assert [tuple(r)[1:] for r in views.tool_counts(events).collect()] == [("Bash", 2, 1), ("Read", 1, 0)]


def test_stats(spark, events, sessions):
    skills = spark.createDataFrame([("s", "fmt", 2)], "session_id string, skill string, records bigint")
    full = sessions.where("session_id = 's'").selectExpr(
        "*", "'main' AS git_branch", "'' AS originator", "'' AS cli_version", "'' AS effort", "0L AS sidechain_records"
    )
    got = {r["field"]: r["value"] for r in views.session_stats(events, full, skills).collect()}
    assert got["records.tool"] == "3" and got["records.event.x"] == "1"
    assert got["user.text_meta"] == "1" and got["interruption_markers"] == "1"
    assert got["git_branch"] == "main" and got["attribution.fmt"] == "2" and got["started"] == "2026-01-01"
    assert "effort" not in got and "sidechain_records" not in got
