"""Handles, time bounds, live state, ids and names."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from spoolsift.functions.times import is_live, parse_bound
from spoolsift.operators.scope import NotOneSession, handles, in_window, resolve, resolve_each, session_list

NOW = datetime(2031, 3, 14, 12, tzinfo=UTC)


@pytest.fixture
def sessions(as_sessions):
    return as_sessions(
        ("aa11", "2031-03-12T09:00:00Z", "2031-03-12T10:00:00Z", "Fix the parser", "alpha"),
        ("aa22", "2031-03-13T09:00:00Z", "2031-03-14T11:55:00Z", "parser again", ""),
        ("aa2", "2031-03-13T09:00:00Z", "junk", "Third", "Beta"),
        ("bb33", "", "", "no start", ""),
        ("cc44", "2031-03-14T00:30:00+02:00", "2031-03-14T12:05:00", "zoned", ""),
    )


def ids(df):
    return [r["session_id"] for r in df.orderBy("n").collect()]


def test_newest_first_then_id(sessions):
    assert ids(handles(sessions)) == ["cc44", "aa22", "aa2", "aa11", "bb33"]


def test_numbers_count_the_narrowed_scope(sessions):
    kept = handles(in_window(sessions, since="2031-03-13", before="today", now=NOW))
    assert ids(kept) == ["cc44", "aa22", "aa2"]
    assert [r["n"] for r in kept.orderBy("n").collect()] == [1, 2, 3]


def test_session_without_start_is_before_everything(sessions):
    assert "bb33" in ids(handles(in_window(sessions, before="2031-03-12")))
    assert "bb33" not in ids(handles(in_window(sessions, since="2000-01-01")))


def test_bound_by_handle_uses_the_whole_scope(sessions):
    assert ids(handles(in_window(sessions, before="@2"))) == ["aa11", "bb33"]
    assert ids(handles(in_window(sessions, since="@2", before="@1"))) == ["aa22", "aa2"]
    with pytest.raises(NotOneSession, match="@9"):
        in_window(sessions, since="@9")


@pytest.mark.parametrize("bad", ["yesterday", "2031-3-1", "2031-13-01", "10:00", "2031"])
def test_bad_bounds(bad):
    with pytest.raises(ValueError, match="no time bound"):
        parse_bound(bad)


def test_good_bounds():
    assert parse_bound("2031-03-13 14:30+02:00") == datetime(2031, 3, 13, 12, 30, tzinfo=UTC)
    assert parse_bound("today", NOW) == datetime(2031, 3, 14, tzinfo=UTC)
    assert parse_bound("2031-03-13") == datetime(2031, 3, 13, tzinfo=UTC)


def test_live_is_strictly_inside_ten_minutes(spark):
    stamps = ["2031-03-14T11:50:01Z", "2031-03-14T11:49:59Z", "2031-03-14T12:05:00Z", "2031-03-14T11:50:00", "2031-03-14T14:00:00+02:00", "", "x"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i int, ts string")
    got = [r[0] for r in df.orderBy("i").select(is_live(F.col("ts"), NOW)).collect()]
    assert got == [True, False, True, False, True, False, False]


def test_resolve(sessions):
    numbered = handles(sessions)
    assert ids(resolve(numbered)) == ["cc44"]
    assert ids(resolve(numbered, "@2")) == ["aa22"]
    assert ids(resolve(numbered, "@4:@2")) == ["aa22", "aa2", "aa11"]
    assert ids(resolve(numbered, "bb")) == ["bb33"]
    assert ids(resolve(numbered, "AA2")) == ["aa2"]  # an exact id wins over a longer one
    assert ids(resolve(numbered, "beta")) == ["aa2"]
    assert ids(resolve(numbered, "third")) == ["aa2"]
    for arg, total in (("aa", 3), ("parser", 2), ("nothing", 0), ("@0", 0), ("@9:@1", 0)):
        with pytest.raises(NotOneSession) as error:
            resolve(numbered, arg)
        assert error.value.total == total == len(error.value.candidates)
    for arg in ("@x", "@1:", "@"):
        with pytest.raises(ValueError, match="no handle"):
            resolve(numbered, arg)


def test_at_most_five_candidates(as_sessions):
    many = handles(as_sessions(*[(f"ab{i}", f"2026-01-0{i}", "", f"t{i}") for i in range(1, 9)]))
    with pytest.raises(NotOneSession) as error:
        resolve(many, "ab")
    assert error.value.total == 8 and error.value.candidates == [(f"ab{i}", f"t{i}") for i in (8, 7, 6, 5, 4)]


def test_many_arguments_are_read_as_one_is(sessions):
    numbered = handles(sessions)
    args = [None, "@2", "@4:@2", "bb", "AA2", "beta", "third", "aa", "parser", "nothing", "@0", "@9:@1", "", "aa"]
    rows = resolve_each(numbered, args).orderBy("n").collect()
    assert {r["arg"] for r in rows} == set(args)
    for arg in args:
        mine = [r for r in rows if r["arg"] == arg]
        try:
            expected = ids(resolve(numbered, arg))
        except NotOneSession as error:
            assert {(r["state"], r["total"]) for r in mine} == {("several" if error.total else "none", error.total)}
            assert [(r["short_id"], r["title"]) for r in mine if r["n"]] == error.candidates
            assert len(mine) == max(1, len(error.candidates))
        else:
            assert [r["session_id"] for r in mine] == expected
            assert {(r["state"], r["total"]) for r in mine} == {("one", len(expected))}


def test_arguments_by_project(sessions):
    mixed = sessions.withColumn("project", F.when(F.col("session_id").isin("aa11", "bb33"), F.lit(None)).otherwise(F.lit("q")))
    found = {(r["project"], r["arg"]): (r["state"], r["session_id"]) for r in resolve_each(handles(mixed), ["aa", "@2"]).collect()}
    assert found[None, "aa"] == ("one", "aa11") and found["q", "aa"][0] == "several"
    assert found[None, "@2"] == ("one", "bb33") and found["q", "@2"] == ("one", "aa22")


def test_files_of_one_session_are_one(as_sessions):
    twice = as_sessions(("ab1", "2026-01-01", "", "t", ""), ("cd1", "2026-01-02", "", "u", ""))
    twice = twice.unionByName(twice.withColumn("path", F.concat("path", F.lit("-copy"))))
    rows = resolve_each(handles(twice), ["ab", "AB1"]).collect()
    assert [(r["state"], r["total"], r["session_id"]) for r in rows] == [("one", 2, "ab1")] * 4


def test_arguments_that_cannot_be_read(sessions):
    for args in (["@x"], ["a", "@1:"], []):
        with pytest.raises(ValueError):
            resolve_each(handles(sessions), args)
    assert resolve_each(handles(sessions.where("false")), ["a", "@1", None]).count() == 0


def test_list_rows(sessions):
    row = session_list(handles(sessions), NOW).where("n = 2").first()
    assert (row["short_id"], row["live"], row["title"]) == ("aa22", True, "parser again")
