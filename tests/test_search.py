"""Search: patterns, table, caps over several slabs, context."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spoolsift.functions.patterns import descents, matches, to_jvm
from spoolsift.functions.text import middle_cut, preview
from spoolsift.operators import search, views

TEXTS = [
    "plain", "Webhook", "webhook", "É é", "a.b", "aXb", "x{3}", "{", "[a]", "tab\tx", "a&&b", "line\nend", "end\n", "foo1 foo1",
    "naïve", "nb sp", "^", "٣", "word_", "a~b", "]", "-",
]
PATTERNS = [
    "webhook", "Webhook", "é", "a.b", r"a\.b", r"\S+k", r"x\{3}", "{", "x{3}", "[[a]", "[a&&b]", r"end\Z", "end$", r"(?P<w>foo\d) (?P=w)",
    r"\bna\w+", r"nb\sp|nb\ssp", r"\d", "^a", "[]]", "[^]a]b", "a{,2}b", "(?i)WEBHOOK", "[a~]~", r"[\]-]", "x}", r"\w+_",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_match_as_in_python(spark, pattern):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r["t"] for r in df.where(matches(F.col("t"), pattern)).collect()}
    rx = re.compile(pattern, re.I if pattern == pattern.lower() else 0)
    assert got == {t for t in TEXTS if rx.search(t)}


ANY_CASE = ["i", "k", "s", "x", "[aeiou]s", "[a-z]", "[^a-z]", "[^k]", "[h-j]", "[^i-s]", "[g-z_]$", "^[i]", ".", "a|s", "i{1,2}", r"\.|[is]", "k?s"]


@pytest.mark.parametrize("ignore_case", [False, True])
def test_plain_patterns_match_every_character_as_in_python(spark, ignore_case):
    """Each character by itself, and behind a letter: so the JVM may search any text for a plain pattern."""
    chars = [chr(i) for i in range(0x20000) if not 0xD800 <= i <= 0xDFFF] + ["\U00020000", "\U000e0041", "\U0010ffff"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(chars)], "i int, c string").repartition(8).cache()
    for pattern in ANY_CASE + (["K", "[A-Z]", "[^I-S]"] if not ignore_case else ["K", "[A-Z]s"]):
        rx = re.compile(pattern, re.I if ignore_case or pattern == pattern.lower() else 0)
        for text, made in ((F.col("c"), str), (F.concat(F.lit("a"), "c"), "a{}".format)):
            got = {r["i"] for r in df.where(matches(text, pattern, False, ignore_case)).select("i").collect()}
            assert got == {i for i, c in enumerate(chars) if rx.search(made(c))}, pattern
    df.unpersist()


def python_stages(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_plain_patterns_stay_in_the_jvm(spark, as_events, as_sessions):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for pattern in ("th[aeiou]r", "webhook", "Web", "a.*b", r"a\.b", "(a|b){2}c", "x{3}"):
        assert python_stages(df.where(matches(F.col("t"), pattern))) == 0, pattern
    for pattern in (r"\bna", "é", r"\u00e9", r"(.)\1", "(a|b)+c", "((a|b){10}){10}c"):
        assert python_stages(df.where(matches(F.col("t"), pattern))) == 1, pattern
    table = search.search_table(as_events(("s", 1, "user", "text", "naïve thor")), as_sessions(("s", "2026-01-01")), "th[aeiou]r", datetime(2026, 1, 1))
    assert python_stages(table) == 0 and table.count() == 1


@pytest.mark.parametrize("pattern", ["((a|b){49}){49}c", "(((a|b){9}){9}){9}c", "(" * 60 + "ab" + ")" * 60 + "c", "(?:(?:a|b){7}){7}c"])
def test_nested_groups_do_not_run_out_of_stack(spark, pattern):
    texts = ["ab" * 3_000 + "c", "ab" * 1_300, "ab" * 60 + "abc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rx = re.compile(pattern)
    assert [r["i"] for r in df.where(matches(F.col("t"), pattern)).orderBy("i").collect()] == [i for i, t in enumerate(texts) if rx.search(t)]


def test_groups_are_counted_one_inside_another():
    assert descents("abc") == descents("(a)(b){3}|[(]{99}") - 2 == 1
    assert descents("((a){7}b){8}") == 56 and descents("(a)+") == descents("(a){3,}") == float("inf")
    assert descents(r"\(a\)+[)]*") == 1 and descents("(" * 70 + ")" * 70) == 71


def test_fixed_text_and_flags(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")

    def got(*args):
        return {r["t"] for r in df.where(matches(F.col("t"), *args)).collect()}

    assert got("a.b", True) == {"a.b"}
    assert got("webhook", True) == {"Webhook", "webhook"}
    assert got("Webhook", True) == {"Webhook"}
    assert got("WEBHOOK", False, True) == {"Webhook", "webhook"}


def test_bad_pattern_is_an_error():
    with pytest.raises(ValueError, match="bad regex"):
        matches(None, "foo(")
    assert to_jvm("(?(1)a)") is None


def test_previews(spark):
    df = spark.createDataFrame([("  a \n\t b\x1c ", "x" * 250, "h" * 200 + "m" * 30 + "t" * 120, "x" * 320)], "a string, b string, c string, d string")
    row = df.select(preview(F.col("a")), preview(F.col("b")), preview(F.col("b"), 0), middle_cut(F.col("c")), middle_cut(F.col("d"))).first()
    assert tuple(row) == ("a b", "x" * 200 + "... [+50 chars]", "x" * 250, "h" * 200 + " ...[+30 chars, middle]... " + "t" * 120, "x" * 320)


@pytest.fixture
def corpus(as_events, as_sessions):
    """Four sessions, one of them much longer than a slab of three."""
    rng = random.Random(5)
    made = []
    for sid, size in (("s1", 40), ("s2", 4), ("s3", 9), ("s4", 3)):
        for i in range(1, size + 1):
            text = "nothing" if sid == "s4" or rng.random() < 0.3 else "needle " + "y" * rng.randrange(40)
            made.append((sid, i, rng.choice(["user", "asst"]), "text", text))
    sessions = as_sessions(
        ("s1", "2026-01-02", "", "one"), ("s2", "2026-01-03", "", "two"), ("s3", "2026-01-03", "", "three"), ("s4", "2026-01-01", "", "four")
    )
    started = {"s1": "2026-01-02", "s2": "2026-01-03", "s3": "2026-01-03"}
    ordered = sorted((m for m in made if "needle" in m[4]), key=lambda m: m[1])
    ordered = sorted(ordered, key=lambda m: (started[m[0]], m[0]), reverse=True)
    ordered = [m for sid in ("s3", "s2", "s1") for m in sorted((o for o in ordered if o[0] == sid), key=lambda m: m[1])]
    return as_events(*made), sessions, ordered, made


def _printed(hits, limit, budget):
    """Rows a printer with a row cap and a character budget lets through."""
    shown, used = [], 0
    for sid, seq, role, _, text in hits:
        size = len(f'{sid}\t#{seq:04d}\t{role}\t"{text.strip()}"') + 1
        if (limit and len(shown) >= limit) or (budget and shown and used + size > budget):
            break
        shown.append((sid, seq))
        used += size
    return shown


@pytest.mark.parametrize(("limit", "budget"), [(None, 40000), (None, 1), (None, 200), (None, 333), (7, 40000), (5, 150), (0, 10), (1, 500), (17, 901)])
def test_caps_over_slabs(corpus, small_slabs, limit, budget):
    events, sessions, ordered, _ = corpus
    got = search.search_hits(events, sessions, "needle", limit=limit, budget=budget)
    expected = _printed(ordered, limit, 0 if limit == 0 else budget)
    assert sorted(tuple(r) for r in got.select("session_id", "seq").collect()) == sorted(expected)


def test_raw_hits_carry_lines_and_ignore_the_budget(corpus):
    events, sessions, ordered, _ = corpus
    got = search.search_hits(events, sessions, "needle", budget=1, raw=True).collect()
    assert len(got) == len(ordered) and {r["line"] for r in got} == {f"line {o[1]}" for o in ordered}


def test_table(corpus):
    events, sessions, ordered, _ = corpus
    now = datetime(2026, 1, 1)
    counts = {s: sum(o[0] == s for o in ordered) for s in ("s1", "s2", "s3", "s4")}
    table = search.search_table(events, sessions, "needle", now).collect()
    assert [(r["session_id"], r["matches"]) for r in table] == sorted(((s, n) for s, n in counts.items() if n), key=lambda x: (-x[1], x[0]))
    whole = search.search_table(events, sessions, "needle", now, include_all=True, sort="started").collect()
    assert [r["session_id"] for r in whole] == ["s4", "s1", "s3", "s2"]
    assert whole[0]["matches"] == whole[0]["first"] == 0
    assert len(search.search_table(events, sessions, "needle", now, limit=1).collect()) == 1
    with pytest.raises(ValueError, match="sort takes"):
        search.search_table(events, sessions, "needle", now, sort="size")


def test_totals_ignore_caps(corpus):
    events, sessions, ordered, _ = corpus
    assert tuple(search.search_totals(events, sessions, "needle").first()) == (len(ordered), 3, 4)
    assert tuple(search.search_totals(events, sessions, "absent").first()) == (0, 0, 4)


def test_matching_sessions(corpus):
    events, sessions, _, _ = corpus
    assert [r["session_id"] for r in search.search_sessions(events, sessions, "needle").collect()] == ["s3", "s2", "s1"]
    assert [r["session_id"] for r in search.search_sessions(events, sessions, "needle", limit=2).collect()] == ["s3", "s2"]
    assert [r["session_id"] for r in search.search_sessions(events, sessions, "needle", budget=4).collect()] == ["s3"]


@pytest.mark.parametrize("budget", [40000, 300, 700, 0])
def test_context_windows(corpus, small_slabs, budget):
    events, sessions, ordered, made = corpus
    got = search.search_context(events, sessions, "needle", 2, budget=budget)
    shown, used = [], 0
    for sid, seq, *_ in ordered:
        near = [m for m in made if m[0] == sid and abs(m[1] - seq) <= 2]
        lines = [f'> {sid} #{m[1]:04d} --:--:-- {m[2]:<5} "{m[4].strip()}"' for m in near] + ["--"]
        size = sum(len(line) + 1 for line in lines)
        if budget and shown and used + size > budget:
            break
        used += size
        shown += [(sid, seq, m[1]) for m in near]
    assert sorted(tuple(r) for r in got.select("session_id", "hit_seq", "seq").collect()) == sorted(shown)
    assert got.where("is_hit AND seq <> hit_seq").count() == 0


@pytest.mark.parametrize(
    ("pattern", "end"), [(r"(?:a|b| )+c", "c"), (r"(a|b|\s)*$", ""), (r"(\w+\s?)+END", "END"), (r"(?:ab?)+x|END", "END")]
)
def test_long_texts_do_not_exhaust_the_stack(spark, pattern, end):
    texts = spark.range(1).select(F.concat(F.repeat(F.lit("ab "), 350_000), F.lit(end)).alias("text"))
    assert texts.where(matches(F.col("text"), pattern)).count() == 1


@pytest.mark.parametrize("pattern", [r"\w", r"\W", r"\s", r"\S", r"\d", r"x\b", r"x\B", r"^\w$", r"\bx", "k", "ß", r"[\w-]+x"])
def test_classes_are_those_of_python_over_all_code_points(spark, pattern):
    points = [*range(0xD800), *range(0xE000, 0x30000)]
    text = F.concat(F.lit("x"), F.col("text")) if "x" in pattern else F.col("text")
    table = spark.createDataFrame([(i, chr(i)) for i in points], "i int, text string")
    found = {r[0] for r in table.where(matches(text, pattern)).select("i").collect()}
    needle = re.compile(pattern, re.I if pattern == pattern.lower() else 0)
    assert found == {i for i in points if needle.search(("x" if "x" in pattern else "") + chr(i))}


@pytest.mark.parametrize("context", [0, 1, 4])
def test_merged_context_over_slabs(corpus, small_slabs, context):
    events, sessions, _, _ = corpus
    got = search.search_context_merged(events, sessions, "needle", context).collect()
    by_session = {}
    for r in events.collect():
        by_session.setdefault(r["session_id"], []).append((r["pos"], "needle" in r["text"]))
    expected = []
    for sid, places in by_session.items():
        hits = [p for p, hit in places if hit]
        group, last = 0, None
        for pos, hit in sorted(places):
            if any(abs(pos - h) <= context for h in hits):
                group += last is None or pos - last > 1
                last = pos
                expected.append((sid, pos, group, hit))
    assert sorted((r["session_id"], r["pos"], r["group"], r["is_hit"]) for r in got) == sorted(expected)


def test_no_cut_passes_one_task(corpus):
    events, sessions, _, _ = corpus
    for job in (search.search_hits(events, sessions, "needle", limit=10_000_000), search.search_context(events, sessions, "needle", 1, limit=7)):
        plan = job._jdf.queryExecution().executedPlan().toString()
        # Every window is within a day's slabs or a slab, but that over the totals of days.
        firsts = re.findall(r"windowspecdefinition\((\w+)#", plan)
        assert firsts and set(firsts) <= {"_group", "path"}


def test_first_errors_read_no_texts(spark, tmp_path, as_events, as_sessions, rows):
    made = as_events(("s", 1, "user", "result", "boom", "Bash", "", True, "c1"), ("s", 2, "user", "result", "again", "Bash", "", True, "c1"), ("s", 3, "user", "result", "x" * 500, "", "", True))
    made.write.parquet(f"{tmp_path}/events")
    events = spark.read.parquet(f"{tmp_path}/events")
    counted = views.errors_by_tool(events, as_sessions(("s", "2026-01-01")))
    assert rows(counted, "tool", "errors") == [("Bash", 1), ("result", 1)]
    schema = [line for line in counted._jdf.queryExecution().toString().splitlines() if "ReadSchema" in line]
    assert schema and not any("text:" in line or "line:" in line for line in schema)
    assert rows(views.error_records(events, 1), "seq", "error_key", "text") == [(1, "c1", "boom")]
