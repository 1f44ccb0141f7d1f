import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from spoolsift.llm import repair
from spoolsift.llm.queries import QUERIES

from tests.compare import database

SF = "/root/testdata/sf0.001"
FORM = re.compile(r"(s?(ua)+)?")
BARE = " \t\n\x0b\x0c\r"


def every_way(rows, most_inserts=2):
    """(cost, audit, repaired roles) of the cheapest edits, by trying all."""
    found = []
    slots = [[w for n in range(most_inserts + 1) for w in itertools.product("ua", repeat=n)]] * (len(rows) + 1)
    for choice in itertools.product(*[[("K", r[0]), ("R", "u"), ("R", "a"), ("D", "")] for r in rows]):
        for inserts in itertools.product(*slots):
            cost, audit, roles = 0, "", ""
            for k in range(len(rows) + 1):
                audit, roles, cost = audit + "I" * len(inserts[k]), roles + "".join(inserts[k]), cost + 3 * len(inserts[k])
                if k < len(rows):
                    (edit, role), (_, fault) = choice[k], rows[k]
                    if fault in (1, 2) and edit != "D":
                        break
                    audit, roles, cost = audit + edit, roles + role, cost + {"K": 0, "R": 3, "D": 4}[edit] + 3 * (fault == 3 and edit != "D")
            else:
                if FORM.fullmatch(roles):
                    found.append((cost, audit, roles))
    return min(found)


def plain_ways(rows):
    """(cost, audit) by the same steps on whole strings."""
    leads = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    def offer(best, state, way):
        best[state] = min(best.get(state, way), way)

    def inserted(best):
        for _ in range(2):
            for state, (cost, text) in list(best.items()):
                offer(best, after[state], (cost + 3, text + "I"))
        return best

    best = {0: (0, "")}
    for initial, fault in rows:
        new = {}
        for state, (cost, text) in inserted(best).items():
            offer(new, state, (cost + 4, text + "D"))
            if fault not in (1, 2):
                if (state, initial) in leads:
                    offer(new, leads[state, initial], (cost + 3 * (fault == 3), text + "K"))
                offer(new, after[state], (cost + 3 + 3 * (fault == 3), text + "R"))
        best = new
    best = inserted(best)
    return min(best[s] for s in (0, 3) if s in best)


def damaged_by_loops(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        rule = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if rule == 0:
            continue
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        out += [(conv, turn, "user" if rule == 4 else role, text)] * (2 if rule == 3 else 1)
    return out


def repaired_by_loops(rows):
    """The columns of the result by conversation."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role, text))
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked, faults = set(), [], [0] * 4
        for _, role, text in turns:
            bare = text.strip(BARE)
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role[:1], fault))
        cost, audit = plain_ways(marked)
        lines, left = [], iter(turns)
        for edit in audit:
            row = next(left) if edit != "I" else None
            if edit == "D":
                continue
            here = row[1] if edit == "K" else None
            if here is None:
                here = "assistant" if lines and lines[-1][0][:1] == "u" else "user"
            lines.append((here, row[2] if row else ""))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        numbers = {t for t, _, _ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        out[conv] = (gaps, *faults[1:], illegal, cost, audit, digest)
    return out


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.select(*COLUMNS).collect()}


@pytest.mark.parametrize("seed", range(40))
def test_cheapest_and_least_of_all_ways(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("suuaax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(4))]
    cost, audit, _ = every_way(rows)
    assert repair.best_edits(rows) == (cost, audit) == plain_ways(rows)


@pytest.mark.parametrize("seed", range(20))
def test_runs_of_any_length_join_to_the_same(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("suuaax"), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(200))]
    expected = plain_ways(rows)
    for length in (1, 2, 7, 1000):
        joined = repair.Joined()
        for at in range(0, len(rows), length):
            joined.add(repair.run_ways(rows[at : at + length], range(4)))
        assert joined.end() == expected


def test_hashes_that_collide_do_not_decide(monkeypatch):
    monkeypatch.setattr(repair, "MODULUS", 3)
    rng = random.Random(4)
    for _ in range(30):
        rows = [(rng.choice("suuaax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(60)]
        assert repair.best_edits(rows) == plain_ways(rows)


def test_strings_compare_as_text():
    rng = random.Random(5)
    edits = repair.Edits()
    nodes = [0]
    for _ in range(400):
        nodes.append(edits.add(rng.choice(nodes[-20:]), ord(rng.choice("DI"))))
    for a, b in rng.choices(list(itertools.product(nodes, nodes)), k=3000):
        assert edits.smaller(a, b) == (edits.text(a) < edits.text(b))


ODD_ROWS = [
    *[(1, k, ("user", "assistant")[k % 2], f"Text {k}.") for k in range(30)],
    *[(2, k, "user", "ok") for k in range(12)],
    *[(2, k, "user", "ok") for k in range(12)],
    *[(3, None, "assistant", f"No turn {k}") for k in range(5)],
    *[(None, k, "system" if k == 0 else "tool", f"Who?\t{k}") for k in range(8)],
    (4, 0, None, None),
    (4, None, None, ""),
    (4, 7, "", "An empty role."),
    (4, 9, "user", " \t\r\n\x0b\x0c"),
    (4, 100, "assistant", "é" * 300_000 + "!"),
    (None, None, None, None),
    (5, 0, "system", "One."),
]


@pytest.mark.parametrize("run", [3, repair.RUN])
def test_odd_rows(spark, monkeypatch, run):
    monkeypatch.setattr(repair, "RUN", run)
    rows = spark.createDataFrame(ODD_ROWS, "conv_id long, turn long, role string, text string").repartition(3)
    rows = rows.withColumns({n: F.lit(f"own {n}") for n in ("_row", "fault", "initial", "audit", "_text", "part", "_rule")})
    assert found(repair.repair(rows)) == repaired_by_loops([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ODD_ROWS])
    expected = repaired_by_loops(damaged_by_loops(ODD_ROWS))
    gone = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(repair.damaged_and_repaired(rows)) == {c: expected.get(c, gone) for c, *_ in ODD_ROWS}
    assert repair.damaged_and_repaired(rows.where("false")).count() == 0


def test_op12(spark):
    rows = database(SF).execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    expected = repaired_by_loops(damaged_by_loops(rows))
    gone = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(QUERIES["op12_conversation_repair"](spark, SF)) == {c: expected.get(c, gone) for c, *_ in rows}


def test_one_long_conversation_is_spread(spark):
    rng = random.Random(6)
    rows = [(1, k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", f"No {k}", f"Maybe {k}!"])) for k in range(12_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(repair.repair(df)) == repaired_by_loops(rows)
