import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from spoolsift.llm import chat
from spoolsift.llm.queries import QUERIES

from tests.compare import database

SF = "/root/testdata/sf0.001"
SAID = "<|im_end|><|im_start|>assistant ok"
COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def digests_by_loops(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        every = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.select(*COLUMNS).collect()}


PARTS = st.lists(st.sampled_from(["<", "|", "\\", ">", "\n", "n", "<|im_start|>", "<|im_end|>", "assistant", "é"]), max_size=12).map("".join)


@given(st.lists(st.tuples(PARTS, PARTS), max_size=5))
def test_the_template_gives_back_what_it_was_given(turns):
    window = "".join(chat.formatted(role, text)[0] for role, text in turns)
    assert [(role, text) for role, text, _, _ in chat.parsed(window)] == turns
    assert window.count(chat.START) == window.count(chat.END) == len(turns)
    for role, text in turns:
        turn, start, end = chat.formatted(role, text)
        assert chat.unescaped(turn[start:end]) == text


@given(st.lists(st.integers(0, 30), min_size=1, max_size=40), st.integers(0, 10), st.integers(1, 60), st.integers(0, 20))
def test_spans_are_whole_turns_within_the_budget(tokens, system, budget, history):
    at = 0
    for back, first, end in chat.spans(tokens, 0, system, budget, history):
        assert first == at and back <= first < end
        assert sum(tokens[back:first]) <= history and first - back <= chat.REPEATED
        size = system + sum(tokens[back:end])
        assert size <= budget or (end == first + 1 and back == first)
        # No more history, and no more turns, would have fitted.
        assert end == len(tokens) or size + tokens[end] > budget
        if back == first > 0 and first >= 1 and system + sum(tokens[first - 1 : first + 1]) <= budget:
            assert tokens[first - 1] > history or chat.REPEATED == 0
        at = end
    assert at == len(tokens)


def test_history_is_shortened_where_all_of_it_leaves_no_room():
    assert list(chat.spans([1, 0, 1], 0, 0, 1, 1)) == [(0, 0, 2), (1, 2, 3)]
    assert list(chat.spans([5, 2, 8], 0, 0, 10, 7)) == [(0, 0, 2), (1, 2, 3)]
    assert list(chat.spans([5, 2, 9], 0, 1, 10, 7)) == [(0, 0, 2), (2, 2, 3)]


ODD_ROWS = [
    *[(1, k, "system" if k == 0 else ("assistant", "user")[k % 2], f"turn {k} " + "word " * (k % 9)) for k in range(40)],
    (2, 0, "user", SAID),
    (2, 1, "assistant", SAID),
    (3, None, None, None),
    (3, None, "assistant", "no number"),
    (3, 5, "assistant", None),
    (3, 5, "assistant", ""),
    (4, 0, "assistant", "same"),
    (4, 0, "assistant", "same"),
    (4, 1, "a\nrole\\n<|", "text ends in <"),
    (5, 0, "assistant", "é世\U0001f600" * 20_000),
    (5, 1, "user", "after a long one"),
    (None, 0, "system", "no id"),
    (None, 1, "assistant", "still there"),
    (6, 0, "system", "only a system turn"),
    (7, 0, "system", "long " * 300),
    (7, 1, "system", "two"),
    (7, 2, "assistant", "three"),
    *[(8, k, "system" if k == 0 else "assistant", f"{k}") for k in range(16)],
]


@pytest.mark.parametrize("block", [8, chat.BLOCK])
def test_odd_rows(spark, vocabularies, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = spark.createDataFrame(ODD_ROWS, "conv_id long, turn long, role string, text string").repartition(3)
    rows = rows.withColumns({n: F.lit(f"own {n}") for n in ("_place", "_block", "tokens", "_row", "_slab", "first_turn", "loss")})
    windows = chat.chat_windows(rows, vocabularies["byte_bpe_50k.json"], budget=60, history=20).cache()
    # Turns with one number come by the hash of their content.
    expected = digests_by_loops([r for r in ODD_ROWS if r[0] != 3])
    got = found(chat.digests(windows))
    assert {c: v for c, v in got.items() if c != 3} == expected
    assert got[3][0] == 4 and got[3][2] == len("no number")
    seen = defaultdict(list)
    for r in sorted(windows.collect(), key=lambda r: (r.conv_id or 0, r.first_turn)):
        turns = [(role, text) for role, text, _, _ in chat.parsed(r.text)]
        assert len(turns) == r.repeated + r.turns
        assert r.tokens <= 60 or r.turns == 1
        source = [(role or "", text or "") for c, _, role, text in ODD_ROWS if c == r.conv_id]
        if r.conv_id != 3:
            # The system turn, then an unbroken row of turns that ends with the new ones.
            own = [t for t in turns]
            if source[0][0] == "system" and r.first_turn > 0:
                assert own.pop(0) == source[0]
            assert own == source[r.first_turn + r.turns - len(own) : r.first_turn + r.turns]
        seen[r.conv_id].append(r.turns)
    assert {c: sum(n) for c, n in seen.items()} == {c: v[0] for c, v in got.items()}
    back = chat.turns_of(windows).where("conv_id = 8").orderBy("place").collect()
    assert [(b.place, b.text, b.learnt) for b in back] == [(k, str(k), str(k) if k else None) for k in range(16)]
    assert chat.chat_windows(rows.where("false"), vocabularies["byte_bpe_50k.json"]).count() == 0


def test_windows_that_were_changed_are_noticed():
    turn, start, end = chat.formatted("assistant", "text")
    assert list(chat.new_turns(0, 0, turn, [{"start": start, "length": end - start}])) == [(0, "assistant", "text", "text")]
    for loss, repeated in (([{"start": 3, "length": 2}], 0), ([{"start": start, "length": 4}], 1)):
        with pytest.raises(ValueError):
            list(chat.new_turns(0, repeated, turn, loss))


def test_op11(spark):
    rows = database(SF).execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    rows += [(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)]
    result = QUERIES["op11_chat_windows"](spark, SF).cache()
    assert found(result) == digests_by_loops(rows)
    assert result.where("formatted_chars <= loss_chars").count() == 0


def test_one_long_conversation_is_spread(spark, vocabularies):
    rng = random.Random(9)
    rows = [(1, 3 * k, "system" if k == 0 else rng.choice(["user", "assistant"]), f"{k} " * rng.randrange(20)) for k in range(3_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.chat_windows(df, vocabularies["byte_bpe_50k.json"], budget=300, history=60)
    assert found(chat.digests(windows)) == digests_by_loops(rows)
    assert windows.where("tokens > 300").count() == 0
    assert windows.where("first_turn > 0 and repeated < 2").count() == 0
