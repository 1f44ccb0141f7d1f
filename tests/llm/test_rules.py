import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spoolsift.llm import licenses, quality, toxicity

from . import brute, brute_toxicity
from .conftest import ODD


def test_licence_places(spark):
    text = (
        "Mit license. MIT\nLicense! Permission is hereby granted, free of charge, to any person obtaining a copy of THIS thing. "
        "mit-license mitlicense mit lic ense general public license general public general public license"
    )
    docs = spark.createDataFrame([(1, text), (2, "permission is hereby granted free of charge"), (3, "license mit")], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.licenses(docs).collect()}
    places = [(p.start, p.label) for p in rows[1].places]
    words = brute.TERM.findall(brute.lower(text))
    expected = []
    for t in licenses.TEMPLATES:
        phrase = t.phrase.split()
        expected += [(i, t.label) for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    assert places == sorted(expected)
    # The rest of the template is missing in the second text, so its share is too small.
    assert rows[2].places == [] and rows[3].places == [] and rows[3].n_words == 2


def test_licences_of_odd_rows(odd_docs, no_docs):
    rows = licenses.licenses(odd_docs).collect()
    assert sorted((r.doc_id or -1, r.n_words) for r in rows) == sorted(
        (i or -1, len(brute.TERM.findall(brute.lower(t)))) for i, t in ODD
    )
    labels = {r.doc_id: [p.label for p in r.places] for r in rows}
    assert labels[10] == ["mit", "apache", "gpl"] and not labels[9]
    assert licenses.licenses(no_docs).count() == 0
    plan = licenses.licenses(odd_docs)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def repetition_by_loops(text):
    words = brute.WORD.findall(text or "")
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or ""))}
    lines = [line for line in (text or "").split("\n") if brute.WORD.search(line)]
    out["n_lines"], out["n_dup_lines"] = len(lines), len(lines) - len(set(lines))
    out["dup_line_chars"] = sum(len(line) for line, n in Counter(lines).items() for _ in range(n - 1))
    for n in range(2, 11):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        counts, seen, later, twice = Counter(grams), set(), set(), set()
        for i, g in enumerate(grams):
            if g in seen:
                later.update(range(i, i + n))
            if counts[g] > 1:
                twice.update(range(i, i + n))
            seen.add(g)
        if n == 3:
            out["n_repeat_words"] = len(twice)
        if n in quality.TOP_RUNS:
            out[f"top_{n}_chars"] = max((c * len("".join(g)) for g, c in counts.items() if c > 1), default=0)
        if n in quality.REPEATED_RUNS:
            out[f"dup_{n}_chars"] = sum(len(words[i]) for i in later)
    return out


def test_repetition_as_by_loops():
    rng = random.Random(6)
    texts = [None, "", " \n "]
    for _ in range(60):
        texts.append("".join(f"{rng.choice('ab')}{rng.choice(['', 'é', '世|', '#'])}{rng.choice(['  ', ' ', chr(10)])}" for _ in range(rng.randrange(60))))
    found = quality.measure(texts, quality.table(False, False))
    for text, row in zip(texts, found.to_dict("records")):
        assert row == repetition_by_loops(text), text


def test_repetition_of_odd_rows(odd_docs, no_docs):
    found = quality.repetition(odd_docs)
    assert set(found.columns) == {*odd_docs.columns, "repetition"}
    rows = found.select("doc_id", "text", "kept", "repetition").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.repetition.asDict() == repetition_by_loops(r.text)
    kept = {r.doc_id: r.kept for r in rows}
    assert not kept[12] and not kept[11] and kept[8] and kept[1] and kept[2]
    assert quality.repetition(no_docs).count() == 0


def labelled(spark, n=400, seed=3):
    """Invented words; a few of them, some spelt with digits or other alphabets, make a text toxic."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"{rng.choice(['ba', 'ko', 'mi', 'tu'])}{rng.choice(['ra', 'le', 'no'])}{rng.choice(['s', 'n', 'x', ''])}" for _ in range(rng.randrange(5, 80))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            bad = rng.choice(["vorgle", "Vorglesk", "snerpit", "vorgleam", "sn3rp1t", "vоrglе"])
            for _ in range(1 + len(words) // 20):
                words.insert(rng.randrange(len(words)), bad)
        elif rng.random() < 0.04:
            words.insert(3, "snerpit birds")
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_toxic_words_are_learnt_and_held_out_rows_judged(spark):
    docs, labels = labelled(spark)
    model = toxicity.learn(docs, labels)
    assert any(e.startswith(" vorg") for e in model.weights) and any(e.startswith(" sner") for e in model.weights)
    assert "snerpit birds" in model.exceptions
    judged = toxicity.toxicity(docs, model).join(labels, "doc_id").where(~toxicity.training_rows(F.col("doc_id"))).collect()
    assert len(judged) > 60
    right = sum((r.toxicity >= 0.3) == bool(r.toxic) for r in judged)
    assert right >= 0.95 * len(judged)


def test_words_exceptions_and_scores_as_by_loops(spark):
    docs, labels = labelled(spark, 600)
    model = toxicity.learn(docs, labels, ())
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    weights, exceptions, scores = brute_toxicity.scores(texts, labels.collect())
    assert model.weights == pytest.approx(weights) and len(weights) > 1
    assert set(model.exceptions) == exceptions == {"snerpit birds"}
    found = {r.doc_id: r.toxicity for r in toxicity.toxicity(docs, model).collect()}
    assert found == pytest.approx(scores, abs=1e-6)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = labelled(spark, 150)
    other = labels.withColumn("toxic", F.when(toxicity.training_rows(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert toxicity.learn(docs, labels) == toxicity.learn(docs, other)


def test_folding(spark):
    texts = ["Id1ot! 1D10T", "іdіоt", "ｉｄｉｏｔ", "id​iot", "in 2024, 5 of 7", None, "wow! (yes)", "$cum a$ @t"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [r[0] for r in docs.select(toxicity.folded(F.col("text"))).collect()]
    assert found[0] == " idiot idiot " and found[1:4] == [" idiot "] * 3
    assert found[4].split() == ["in", "of"] and found[5].strip() == "" and found[6] == " wow yes "
    assert found[7] == " scum as at "


def test_exceptions_do_not_count():
    matcher = toxicity.Matcher(toxicity.Model({" kill": 3.0, " idiot ": 2.0}, ("killing time",)))
    assert matcher.matches(" killing time ") == []
    assert matcher.matches(" killing times idiot ") == [(0, 3.0), (14, 2.0)]


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    docs, labels = labelled(spark, 150)
    model = toxicity.learn(docs, labels)
    found = toxicity.toxicity(odd_docs, model)
    assert set(found.columns) == set(odd_docs.columns)
    assert {r.toxicity < 0.3 for r in found.collect()} == {True}
    assert toxicity.toxicity(no_docs, model).count() == 0
    nulls = labels.withColumn("toxic", F.lit(None).cast("int"))
    for empty in (toxicity.learn(no_docs, labels), toxicity.learn(docs, labels.where("false")), toxicity.learn(docs, nulls)):
        assert empty == toxicity.Model()
        assert {r.toxicity for r in toxicity.toxicity(odd_docs, empty).collect()} == {0.0}


def test_a_word_of_many_texts_is_learnt_though_clean_texts_hold_it(spark):
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        words = ["".join(rng.choice("klmnprst") for _ in range(6)) for _ in range(4)]
        toxic = int(i % 10 < 3)
        if toxic or rng.random() < 0.12:
            words.insert(2, "vorgle")
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert any(e.startswith(" vorg") for e in toxicity.learn(docs, labels).weights)


def test_rare_words_and_exceptions_are_kept_by_rates(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_ENTRIES", 3, raising=False)
    monkeypatch.setattr(toxicity, "ENTRIES_A_PASS", 2, raising=False)
    rng = random.Random(8)
    rows, copied = [], None
    for i in range(1500):
        words = ["".join(rng.choice("klmnprst") for _ in range(6)) for _ in range(5)]
        toxic = int(i % 10 < 3)
        if toxic:
            words.insert(2, "snerpitz" if i % 50 == 1 else "vorgle")
            words.insert(3, "birds" if i == 100 else words[0][::-1])
        elif i % 20 == 5:
            words[2:2] = ["vorgle", "birds"]
        elif i % 150 == 7:
            words[2:2] = ["snerpitz", "quux"]
            copied = words = copied or words
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert any(e.startswith(" sner") for e in model.weights) and any(e.startswith(" vorg") for e in model.weights)
    assert "vorgle birds" in model.exceptions and "snerpitz quux" not in model.exceptions


def test_entries_that_begin_alike_are_chosen_as_by_loops(spark):
    rng = random.Random(2)
    found = {}
    for _ in range(60):
        word = "ab" + "".join(rng.choice("xy") for _ in range(rng.randrange(1, 9)))
        for entry in (f" {word} ", *(f" {word[:n]}" for n in toxicity.PREFIXES if len(word) >= n)):
            found[entry] = rng.randrange(4, 12), rng.choice((2.0, 2.2, 2.4, 2.8, 3.0))
    left = dict(found)
    for entry, (texts, weight) in found.items():
        for n in range(2, len(entry)):
            shorter = found.get(entry[:n])
            if shorter and texts >= 0.7 * shorter[0] and weight > shorter[1] + 0.3:
                left.pop(entry[:n], None)
    expected = {e for e, (_, w) in left.items() if not any(left.get(e[:n], (0, -1.0))[1] >= w - 0.5 for n in range(2, len(e)))}
    table = spark.createDataFrame([(e, *v) for e, v in found.items()], "entry string, t long, weight double")
    assert {r.entry for r in toxicity._chosen(table).collect()} == expected and 5 < len(expected) < len(found)


def test_entries_in_several_automata_match_as_in_one(monkeypatch):
    model = toxicity.Model({" kill": 3.0, " killer ": 4.0, " idiot ": 2.0, " dumb": 1.0}, ("killing time", "dumb luck", "idiot"))
    texts = [" killing time ", " killer dumb luck dumber ", " idiot ", "", " killing "]
    whole = toxicity.Matcher(model).matches_of(texts)
    assert whole == [[], [(0, 4.0), (17, 1.0)], [], [], [(0, 3.0)]]
    for n in (1, 2, 3):
        monkeypatch.setattr(toxicity, "ENTRIES_A_PASS", n)
        assert toxicity.Matcher(model).matches_of(texts) == whole
