import random

import numpy as np
import pytest

from spoolsift.llm import decontamination, minhash, substrings
from spoolsift.llm.words import Words, runs, table

from . import brute
from .conftest import ODD, OTHER, PASSAGE


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def sentences(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_words_are_those_of_a_regex():
    rng = random.Random(1)
    for letters, pattern, lower in ((table(True, True), brute.TERM, True), (table(False, False), brute.WORD, False)):
        texts = ["".join(rng.choice("aB1 \n\té世-_.\x00\x1c") for _ in range(rng.randrange(30))) for _ in range(50)]
        words = Words([t.encode() for t in texts], letters)
        expected = [pattern.findall(brute.lower(t) if lower else t) for t in texts]
        flat = [w for row in expected for w in row]
        assert [words.sequence(i, 1).decode() for i in range(len(words))] == flat
        assert words.per_text.tolist() == [len(row) for row in expected]
        hashes = words.hashes()
        for n in (1, 2, 3, 5, 50):
            found = runs(hashes, n)
            assert len(set(found.tolist())) == len({tuple(flat[i : i + n]) for i in range(len(flat) - n + 1)})
            assert words.valid(n).sum() == sum(max(0, len(row) - n + 1) for row in expected)


def test_least_of_sliding_places():
    values = np.random.default_rng(1).integers(0, 99, 60).astype(np.uint64)
    for n in (1, 2, 3, 31, 41, 60, 61):
        assert substrings.sliding_least(values, n).tolist() == [min(values[i : i + n]) for i in range(60 - n + 1)]


@pytest.fixture(scope="module")
def mixed():
    """Passages shared by many documents, parts of them, near copies, periodic texts and one very common line."""
    rng = random.Random(4)
    shared = [sentences(rng, rng.randrange(40, 120), 10**6) for _ in range(6)]
    base = sentences(rng, 150, 10**6)
    rows = []
    for i in range(150):
        words = sentences(rng, rng.randrange(0, 60))
        for part in rng.sample(shared, rng.randrange(0, 3)):
            cut = rng.randrange(0, 30)
            words += part[cut:] + sentences(rng, rng.randrange(0, 9))
        if i % 5 == 0:
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        if i % 11 == 0:
            words = ["again"] * rng.randrange(40, 200)
        rows.append((i * 7 % 151, " ".join(words).replace("w1 ", "W1\n")))
    return rows


def test_passages_go_as_by_loops(spark, mixed, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_BYTES", 400)
    monkeypatch.setattr(substrings, "SPLIT_BYTES", 2000)
    rows = substrings.repeats(frame(spark, mixed)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == sorted(brute.repeats(mixed))
    assert all(sum(s["end"] - s["start"] for s in r.spans) == r.n_removed for r in rows)


def test_phrases_of_a_long_text_are_dealt_to_several_shards(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_BYTES", 2000)
    monkeypatch.setattr(substrings, "DOCUMENT_BYTES", 2000)
    sizes = []

    def keep(self, df, name):
        if name == "recurring":
            sizes.extend(df.groupBy("first", "block").count().collect())
        return plain(self, df, name)

    plain = substrings.Scratch.keep
    monkeypatch.setattr(substrings.Scratch, "keep", keep)
    rng = random.Random(3)
    words = sentences(rng, 6000, 10**6)
    docs = [(1, " ".join(words)), (2, " ".join([*words[:3000], "between", *words[3000:]])), (3, " ".join(words[100:180])), (4, "apart " * 60)]
    rows = substrings.repeats(frame(spark, docs)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == sorted(brute.repeats(docs))
    assert len(sizes) > 5 and max(row["count"] for row in sizes) * 80 < 2 * 2000


def test_a_window_holds_a_phrase(spark):
    docs = [(1, "a b c d e f g h i j k l"), (2, "x a b c d e f g h i j k l")]
    rows = substrings.repeats(frame(spark, docs), window=10, phrase=10).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {1: 0, 2: 12}
    with pytest.raises(ValueError, match="no phrase"):
        substrings.repeats(frame(spark, docs), window=5)


def test_passages_of_odd_rows(odd_docs, no_docs):
    rows = substrings.repeats(odd_docs).collect()
    found = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in rows)
    assert found == sorted((i or -1, *rest) for i, *rest in brute.repeats(ODD))
    cut = substrings.without_repeats(odd_docs)
    assert cut.columns == odd_docs.columns
    texts = {(r.doc_id, r.text) for r in cut.collect()}
    assert (5, PASSAGE) in texts and (None, PASSAGE) in texts and (None, None) in texts and (2, "") in texts
    assert (6, OTHER) in texts and not any(i in (7, 13) for i, _ in texts)
    assert substrings.repeats(no_docs).count() == 0 and substrings.without_repeats(no_docs).count() == 0


def test_passages_of_different_texts_under_one_id(spark):
    rng = random.Random(7)
    a, b = (" ".join(sentences(rng, 55, 10**6)) for _ in range(2))
    docs = [(1, a), (5, f"{a} and more"), (5, f"only {b}"), (9, b), (5, f"{b} then {a}")]
    rows = substrings.repeats(frame(spark, docs)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == sorted(brute.repeats(docs))


def test_windows_of_items_are_found_as_by_loops(spark, mixed, monkeypatch):
    texts = [t for _, t in mixed]
    items = [(i, " ".join(texts[i].split()[5 : 5 + n])) for i, n in enumerate((0, 1, 2, 4, 12, 13, 14, 40, 60, 60))]
    items += [(20, items[8][1]), (21, None), (22, " .-. "), (23, items[7][1].upper()), (None, texts[50])]
    expected = sorted(brute.contamination(mixed, [x for x in items if x[0] is not None]))
    assert sum(e[2] > 0 for e in expected) > 20
    table_ = spark.createDataFrame(items, "item_id long, text string")
    for bits, chunk in ((1 << 27, 10_000), (64, 3)):
        monkeypatch.setattr(decontamination, "FILTER_BITS", bits)
        monkeypatch.setattr(decontamination, "CHUNK", chunk)
        rows = decontamination.contamination(frame(spark, mixed), table_).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in rows) == expected


def test_one_word_again_and_again_is_hit_throughout(spark):
    docs = [(i, "the " * n) for i, n in ((1, 5000), (2, 12), (3, 13), (4, 1))] + [(5, "the " * 20 + "end"), (5, "the " * 20 + "end")]
    items = [(1, "the " * 30), (2, "the"), (3, "THE the the"), (4, "the " * 12 + "end")]
    rows = decontamination.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in rows) == sorted(brute.contamination(docs, items))


def test_contamination_of_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    items = spark.createDataFrame([(1, PASSAGE), (2, "One two three")], "item_id long, text string")
    expected = sorted((i or -1, *rest) for i, *rest in brute.contamination(ODD, [(1, PASSAGE), (2, "One two three")]))
    for bits, chunk in ((1 << 27, 10_000), (64, 3)):
        monkeypatch.setattr(decontamination, "FILTER_BITS", bits)
        monkeypatch.setattr(decontamination, "CHUNK", chunk)
        rows = decontamination.contamination(odd_docs, items).collect()
        assert sorted((r.doc_id or -1, r.n_words, r.n_hit, list(r["items"])) for r in rows) == expected
    assert decontamination.contamination(no_docs, items).count() == 0
    rows = decontamination.contamination(odd_docs, items.where("false")).collect()
    assert len(rows) == len(ODD) and not any(r.n_hit for r in rows)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    one, two = pool[:2000], pool[500:2500]
    a, b = minhash.signatures([one, two], 512)
    assert abs((a == b).mean() - 1500 / 2500) < 0.08


def test_near_documents_as_by_loops(spark, mixed):
    rows = minhash.near_duplicates(frame(spark, mixed), percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == brute.components(mixed, 85)


def test_chains_and_leftovers_are_joined(spark):
    """Copies of copies: the ends of a chain are far apart, and a hot group's members are near in pairs only."""
    rng = random.Random(9)
    words = sentences(rng, 120, 10**6)
    rows = []
    for i in range(60):
        rows.append((100 - i, " ".join(words)))
        words = list(words)
        words[rng.randrange(len(words))] = f"edit{i}"
    base = sentences(rng, 120, 10**6)
    for i in range(200, 260):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.choice((3, 30, 60, 90, 110))] = f"edit{rng.randrange(9)}"
        rows.append((i, " ".join(copy)))
    found = minhash.near_duplicates(frame(spark, rows), percent=85).collect()
    expected = brute.components(rows, 85)
    assert len({e[2] for e in expected}) < 30
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == expected


def test_near_documents_of_odd_rows(odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert len(rows) == len(ODD)
    assert by_id[1] == by_id[2][:0] + [(0, 1, True)] and by_id[3] == [(0, 3, True)]
    assert by_id[7] == [(96, 5, False)] * 2 and by_id[5] == [(96, 5, True)]
    assert sorted(by_id[None]) == [(0, None, True), (96, None, True)]
    assert by_id[4] == [(1, 4, True)] and by_id[13] == [(1, 12, False)]
    assert minhash.near_duplicates(no_docs).count() == 0
