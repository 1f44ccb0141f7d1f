"""Substring deduplication: words in passages that a document with a smaller id holds as well.

1. Every window of ``window`` words is stood for by the smallest hash of the short phrases in it. Equal windows have
   equal phrases, and neighbours mostly share theirs, so a document has few. A phrase of two documents or more may
   belong to a recurring passage.
2. The words of these phrases are compiled into Aho-Corasick automata, sharded by the first document that has the phrase; the
   phrases of a very long one are dealt to several shards.
   A document is sent only to the shards of its phrases; the texts of a shard in demand are split, its phrases copied.
3. Each automaton reads its texts and gives every place of every phrase. The windows these phrases stand for are
   confirmed: those that start in a document with a smaller id are removed there.

Documents with the same words are found by a digest first, and only the first of them takes part.
"""

import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolsift.llm import words
from spoolsift.llm.tables import Scratch, text_key
from spoolsift.llm.words import Words, grouped, runs, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(words)

WINDOW = 50
PHRASE = 10
# Bytes of phrases in one automaton (some 60 bytes of memory each) and of texts that one task reads with it.
SHARD_BYTES = 512 << 10
# Bytes of phrases of one document that may meet in one shard. A text is copied to as many shards as hold its phrases: about
# every 21st word begins one, of 80 bytes or so; a text of 20 MB and 3.3 million words has 13 MB of them and is the first in 7 shards.
DOCUMENT_BYTES = 2 << 20
SPLIT_BYTES = 8 << 20

LETTERS = table(letters_and_digits=False, lower=False)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPANS = "array<struct<start:long,end:long>>"
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def digest(raw) -> str:
    return hashlib.sha256(raw).hexdigest()


def sliding_least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` values in a row, by doubling."""
    if len(values) < n:
        return values[:0]
    part, size = values, 1
    while 2 * size <= n:
        part = np.minimum(part[: len(part) - size], part[size:])
        size *= 2
    count = len(values) - n + 1
    return np.minimum(part[:count], part[n - size : n - size + count])


def _phrases(hashes: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the phrase at each place, and for each window the hash of the one that stands for it."""
    each = runs(hashes, phrase)
    return each, sliding_least(each, window - phrase + 1)


def profiles(docs: DataFrame, text: str, window: int, phrase: int) -> DataFrame:
    """doc_id, _key (hash of the text), n_words, words_sha256 (of the words joined by blanks), phrases (distinct hashes)."""

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for begin, group in grouped([t if isinstance(t, str) else None for t in batch["text"]]):
                w = Words(group, LETTERS)
                _, least = _phrases(w.hashes(), window, phrase)
                for i in range(len(group)):
                    first, last = int(w.first[i]), int(w.first[i + 1])
                    words_digest = digest(w.sequence(first, last - first) if last > first else b"")
                    mine = np.unique(least[first : last - window + 1]) if last - first >= window else least[:0]
                    rows.append((batch["_key"].iloc[begin + i], last - first, words_digest, mine.view(np.int64)))
            frame = pd.DataFrame(rows, columns=["_key", "n_words", "words_sha256", "phrases"])
            yield frame.assign(doc_id=batch["doc_id"].astype("Int64").to_numpy()).astype({"doc_id": "Int64"})

    return _keyed(docs, text).mapInPandas(
        profile, "doc_id long, _key long, n_words long, words_sha256 string, phrases array<long>"
    )


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("_key"), F.col(text).alias("text"))


def _phrase_words(texts: DataFrame, phrase: int) -> DataFrame:
    """phrase (hash), shard, words of every phrase that a document is the first to have."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, own in zip(batch["text"], batch["own"]):
                w = Words([text.encode("utf-8", "surrogatepass")], LETTERS)
                each = runs(w.hashes(), phrase).view(np.int64)
                found, at = np.unique(each, return_index=True)
                own = np.asarray(own, np.int64)
                for hash_, place in zip(own, at[np.searchsorted(found, own)]):
                    rows.append((hash_, w.sequence(int(place), phrase)))
            yield pd.DataFrame(rows, columns=["phrase", "words"])

    return texts.where(F.size("own") > 0).select("text", "own").mapInPandas(cut, "phrase long, words binary")


def _locate(texts: pd.DataFrame, phrases: pd.DataFrame, window: int, phrase: int) -> pd.DataFrame:
    """Windows (hash, hash of their phrase) of each document whose phrase the automaton finds in it."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for found, hash_ in zip(phrases["words"], phrases["phrase"]):
        machine.add_word(" " + bytes(found).decode("latin-1") + " ", int(hash_))
    columns = {"window": [], "phrase": [], "doc_id": []}
    if len(machine):
        machine.make_automaton()
        for begin, group in grouped(list(texts["text"])):
            w = Words(group, LETTERS)
            ids = texts["doc_id"].to_numpy(np.int64)[begin : begin + len(group)]
            hashes = w.hashes()
            each, least = _phrases(hashes, window, phrase)
            if not len(least):
                continue
            ends = [end for end, _ in machine.iter(" " + w.norm.tobytes().decode("latin-1"))]
            # With the blank in front, a match ends one byte later: right behind its last word.
            last = np.searchsorted(w.ends, np.array(ends, np.int64) - 1)
            there = np.full(len(each), MOST)
            places = np.unique(last - phrase + 1)
            there[places] = each[places]
            located = (sliding_least(there, window - phrase + 1) == least) & w.valid(window)
            at = np.flatnonzero(located)
            owner = np.repeat(ids, w.per_text)[at]
            frame = pd.DataFrame({"window": runs(hashes, window)[at].view(np.int64), "phrase": least[at].view(np.int64), "doc_id": owner})
            for name, values in frame.drop_duplicates().items():
                columns[name].append(values.to_numpy())
    return pd.DataFrame({name: np.concatenate(v) if v else np.zeros(0, np.int64) for name, v in columns.items()})


def _removed(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Spans of words inside the windows given for each text, and the digest of the words outside."""
    for batch in batches:
        rows = []
        for doc_id, text, gone in zip(batch["doc_id"], batch["text"], batch["windows"]):
            w = Words([text.encode("utf-8", "surrogatepass")], LETTERS)
            starts = np.flatnonzero(np.isin(runs(w.hashes(), window).view(np.int64), np.asarray(gone, np.int64)))
            # Another text of the same id may hold the windows, and this one none of them.
            breaks = np.flatnonzero(np.diff(starts) > window)
            firsts, lasts = np.concatenate([starts[:1], starts[breaks + 1]]), np.concatenate([starts[breaks], starts[-1:]])
            spans = [{"start": int(a), "end": int(b) + window} for a, b in zip(firsts, lasts)]
            edges = [0, *(e for s in spans for e in (s["start"], s["end"])), len(w)]
            left = [w.sequence(a, b - a) for a, b in zip(edges[::2], edges[1::2]) if b > a]
            n = sum(s["end"] - s["start"] for s in spans)
            rows.append((digest(w.norm[:-1]), doc_id, spans, n, digest(b" ".join(left))))
        yield pd.DataFrame(rows, columns=["words_sha256", "doc_id", "spans", "n_removed", "kept_sha256"])


def repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """One row per document row: doc_id, _key (hash of the text), n_words, n_removed, spans, kept_sha256.

    ``spans``: disjoint (start, end) places of the words inside a window of ``window`` words that also starts in a document with a
    smaller doc_id, in order; ``kept_sha256``: digest of the words outside, joined by blanks. Words are what white space
    separates; a null or empty text has none and nothing removed. Rows of one id are one document to each other: their
    windows are not removed on account of each other. A row without id removes nothing and has nothing removed. Repeated rows give
    repeated rows; an empty table gives an empty one. Long texts are taken whole. ``window`` must hold a phrase.
    """
    if not 0 < phrase <= window:
        raise ValueError(f"a window of {window} words holds no phrase of {phrase}")
    scratch = Scratch(docs.sparkSession, "repeats")
    profile = scratch.keep(profiles(docs, text, window, phrase), "profiles")
    # One document for all with the same words: the first. Later ones go as a whole, so their windows need no search.
    first = profile.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    first = first.groupBy("words_sha256").agg(
        F.min("doc_id").alias("doc_id"), F.min_by("_key", F.struct("doc_id", "_key")).alias("_key"), F.first("phrases").alias("phrases")
    )
    first = scratch.keep(first, "firsts")
    blocks = F.ceil(F.size("phrases") * F.lit(PHRASE * 8) / F.lit(DOCUMENT_BYTES)).alias("blocks")
    having = first.select("doc_id", "_key", blocks, F.explode("phrases").alias("phrase"))
    recurring = having.groupBy("phrase").agg(F.min(F.struct("doc_id", "blocks")).alias("least"), F.max("doc_id").alias("last"))
    recurring = recurring.where(F.col("least.doc_id") < F.col("last"))
    block = F.pmod(F.xxhash64("phrase"), F.col("least.blocks")).alias("block")
    recurring = scratch.keep(recurring.select("phrase", F.col("least.doc_id").alias("first"), block), "recurring")
    shards = max(1, -(-recurring.count() * PHRASE * 8 // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("first", "block"), F.lit(shards))
    pairs = having.drop("blocks").join(recurring, "phrase").withColumn("shard", shard)
    needs = pairs.groupBy("doc_id", "_key").agg(
        F.collect_set("shard").alias("shards"),
        F.collect_set(F.when(F.col("first") == F.col("doc_id"), F.col("phrase"))).alias("own"),
    )
    texts = _keyed(docs, text).join(needs, ["doc_id", "_key"]).dropDuplicates(["doc_id", "_key"])
    texts = scratch.keep(texts, "texts")

    compiled = _phrase_words(texts, phrase).dropDuplicates(["phrase"]).join(recurring, "phrase")
    compiled = compiled.select("phrase", "words", shard.alias("shard"))
    sent = texts.select("doc_id", "_key", "text", F.explode("shards").alias("shard"))
    sizes = sent.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("bytes"))
    sizes = sizes.select("shard", F.ceil(F.col("bytes") / SPLIT_BYTES).cast("int").alias("splits"))
    sizes = scratch.keep(sizes, "sizes")
    split = F.pmod(F.xxhash64("doc_id", "_key"), F.col("splits")).cast("int")
    readers = sent.join(sizes, "shard").select("shard", split.alias("split"), "doc_id", "text")
    parts = F.explode(F.sequence(F.lit(0), F.col("splits") - 1))
    automata = compiled.join(sizes, "shard").select("shard", parts.alias("split"), "phrase", "words")

    def locate(texts: pd.DataFrame, phrases: pd.DataFrame) -> pd.DataFrame:
        return _locate(texts, phrases, window, phrase)

    windows = (
        readers.groupBy("shard", "split")
        .cogroup(automata.groupBy("shard", "split"))
        .applyInPandas(locate, "window long, phrase long, doc_id long")
    )
    windows = scratch.keep(windows, "windows")
    earliest = windows.groupBy("window", "phrase").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    earliest = earliest.where(F.col("first") < F.col("last")).drop("last")
    gone = windows.join(earliest, ["window", "phrase"]).where(F.col("first") < F.col("doc_id"))
    gone = gone.groupBy("doc_id").agg(F.collect_set("window").alias("windows"))
    cut = texts.select("doc_id", "text").join(gone, "doc_id").mapInPandas(
        lambda batches: _removed(batches, window),
        "words_sha256 string, doc_id long, spans array<struct<start:long,end:long>>, n_removed long, kept_sha256 string",
    )
    cut = scratch.keep(cut, "cut")
    scratch.drop("recurring", "texts", "sizes", "windows")

    # Of those with a window, only the first document with its words is looked at; others go as a whole.
    looked_at = first.select("words_sha256", "doc_id", F.lit(True).alias("_first")).join(cut, ["words_sha256", "doc_id"], "left")
    every = profile.drop("phrases").join(looked_at, ["words_sha256", "doc_id"], "left")
    whole = (F.col("n_words") >= window) & F.col("doc_id").isNotNull() & F.col("_first").isNull()
    all_words = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    return every.select(
        *("doc_id", "_key", "n_words"),
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, all_words).otherwise(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the words that ``repeats`` finds taken out of the texts; a text that loses all its words is dropped.

    A text that loses nothing, null or empty ones too, stays as it is. Else the white space before a word goes with it.
    """
    found = repeats(docs, text, window).where(F.col("n_removed") > 0)
    whole = F.col("n_removed") == F.col("n_words")
    found = found.select(F.col("doc_id").alias("cut_id"), F.col("_key").alias("cut_key"), "spans", whole.alias("whole"))
    found = found.dropDuplicates(["cut_id", "cut_key"])

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_outside(t, s) for t, s in zip(texts, spans)], dtype=object)

    # The row as a struct, so that none of its columns is mistaken for another.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_key(text).alias("hash"), F.struct("*").alias("row"))
    joined = rows.join(found, (F.col("id") == F.col("cut_id")) & (F.col("hash") == F.col("cut_key")), "left")
    rest = joined.where(~F.coalesce("whole", F.lit(False)))
    body = F.col("row").getField(text)
    shorter = F.when(F.col("spans").isNull(), body).otherwise(F.pandas_udf(cut, "string")(body, F.col("spans")))
    return rest.select(F.col("row").withField(text, shorter).alias("row")).select("row.*")


def _outside(text: str | None, spans) -> str | None:
    """The text without the words in the spans."""
    if text is None or spans is None or not len(spans):
        return text
    places = [m.span() for m in WORD.finditer(text)]
    parts, at = [], 0
    for span in spans:
        parts.append(text[at : places[span["start"] - 1][1] if span["start"] else 0])
        at = places[span["end"] - 1][1]
    return "".join([*parts, text[at:]])
