"""Benchmark decontamination: which words of a document stand in windows of benchmark items.

A window of an item occurs in a document only if all its shingles do, so one of them is enough to find it: its rarest,
the prefix of its shingles in order of rarity, the necessary one for a containment of 1.

1. Every shingle of a window is counted over all documents, in one pass, and the rarest of each window chosen by a join.
2. In a second pass each document gives the places where it has such a prefix, with the words around them.
3. These places are joined with the windows on the prefix. Where the window would begin and end must lie within the document,
   and the words there must be those of the window.

A bitmap of the shingles looked for, of bounded size, keeps the others from being shuffled; what it lets through by chance, the
joins leave out.
"""

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolsift.llm import words
from spoolsift.llm.tables import kept, text_key
from spoolsift.llm.words import Words, grouped, runs, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(words)

WINDOW = 13
SHINGLE = 5
# The largest bitmap of shingles that is sent to executors: 16 MB, whatever the number of windows.
FILTER_BITS = 1 << 27
# Places of prefixes in one row, and words in one block when spans are joined.
CHUNK = 10_000

LETTERS = table(letters_and_digits=True, lower=True)
SPANS = "array<struct<start:long,end:long>>"


def _long(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Distinct windows: words, n_words, shingles (hash by place), items. Items without words have none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for begin, group in grouped([t if isinstance(t, str) else None for t in batch["text"]]):
                w = Words(group, LETTERS)
                hashes = w.hashes()
                for i in range(len(group)):
                    first, last = int(w.first[i]), int(w.first[i + 1])
                    n = min(window, last - first)
                    size = min(shingle, n)
                    if not n or pd.isna(batch["item_id"].iloc[begin + i]):
                        continue
                    found = _long(runs(hashes[first:last], size))
                    for at in range(last - first - n + 1):
                        rows.append(
                            (batch["item_id"].iloc[begin + i], w.sequence(first + at, n), n, found[at : at + n - size + 1])
                        )
            yield pd.DataFrame(rows, columns=["item_id", "words", "n_words", "shingles"])

    schema = "item_id long, words binary, n_words int, shingles array<long>"
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInPandas(cut, schema)
    # The shingles follow from the words, so any row's are those of the group.
    return rows.groupBy("words", "n_words").agg(F.first("shingles").alias("shingles"), F.collect_set("item_id").alias("items"))


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """A bit for every value of the one column; its size follows their number up to FILTER_BITS."""
    bits = 1 << 10
    count = hashes.count()
    while bits < min(16 * count, FILTER_BITS):
        bits *= 2
    bits = min(bits, FILTER_BITS)
    at = F.col(hashes.columns[0]).bitwiseAND(F.lit(bits - 1)).alias("at")
    masks = hashes.select(at).selectExpr("shiftright(at, 6) AS place", "shiftleft(1L, cast(at & 63 AS int)) AS mask")
    masks = masks.groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(max(1, bits >> 6), np.uint64)
    out[masks["place"].to_numpy()] = masks["mask"].to_numpy().view(np.uint64)
    return out


def _among(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    at = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _places(w: Words, sizes: Sequence[int], bitmap: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size of shingle: the places within one text whose shingle may be among those looked for, and their hashes."""
    hashes = w.hashes()
    for size in sizes:
        found = runs(hashes, size)
        at = np.flatnonzero(w.valid(size) & _among(found, bitmap))
        yield size, at, _long(found[at])


def shingle_counts(docs: DataFrame, wanted: DataFrame, sizes: Sequence[int], text: str) -> DataFrame:
    """How often each shingle of ``wanted`` that occurs in the documents does so: shingle, n."""
    known = docs.sparkSession.sparkContext.broadcast((_bitmap(wanted), list(sizes)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap, sizes = known.value
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for _, group in grouped([t if isinstance(t, str) else None for t in batch[text]]):
                found += [hashes for _, _, hashes in _places(Words(group, LETTERS), sizes, bitmap)]
            shingle, n = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"shingle": shingle, "n": n})

    counted = docs.select(text).mapInPandas(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return counted.join(wanted, "shingle")


def prefixed(windows: DataFrame, counted: DataFrame) -> DataFrame:
    """Windows by their rarest shingle: words, n_words, items, prefix, place (of the prefix in the window)."""
    each = windows.select("words", "n_words", F.posexplode("shingles").alias("place", "shingle"))
    # Of equally rare ones that with the least hash, then the first.
    ranked = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("shingle"), F.col("place"))
    rarest = each.join(counted, "shingle", "left").groupBy("words", "n_words").agg(F.min(ranked).alias("least"))
    return windows.join(rarest, ["words", "n_words"]).select(
        "words", "n_words", "items", F.col("least.shingle").alias("prefix"), F.col("least.place").alias("place")
    )


CANDIDATES = (
    "doc_id long, _key long, n_words long, first boolean, "
    "candidates array<struct<prefix:long,at:long,before:int,after:int,around:binary>>"
)


def prefix_places(keyed: DataFrame, prefixes: DataFrame, sizes: Sequence[int], window: int) -> DataFrame:
    """Where documents may have one of the prefixes, with the words around that a window with it can take.

    At least one row per document row, and one more for every CHUNK places; ``first`` marks one of them.
    """
    known = keyed.sparkSession.sparkContext.broadcast((_bitmap(prefixes), list(sizes)))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap, sizes = known.value
        for batch in batches:
            for begin, group in grouped([t if isinstance(t, str) else None for t in batch["text"]]):
                w = Words(group, LETTERS)
                parts = [(at, hashes, np.full(len(at), size)) for size, at, hashes in _places(w, sizes, bitmap)]
                parts.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)))
                at, prefix, size = (np.concatenate(part) for part in zip(*parts, strict=True))
                order = np.argsort(at, kind="stable")
                at, prefix, size = at[order], prefix[order], size[order]
                owner = np.searchsorted(w.first, at, "right") - 1
                before = np.minimum(at - w.first[owner], window - size)
                after = np.minimum(w.first[owner + 1] - at, window)
                edges = np.searchsorted(owner, np.arange(len(group) + 1))
                rows, pending = [], 0
                for i, n in enumerate(w.per_text.tolist()):
                    doc_id = batch["doc_id"].iloc[begin + i]
                    name = (None if pd.isna(doc_id) else int(doc_id), batch["_key"].iloc[begin + i], n)
                    low, high = int(edges[i]), int(edges[i + 1])
                    for start in range(low, max(high, low + 1), CHUNK):
                        found = [
                            {
                                "prefix": int(prefix[k]),
                                "at": int(at[k] - w.first[i]),
                                "before": int(before[k]),
                                "after": int(after[k]),
                                "around": w.sequence(int(at[k] - before[k]), int(before[k] + after[k])),
                            }
                            for k in range(start, min(high, start + CHUNK))
                        ]
                        rows.append((*name, start == low, found))
                        pending += len(found)
                        if pending >= CHUNK:
                            yield _rows(rows)
                            rows, pending = [], 0
                yield _rows(rows)

    return keyed.mapInPandas(probe, CANDIDATES)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "_key", "n_words", "first", "candidates"])
    return frame.astype({"doc_id": "Int64", "first": bool})


def _joined(spans: list[dict]) -> list[dict]:
    """Spans that overlap or touch as one, in order."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [{"start": a, "end": b} for a, b in out]


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, text: str = "text"
) -> DataFrame:
    """One row per document row: doc_id, _key (hash of the text), n_words, spans, n_hit, items.

    ``spans``: disjoint (start, end) places of words inside an occurrence of a window of ``items`` (item_id, text), in order;
    ``n_hit``: the words in them; ``items``: sorted ids of items with an occurring window. A null text has no words and no
    hits; items that are null or without words, or have no id, give no window; equal items are found by all their ids; rows that
    are equal in id and text come out as often as they come in. Empty tables of either kind are fine.
    """
    windows = kept(item_windows(items, window, shingle), "windows")
    size = F.least("n_words", F.lit(shingle)).alias("size")
    sizes = sorted(row["size"] for row in windows.select(size).distinct().collect())
    wanted = kept(windows.select(F.explode("shingles").alias("shingle")).distinct(), "wanted")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("_key"), F.col(text).alias("text"))
    index = kept(prefixed(windows, shingle_counts(keyed, wanted, sizes, "text")), "prefixes")
    found = kept(prefix_places(keyed, index.select("prefix").distinct(), sizes, window), "places")

    places = found.select("doc_id", "_key", F.explode("candidates").alias("c")).select("doc_id", "_key", "c.*")
    # The window must begin and end within the document, and the words there be its words.
    fits = (F.col("before") >= F.col("place")) & (F.col("after") >= F.col("n_words") - F.col("place"))
    there = F.slice(F.split(F.col("around").cast("string"), " "), F.col("before") - F.col("place") + 1, F.col("n_words"))
    hits = places.join(index, "prefix").where(fits).where(F.array_join(there, " ") == F.col("words").cast("string"))
    start = F.col("at") - F.col("place")
    hits = hits.select("doc_id", "_key", start.alias("start"), (start + F.col("n_words")).alias("end"), "items")

    @F.pandas_udf(SPANS)
    def joined(spans: pd.Series) -> pd.Series:
        return spans.map(_joined)

    # First within blocks of a document, so that many hits of one text meet as few spans.
    blocks = hits.groupBy("doc_id", "_key", F.floor(F.col("start") / CHUNK).alias("block")).agg(
        F.collect_set(F.struct("start", "end")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    blocks = blocks.select("doc_id", "_key", joined("spans").alias("spans"), "items")
    whole = blocks.groupBy("doc_id", "_key").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    whole = whole.select(F.col("doc_id").alias("hit_id"), F.col("_key").alias("hit_key"), joined("spans").alias("spans"), "items")
    rows = found.where("first").select("doc_id", "_key", "n_words")
    rows = rows.join(whole, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("_key") == F.col("hit_key")), "left")
    spans = F.coalesce("spans", F.array().cast(SPANS))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "_key", "n_words", spans.alias("spans"), F.coalesce("items", F.array().cast("array<long>")).alias("items")).select(
        "doc_id", "_key", "n_words", "spans", n_hit.alias("n_hit"), F.array_sort("items").alias("items")
    )
