"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Signatures: a first permutation of the shingles' hashes, then a second one that is shifted by one place more for every
coordinate; two permutations give them all. Documents that agree in a band share a bucket.

Links: copies (equal sets) are one node. In a bucket the most popular node is the centre, and all others are compared with it,
so a bucket of any size gives as many pairs as it has nodes. What is then still apart within a bucket is compared as well, but
only pairs that can reach the threshold: a shingle that no other node of such buckets has is lost to every intersection, and
sets counted in parts have no more in common than the smaller counts.
All comparisons are made on full sets.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolsift.llm import words
from spoolsift.llm.tables import Scratch, text_key
from spoolsift.llm.words import Words, grouped, mix, runs, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(words)

SHINGLE = 5
# A pair at 0.85 misses all 32 bands of 4 with a chance of 6e-11.
BANDS = 32
ROWS = 4
# Sets are counted by as many parts of the hashes; what two have in common is at most the sum of the smaller counts.
BINS = 128

LETTERS = table(letters_and_digits=False, lower=True)


def permuted(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Circulant MinHash of each set of 64-bit hashes (none empty): coordinate k shifts the first permutation by k."""
    first = permuted((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32) ^ np.uint32(0x9E3779B9))
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), size), np.uint32)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(permuted(first + np.uint32(k)), starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    keys = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], len(signature), 0)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, r::rows][:, :bands].astype(np.uint64) + np.uint64(1))
    return keys.view(np.int64)


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of the distinct runs of ``n`` words; of fewer words all make one run, of none none."""
    w = Words(texts, LETTERS)
    hashes = w.hashes()
    each = runs(hashes, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        out.append(np.unique(each[a : b - n + 1]) if b - a >= n else runs(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("_key"), F.col(text).alias("text"))


def _signed(keyed: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, _key, n_shingles, digest of the set, band keys."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            for begin, group in grouped([t if isinstance(t, str) else None for t in batch["text"]]):
                part = batch.iloc[begin : begin + len(group)]
                sets = shingle_sets(group, shingle)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [[]] * len(sets)
                if some:
                    for i, k in zip(some, band_keys(signatures([sets[i] for i in some], bands * rows), bands, rows)):
                        keys[i] = k
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64").to_numpy(),
                        "_key": part["_key"].to_numpy(),
                        "n_shingles": [len(s) for s in sets],
                        "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                        "bands": keys,
                    }
                ).astype({"doc_id": "Int64"})

    return keyed.mapInPandas(sign, "doc_id long, _key long, n_shingles long, digest binary, bands array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin, group in grouped(list(batch["text"])):
                sets = shingle_sets(group, shingle)
                yield pd.DataFrame(
                    {
                        "node": batch["node"].iloc[begin : begin + len(group)].to_numpy(),
                        "shingles": [s.view(np.int64) for s in sets],
                        "bins": [np.bincount((s % np.uint64(BINS)).astype(np.int64), minlength=BINS) for s in sets],
                    }
                )

    return texts.mapInPandas(cut, "node long, shingles array<long>, bins array<int>")


def _linked(common: Column, one: Column, two: Column, percent: int) -> Column:
    return 100 * common >= percent * (one + two - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"of_{side}")), side)
    common = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.where(_linked(common, F.size("of_a"), F.size("of_b"), percent)).select("a", "b")


def components(nodes: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root: the smallest node that links lead to. A written table per round; rounds grow with the log of the longest path."""
    both = scratch.keep(links.union(links.select("b", "a")), f"{name}-edges")
    now = both.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), F.least("a", "root").alias("root"))
    now = scratch.keep(now, f"{name}-0")
    at = 0
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        near = near.select(F.col("a").alias("node"), "near")
        new = now.join(near, "node").select("node", F.col("root").alias("_old"), F.least("root", "near").alias("root"))
        # The root's own root is nearer to the end.
        further = now.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        new = new.join(further, "root").select("node", F.least("root", "_next").alias("root"), "_old")
        new = scratch.keep(new, f"{name}-{at + 1}")
        changed = new.where(F.col("root") != F.col("_old")).limit(1).count()
        scratch.drop(f"{name}-{at}")
        now, at = new.drop("_old"), at + 1
        if not changed:
            break
    every = nodes.join(now, "node", "left")
    return every.select("node", F.coalesce("root", "node").alias("root"))


def near_duplicates(
    docs: DataFrame, percent: int = 85, text: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per document row: doc_id, _key (hash of the text), n_shingles, component_id, kept, first.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of ``shingle``-word shingles, lower-cased in A-Z;
    of fewer words all make one shingle. ``component_id`` is the smallest doc_id that links lead to, the document's own
    included; ``kept``: it is that one. ``first``: of the rows with that id also the text is the one with the smallest key, so that of
    a group whose smallest id stands on several texts one text is first. A null or blank text has an empty set and is linked with nothing. A row without
    doc_id takes no part: it has no component and is kept. Repeated rows come out as often as they come in (an id's row that is
    kept is kept as often); texts of any length are taken whole; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "near")
    keyed = _keyed(docs, text)
    signed = scratch.keep(_signed(keyed, shingle, bands, rows), "signed")
    # One node for all rows with the same set, named by a number that is written down with it.
    nodes = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"),
        F.min_by("_key", F.struct("doc_id", "_key")).alias("_key"),
        F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"),
    )
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    inside = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = inside.groupBy("band").agg(F.count("*").alias("many")).where(F.col("many") > 1)
    members = scratch.keep(inside.join(shared, "band"), "members")
    popular = members.groupBy("node").agg(F.sum("many").alias("popular"))
    popular = scratch.keep(popular, "popular")
    ranked = members.join(popular, "node")
    centres = ranked.groupBy("band").agg(
        F.max(F.struct("popular", (-F.col("node")).alias("minus"), "n")).alias("top")
    ).select("band", (-F.col("top")["minus"]).alias("centre"), F.col("top")["n"].alias("centre_n"))
    centres = scratch.keep(centres, "centres")
    lengths = (100 * F.col("n") >= percent * F.col("centre_n")) & (100 * F.col("centre_n") >= percent * F.col("n"))
    stars = members.join(centres, "band").where((F.col("node") != F.col("centre")) & lengths)
    stars = stars.groupBy(F.col("node").alias("a"), F.col("centre").alias("b")).agg(F.lit(1).alias("_one")).drop("_one")

    wanted = popular.select("node").join(nodes.select("node", "doc_id", "_key"), "node")
    texts = keyed.join(wanted, ["doc_id", "_key"]).select("node", "text").dropDuplicates(["node"])
    sets = scratch.keep(_sets(texts, shingle), "sets")
    links = scratch.keep(verified(stars, sets, percent), "star-links")
    joined = scratch.keep(components(popular.select("node"), links, scratch, "star"), "joined")

    # Buckets that still hold several components.
    rooted = members.join(joined, "node")
    contested = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") < F.col("high"))
    main = centres.join(contested, "band").join(joined.select(F.col("node").alias("centre"), F.col("root").alias("main")), "centre")
    rooted = scratch.keep(rooted.join(main.select("band", "main"), "band").select("band", "node", "n", "root", "main"), "contested")
    there = rooted.select("node").distinct()
    alone = sets.join(there, "node").select("node", F.explode("shingles").alias("shingle"))
    alone = alone.groupBy("shingle").agg(F.count("*").alias("many"), F.min("node").alias("node")).where(F.col("many") == 1)
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    most = rooted.join(alone, "node", "left").withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0)))
    most = most.where(100 * F.col("most") >= percent * F.col("n")).join(nodes.select("node", "bands"), "node")
    most = scratch.keep(most.join(sets.select("node", "bins"), "node"), "possible")
    left = most.where(F.col("root") != F.col("main")).select("band", *(F.col(c).alias(f"{c}_a") for c in ("node", "n", "root", "most", "bands", "bins")))
    bound = _linked(F.least("most_a", "most_b"), F.col("n_a"), F.col("n_b"), percent)
    # A pair of two leftovers would come up twice.
    right = most.select("band", F.col("main").alias("main_b"), *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "root", "most", "bands", "bins")))
    once = (F.col("root_b") == F.col("main_b")) | (F.col("node_a") < F.col("node_b"))
    # Of the buckets that both are in, one gives the pair.
    once = once & (F.array_min(F.array_intersect("bands_a", "bands_b")) == left["band"])
    smaller = F.zip_with("bins_a", "bins_b", lambda a, b: F.least(a, b))
    common = F.least(F.aggregate(smaller, F.lit(0), lambda total, n: total + n), "most_a", "most_b")
    reach = _linked(common, F.col("n_a"), F.col("n_b"), percent)
    rest = left.join(right, (left["band"] == right["band"]) & (F.col("root_a") != F.col("root_b")) & bound & once & reach)
    rest = rest.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.lit(1).alias("_one")).drop("_one")
    more = verified(rest, sets, percent)
    for side in ("a", "b"):
        more = more.join(joined.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side)
    more = scratch.keep(more.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), "more-links")
    again = components(joined.select(F.col("root").alias("node")).distinct(), more, scratch, "more")
    final = joined.select("node", F.col("root").alias("_first")).join(
        again.select(F.col("node").alias("_first"), "root"), "_first"
    ).select("node", "root")
    named = nodes.select("node", "digest", "doc_id", "_key").join(final, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min(F.struct("doc_id", "_key")).alias("least"))
    smallest = smallest.select("root", F.col("least")["doc_id"].alias("component_id"), F.col("least")["_key"].alias("component_key"))
    classes = scratch.keep(named.join(smallest, "root").select("digest", "component_id", "component_key"), "classes")
    scratch.drop("members", "popular", "centres", "sets", "star-links", "joined", "contested", "possible", "more-links", "nodes")

    every = signed.select("doc_id", "_key", "n_shingles", "digest").join(classes, "digest", "left")
    own = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(own, F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return every.select(
        *("doc_id", "_key", "n_shingles"),
        component.alias("component_id"),
        kept.alias("kept"),
        (own | (kept & (F.col("_key") == F.col("component_key")))).alias("first"),
    )
