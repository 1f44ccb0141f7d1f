"""Packing documents into sequences of a fixed number of tokens.

The sum-of-squares rule: of all open sequences that have room, and a new one, take the one after which the sum of the
squared counts of open sequences per room left is smallest. It keeps the rooms varied, so that later pieces
find one that fits exactly.
"""

import bisect
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolsift.llm import encoding
from spoolsift.llm.encoding import encoder
from spoolsift.llm.tables import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(encoding)

# Pieces that one task packs: enough that the few sequences left open in each do not count.
PIECES_A_GROUP = 10_000
# A sequence with more than this share of room left is packed again with those of other groups.
OPEN_SHARE = 0.01

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, placed in the order given by the sum-of-squares rule; no size is above ``capacity``.

    What the rule leaves open is packed once more if that saves a bin: see ``_finished``.
    """
    held: list[list[int]] = []
    counts = np.zeros(capacity + 1, np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    worst = np.iinfo(np.int64).max
    for i, size in enumerate(sizes.tolist()):
        # By room: what the placing adds to the sum of squares. One bin fewer has that room, one more has what is left of it.
        there = counts[size:]
        added = np.where(there > 0, 2 * (counts[: len(there)] - there) + 2, worst)
        if there[0] > 0:
            added[0] = 1 - 2 * there[0]  # full, and so no longer counted
        best = int(np.argmin(added))
        new = 2 * counts[capacity - size] + 1 if size < capacity else 0
        if new < added[best]:
            room, target = capacity, len(held)
            held.append([])
        else:
            room = best + size
            target = rooms[room].pop()
            counts[room] -= 1
        held[target].append(i)
        if left := room - size:
            rooms[left].append(target)
            counts[left] += 1
    bins = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    for number, items in enumerate(_finished(held, sizes, capacity)):
        bins[items] = number
        offsets[items] = np.cumsum(sizes[items]) - sizes[items]
    return bins, offsets


def _finished(held: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins with room, and as many full ones with the most items (small ones fit well), packed anew if fewer bins then do."""
    filled = [int(sizes[items].sum()) for items in held]
    still_open = [k for k, n in enumerate(filled) if n < capacity]
    full = sorted((k for k, n in enumerate(filled) if n == capacity), key=lambda k: -len(held[k]))
    chosen = still_open + full[: len(still_open)]
    # The sizes alone may say that no bin can be saved.
    if len(chosen) - -(-sum(filled[k] for k in chosen) // capacity) < 1:
        return held
    again = _fullest(sorted((i for k in chosen for i in held[k]), key=lambda i: -sizes[i]), sizes.tolist(), capacity)
    if len(again) >= len(chosen):
        return held
    gone = set(chosen)
    return [items for k, items in enumerate(held) if k not in gone] + again


def _fullest(items: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins made one by one: the largest item left, and those others that together leave least room. Items: larger first."""
    out = []
    # Sizes downwards, so that those that fit are found by bisection.
    order, down = list(items), [-sizes[i] for i in items]
    while order:
        room = capacity + down[0]
        fits = bisect.bisect_left(down, -room, 1)
        # Bit n: some of the items so far have the size n together.
        within = (1 << (room + 1)) - 1
        reached = [1]
        for k in range(fits, len(down)):
            reached.append((reached[-1] | (reached[-1] << -down[k])) & within)
            if reached[-1] >> room:
                break
        size = reached[-1].bit_length() - 1
        taken = []
        for k in range(len(reached) - 1, 0, -1):
            if not reached[k - 1] >> size & 1:
                taken.append(fits + k - 1)
                size += down[fits + k - 1]
        taken.append(0)
        out.append([order[k] for k in reversed(taken)])
        for k in taken:
            del order[k], down[k]
    return out


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, text: str = "text") -> DataFrame:
    """Token ids of each whole text and ``end_id``, cut into pieces of ``capacity`` only if there are more of them."""
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, known, body in zip(batch["doc_id"], batch["doc_id"].notna(), batch["text"]):
                ids = words.encode(body or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((int(doc_id) if known else None, k, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64", "piece": "int32"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(cut, PIECES)


def _packed(rows: DataFrame, size: str, capacity: int, level: int) -> DataFrame:
    """``rows`` with _bin and _offset, packed in groups of bounded size; equal rows spread like others."""
    total = rows.count()
    groups = max(1, -(-total // PIECES_A_GROUP))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(groups))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = pack(frame[size].to_numpy(np.int64), capacity)
        return frame.assign(_bin=frame["_group"].to_numpy(np.int64) * (1 << 32) + bins, _offset=offsets).drop(columns="_group")

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    schema = f"{fields}, _bin long, _offset long"
    return rows.withColumn("_group", place).groupBy("_group").applyInPandas(fill, schema)


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096, text: str = "text"
) -> DataFrame:
    """Documents in as few sequences of at most ``capacity`` tokens as the rule can: one row per piece.

    doc_id, piece (from 0), start (ids of its document before it), length, ids_crc32, sequence_id, offset (its place, without
    gaps from 0). A null text is empty and has its end id only. Equal rows are packed as often as they come; null ids
    stay null; an empty table gives no sequences. Extra columns are ignored.

    Pieces are packed in groups of about PIECES_A_GROUP that are chosen by a hash, so neither the documents of one source nor
    copies meet in one task. What a group leaves open is packed again as a whole, with what others leave open.
    """
    # Written once, so that groups and numbers stay the same if a task is run again.
    cut = kept(pieces(docs, vocabulary, end_id, capacity, text), "pieces")
    first = kept(_packed(cut, "length", capacity, 1), "packed")
    filled = first.groupBy("_bin").agg(F.sum("length").alias("_filled"))
    still_open = kept(filled.where(F.col("_filled") < capacity * (1 - OPEN_SHARE)), "open")
    again = _packed(still_open.withColumnRenamed("_bin", "_old"), "_filled", capacity, 2)
    moved = again.select(
        F.col("_old").alias("_bin"), (-1 - F.col("_bin")).alias("_new"), F.col("_offset").alias("_shift")
    )
    return first.join(moved, "_bin", "left").select(
        *("doc_id", "piece", "start", "length", "ids_crc32"),
        F.coalesce("_new", "_bin").alias("sequence_id"),
        (F.col("_offset") + F.coalesce("_shift", F.lit(0))).alias("offset"),
    )
