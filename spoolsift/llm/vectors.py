"""Short codes for vectors: each of their equal parts is named by the nearest entry of a codebook of its own.

Lloyd's rounds in whole numbers, so that every order of adding gives the same codebooks. A part keeps its entry and
its exact distance from round to round. If that entry did not move, none but moved entries can now be nearer, so only those
are compared; a part whose own entry moved looks at all of them again.
"""

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolsift.llm.tables import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A component counts in steps of 1 / SCALE. Squares of differences up to LARGEST add up within 64 bits for 2,048 components.
SCALE = 4096
LARGEST = 1 << 25

STATE = "whole array<bigint>, entry array<int>, distance array<bigint>"


class Codebooks:
    """Entries by part, entry and component as int64, and which of them differ from those of the round before."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray | None = None):
        self.entries = entries
        self.moved = np.ones(entries.shape[:2], bool) if moved is None else moved

    def replaced(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> "Codebooks":
        """Each used entry becomes its parts' mean, rounded down; (part, entry) -> (count, sums of components)."""
        entries = self.entries.copy()
        for (part, entry), (count, total) in sums.items():
            entries[part, entry] = [s // count for s in total]
        return Codebooks(entries, (entries != self.entries).any(axis=2))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(parts: np.ndarray, books: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the entries numbered ``among`` (ascending) for each row of ``parts``, the lowest of equally near ones; its distance."""
    best = np.full(len(parts), -1, np.int64)
    least = np.full(len(parts), np.iinfo(np.int64).max)
    for entry in among.tolist():
        distance = ((parts - books[entry]) ** 2).sum(axis=1)
        nearer = distance < least
        best[nearer], least[nearer] = entry, distance[nearer]
    return best, least


def assign(parts: np.ndarray, books: Codebooks, part: int, entry: np.ndarray, distance: np.ndarray) -> int:
    """Bring ``entry`` and ``distance`` (-1 if not known yet) of one part position up to date; how many rows looked at all entries."""
    entries, moved = books.entries[part], books.moved[part]
    again = (entry < 0) | moved[entry]
    if again.any():
        entry[again], distance[again] = nearest(parts[again], entries, np.arange(len(entries)))
    active = np.flatnonzero(moved)
    fixed = ~again
    if len(active) and fixed.any():
        found, least = nearest(parts[fixed], entries, active)
        old, at = distance[fixed], entry[fixed]
        better = (least < old) | ((least == old) & (found < at))
        entry[fixed], distance[fixed] = np.where(better, found, at), np.where(better, least, old)
    return int(again.sum())


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_column: str = "vec_id") -> DataFrame:
    """vec_id, code (entry per part, two hex digits each), error, label_error, codebooks_sha256 of every usable vector.

    ``vectors`` has vec_id, embedding (numbers) and label. A vector that is null or holds a null, an infinity or no number is left
    out. Component x counts as floor(4096 x). A codebook starts as the parts of the vectors with the smallest ids, ascending
    (``entries`` of them, fewer if there are fewer; null ids last, equal ids by their vectors). ``error`` is the vector's squared
    distance from its code, ``label_error`` the sum of it over an equal label, nulls being equal. Repeated rows come as often as they
    are given, null ids stay null, an empty table gives no rows, extra columns are ignored. Vectors of different lengths, of a
    length that ``parts`` does not divide, or with a component beyond 8,192 raise ValueError: for those no code is defined.

    The driver holds codebooks and their sums alone, parts x entries x components whatever the table's size. Vectors and the state of
    their parts are rewritten to the shared folder each round and the round before is dropped.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-codes")
    usable = vectors.where(
        F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    )
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = scratch.keep(usable.select(F.col(id_column).alias("vec_id"), "label", whole.alias("whole")), "rows-0")
    size = _checked_size(rows, parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    start = np.array([r["whole"] for r in first], np.int64).reshape(len(first), parts, size // parts)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    state = rows.withColumns({"entry": F.lit(None).cast("array<int>"), "distance": F.lit(None).cast("array<bigint>")})
    for k in range(1, rounds + 2 if first else 1):
        state = scratch.keep(_assigned(state, books, parts), f"rows-{k}")
        scratch.drop(f"rows-{k - 1}")
        if k <= rounds:
            books = books.replaced(_sums(state, parts))
    code = F.lower(F.array_join(F.transform("entry", lambda e: F.lpad(F.hex(e), 2, "0")), ""))
    error = F.aggregate("distance", F.lit(0).cast("long"), lambda a, b: a + b)
    coded = state.select("vec_id", "label", code.alias("code"), error.alias("error"))
    labels = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _checked_size(rows: DataFrame, parts: int) -> int:
    """The one length of all vectors."""
    size = F.size("whole")
    largest = F.array_max(F.transform("whole", F.abs))
    least, most, far = rows.agg(F.min(size), F.max(size), F.max(largest)).first()
    if least is None:
        return 0
    if least != most or most % parts:
        raise ValueError(f"vectors of {least} to {most} components: one length that {parts} divides is needed")
    if far is not None and far > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST / SCALE:.0f}")
    return most


def _assigned(state: DataFrame, books: Codebooks, parts: int) -> DataFrame:
    """Every part's entry and distance after this round's codebooks."""
    ids = [f for f in state.schema if f.name in ("vec_id", "label")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ids) + ", " + STATE

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            whole = _matrix(batch["whole"], n)
            known = batch["entry"].null_count == 0
            entry = _matrix(batch["entry"], n).astype(np.int64) if known else np.full((n, parts), -1, np.int64)
            distance = _matrix(batch["distance"], n) if known else np.full((n, parts), -1, np.int64)
            entry, distance = entry.T.copy(), distance.T.copy()
            width = whole.shape[1] // parts
            for p in range(parts):
                assign(whole[:, p * width : (p + 1) * width], books, p, entry[p], distance[p])
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], batch["whole"], _lists(entry.T.astype(np.int32)), _lists(distance.T)],
                ["vec_id", "label", "whole", "entry", "distance"],
            )

    return state.select("vec_id", "label", "whole", "entry", "distance").mapInArrow(work, schema)


def _sums(state: DataFrame, parts: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (count, sums of components), added up in the tasks first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for batch in batches:
            whole, entry = _matrix(batch["whole"], batch.num_rows), _matrix(batch["entry"], batch.num_rows)
            width = whole.shape[1] // parts
            for p in range(parts):
                mine = whole[:, p * width : (p + 1) * width]
                for e in np.unique(entry[:, p]).tolist():
                    of = entry[:, p] == e
                    count, total = held.get((p, e), (0, 0))
                    held[p, e] = count + int(of.sum()), total + mine[of].sum(axis=0)
        slots = [(p, e, j, count, int(s)) for (p, e), (count, total) in held.items() for j, s in enumerate([0, *total])]
        columns = zip(*slots) if slots else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "count", "total"])

    added = state.select("whole", "entry").mapInArrow(work, "part long, entry long, place long, count long, total long")
    added = added.groupBy("part", "entry", "place").agg(F.sum("count").alias("count"), F.sum("total").alias("total"))
    sums: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sorted(added.collect()):
        sums.setdefault((r["part"], r["entry"]), (r["count"], []))[1].append(r["total"])
    # Place 0 only carries the count, for vectors without components.
    return {slot: (count, total[1:]) for slot, (count, total) in sums.items()}


def _matrix(lists: pa.Array, n: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0)


def _lists(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1]
    offsets = pa.array(np.arange(0, matrix.size + 1, width or 1, dtype=np.int32)[: len(matrix) + 1] if width else np.zeros(len(matrix) + 1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))
