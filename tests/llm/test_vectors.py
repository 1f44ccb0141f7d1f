import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from spoolsift.llm import vectors
from spoolsift.llm.queries import QUERIES

from tests.compare import database

SF = "/root/testdata/sf0.001"


def codes_by_loops(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, digest) of every usable row."""
    kept = []
    for i, vector, label in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((i, [math.floor(4096 * x) for x in vector], label))
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[whole[p * width : (p + 1) * width] for p in range(parts)] for _, whole, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), k) for k, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for row in cut:
                held[nearest(row[p], books[p])[1]].append(row[p])
            for k, members in held.items():
                books[p][k] = [sum(column) // len(members) for column in zip(*members)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out, by_label = [], defaultdict(int)
    for (i, _, label), row in zip(kept, cut):
        best = [nearest(row[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
        by_label[label] += out[-1][2]
    return [(i, code, error, by_label[label], digest) for i, code, error, label in out]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


def found(df):
    return in_order(tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_op13(spark):
    rows = database(SF).execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    assert found(QUERIES["op13_vector_codes"](spark, SF)) == in_order(codes_by_loops(rows))


def odd_rows(n=300, size=16):
    rng = random.Random(7)
    rows = [(i, [rng.choice([-0.5, -1 / 3, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(size)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [rows[3], rows[3], (3, rows[9][1], 1), (None, rows[4][1], None), (None, None, 1), (-5, None, None)]
    rows += [(-4, [float("nan"), *rows[0][1][1:]], 1), (-3, [float("inf"), *rows[0][1][1:]], 1), (-2, [None, *rows[0][1][1:]], 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [0, 3, 300])
def test_odd_rows(spark, n):
    rows = odd_rows(n) if n > 20 else [(i, [float(i)] * 16, None) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    df = df.withColumns({c: F.lit(f"own {c}") for c in ("whole", "entry", "distance", "code", "error", "_label")})
    assert found(vectors.vector_codes(df)) == in_order(codes_by_loops(rows))


def test_vectors_without_a_code_are_refused(spark):
    schema = "vec_id long, embedding array<double>, label int"
    for rows in ([(1, [1.0] * 8, 0), (2, [1.0] * 16, 0)], [(1, [1.0] * 9, 0)], [(1, [1e30] * 8, 0)]):
        with pytest.raises(ValueError):
            vectors.vector_codes(spark.createDataFrame(rows, schema))
    empty = spark.createDataFrame([(1, [], 0)], schema)
    assert found(vectors.vector_codes(empty)) == [(1, "00" * 8, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_only_moved_entries_are_compared_and_the_result_is_that_of_all():
    rng = np.random.default_rng(8)
    parts = rng.integers(-6, 7, (500, 3))
    books = vectors.Codebooks(rng.integers(-6, 7, (1, 16, 3)))
    entry, distance = np.full(500, -1), np.full(500, -1)
    looked = []
    for _ in range(12):
        looked.append(vectors.assign(parts, books, 0, entry, distance))
        best, least = vectors.nearest(parts, books.entries[0], np.arange(16))
        assert (best == entry).all() and (least == distance).all()
        sums = {(0, e): (int((entry == e).sum()), parts[entry == e].sum(axis=0).tolist()) for e in set(entry.tolist())}
        books = books.replaced(sums)
    assert looked[0] == 500 and looked[-1] < 500
