"""Slab-wise windows give what plain windows give, hot keys included."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spoolsift.model import slab_of
from spoolsift.operators.events import number_events, pair_tools
from spoolsift.operators.slabs import attach, first_rows, running, whole_group


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"k{rng.randrange(9)}", i, rng.randrange(100)) for i in range(600)]
    return spark.createDataFrame(rows, "key string, seq bigint, v bigint")


def test_running_count_and_sum(table):
    up = {"_slab": (slab_of("seq", 7), False)}
    counted = running(table, ["key"], up, [F.col("seq")], "n")
    both = running(counted, ["key"], up, [F.col("seq")], "s", F.col("v"))
    order = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    wrong = both.withColumns({"n2": F.count(F.lit(1)).over(order), "s2": F.sum("v").over(order)}).where("n <> n2 OR s <> s2")
    assert both.count() == 600 and wrong.count() == 0


def test_running_downwards_with_two_levels(table):
    slabs = {"_a": (slab_of("seq", 50), True), "_b": (slab_of("seq", 5), True)}
    numbered = running(table, ["key"], slabs, [F.desc("seq")], "n")
    order = Window.partitionBy("key").orderBy(F.desc("seq"))
    assert numbered.withColumn("n2", F.row_number().over(order)).where("n <> n2").count() == 0


def test_whole_group_with_and_without_condition(table):
    parts, whole = {"m": F.max("v")}, {"m": F.max("m")}
    seen = whole_group(table, ["key"], slab_of("seq", 7), parts, whole)
    assert seen.withColumn("m2", F.max("v").over(Window.partitionBy("key"))).where("m <> m2").count() == 0
    some = whole_group(table, ["key"], slab_of("seq", 7), parts, whole, only=F.col("v") < 50)
    limit = F.max(F.when(F.col("v") < 50, F.col("v"))).over(Window.partitionBy("key"))
    assert some.count() == 600
    assert some.withColumn("m2", limit).where("v < 50 AND m <> m2").count() == 0


def test_attach_keeps_every_row_once(spark, table):
    info = spark.createDataFrame([("hot", "H"), ("k1", "K")], "key string, label string")
    got = attach(table, info, "key", slab_of("seq", 7))
    assert got.count() == table.where("key IN ('hot', 'k1')").count()


PAIRED = """
WITH e AS (SELECT * FROM made),
named AS (SELECT call_id, arg_max(tool, seq) AS tool, max(seq) AS last FROM e WHERE kind = 'tool' GROUP BY call_id),
ended AS (SELECT call_id, arg_max(is_error, seq) AS failed FROM e WHERE kind = 'result' GROUP BY call_id)
SELECT seq, CASE WHEN kind = 'result' THEN coalesce(named.tool, e.tool) ELSE e.tool END AS tool,
  CASE WHEN kind = 'tool' AND seq = last AND failed IS NOT NULL THEN CASE WHEN failed THEN 'err' ELSE 'ok' END ELSE tag END AS tag
FROM e LEFT JOIN named USING (call_id) LEFT JOIN ended USING (call_id) ORDER BY ALL
"""


@pytest.mark.parametrize("seed", range(3))
def test_pairing_with_repeated_and_empty_ids(as_events, rows, seed):
    rng = random.Random(seed)
    made = []
    for seq in range(1, 60):
        kind = rng.choice(["tool", "result", "text"])
        call = rng.choice(["", "a", "b", "c", f"x{seq}"]) if kind != "text" else None
        made.append(("s", seq, "asst", kind, "t", f"T{seq}" if kind == "tool" else "", "", kind == "result" and rng.random() < 0.5, call))
    names = ("session_id", "seq", "role", "kind", "text", "tool", "tag", "is_error", "call_id")
    con = duckdb.connect()
    con.register("made", pd.DataFrame(made, columns=names))
    assert rows(pair_tools(as_events(*made), slab=4), "seq", "tool", "tag") == con.execute(PAIRED).fetchall()


def test_number_events_counts_blocks(spark, as_events):
    events = as_events(*[("s", i, "user", "text", "t") for i in range(1, 12)])
    doubled = events.unionByName(events.withColumn("block", F.lit(1))).drop("pos")
    numbered = number_events(doubled, slab=3)
    got = [r["pos"] for r in numbered.orderBy("seq", "block").collect()]
    assert got == list(range(1, 23))


@pytest.fixture(scope="module")
def holed(table):
    """A fifth of the keys and a seventh of the numbers are null."""
    key = F.when(F.col("v") % 5 > 0, F.col("key"))
    return table.withColumns({"key": key, "seq": F.when(F.col("v") % 7 > 0, F.col("seq"))})


def test_null_keys_and_slabs_keep_their_rows(holed):
    up = {"_slab": (slab_of("seq", 7), False)}
    counted = running(holed, ["key"], up, [F.col("seq"), F.col("v")], "n")
    assert counted.count() == 600
    order = Window.partitionBy("key").orderBy("seq", "v")
    assert sorted((r["key"] or "", r["n"]) for r in counted.collect()) == sorted(
        (r["key"] or "", r["n"]) for r in holed.select("key", F.row_number().over(order).alias("n")).collect()
    )
    parts, whole = {"m": F.max("v")}, {"m": F.max("m")}
    seen = whole_group(holed, ["key"], slab_of("seq", 7), parts, whole)
    limit = F.max("v").over(Window.partitionBy("key"))
    assert seen.count() == 600 and seen.withColumn("m2", limit).where("m <> m2").count() == 0
    assert first_rows(holed, ["key"], [F.col("seq")], 2).where("key IS NULL").count() == 2


def test_attach_to_null_keys(spark, holed):
    info = spark.createDataFrame([("hot", "H"), (None, "none")], "key string, label string")
    got = attach(holed, info, "key", slab_of("seq", 7))
    assert got.count() == holed.where("key = 'hot' OR key IS NULL").count()
    assert attach(holed, info, "key", slab_of("seq", 7), "left").count() == 600
