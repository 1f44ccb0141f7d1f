"""Per-session windows that stay bounded when one session holds much of the data.

Each function aggregates to one row per slab first (partial aggregation on the
map side), works on those few rows, and joins the outcome back on (key, slab).
The rows of one join or window group are then at most one slab, however long
the session is. The input is computed twice: hand over a stored table, or
something cheap to compute.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls equal each other; the keys come once, from the left."""
    named = right.select(*[F.col(k).alias(f"_right_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & left[k].eqNullSafe(named[f"_right_{i}"])
    return left.join(named, condition, how).drop(*[f"_right_{i}" for i in range(len(keys))])


def running(
    df: DataFrame,
    keys: Sequence[str],
    slabs: dict[str, tuple[Column, bool]],
    order: Sequence[Column],
    out: str,
    value: Column | None = None,
) -> DataFrame:
    """Add the running count (or sum of ``value``) within ``keys`` in ``order``.

    ``slabs`` names group columns from coarse to fine, each with its expression
    and whether it runs downwards; sorted together they must agree with ``order``.
    """
    amount = F.lit(1).cast("bigint") if value is None else value.cast("bigint")
    names = list(slabs)
    tagged = df.withColumns({name: expr for name, (expr, _) in slabs.items()})
    sizes = tagged.groupBy(*keys, *names).agg(F.sum(amount).alias("_amount"))
    start = None
    for depth in range(len(names), 0, -1):
        parents, name = [*keys, *names[: depth - 1]], names[depth - 1]
        level = sizes if depth == len(names) else sizes.groupBy(*keys, *names[:depth]).agg(F.sum("_amount").alias("_amount"))
        by = F.col(name).desc() if slabs[name][1] else F.col(name).asc()
        before = Window.orderBy(by) if not parents else Window.partitionBy(*parents).orderBy(by)
        before = before.rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(*keys, *names[:depth], F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias(f"_before{depth}"))
        start = level if start is None else null_safe(start, level, [*keys, *names[:depth]])
    offset = sum((F.col(f"_before{d}") for d in range(2, len(names) + 1)), F.col("_before1"))
    start = start.select(*keys, *names, offset.alias("_from"))
    inside = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = null_safe(tagged, start, [*keys, *names])
    return joined.withColumn(out, F.col("_from") + F.sum(amount).over(inside)).select(*df.columns, out)


def sums_before(df: DataFrame, group: Column, down: bool, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Add the sums over all rows before a row, in two levels: whole groups before its own, and rows before it in its group.

    ``group`` sorted (downwards if ``down``) agrees with ``order``; ``sums`` names new columns and what they add up. Only the
    groups' totals, one row each, are summed in one task.
    """
    tagged = df.withColumn("_group", group)
    totals = tagged.groupBy("_group").agg(*[F.sum(value).alias(name) for name, value in sums.items()])
    over_groups = Window.orderBy(F.col("_group").desc() if down else F.col("_group").asc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_group", *[F.coalesce(F.sum(name).over(over_groups), F.lit(0)).alias(f"_from_{name}") for name in sums])
    inside = Window.partitionBy("_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = null_safe(tagged, starts, ["_group"])
    before = {name: F.col(f"_from_{name}") + F.coalesce(F.sum(value).over(inside), F.lit(0)) for name, value in sums.items()}
    return joined.withColumns(before).select(*df.columns, *sums)


def whole_group(
    df: DataFrame,
    keys: Sequence[str],
    slab: Column,
    partial: dict[str, Column],
    combine: dict[str, Column],
    only: Column | None = None,
) -> DataFrame:
    """Add to every row values taken over its whole group.

    ``partial`` aggregates rows to one row per (keys, slab); ``combine`` are the
    expressions over those rows for the group. ``only`` limits the rows that are
    aggregated; a row whose (keys, slab) holds none of them gets NULLs.
    """
    tagged = df.withColumn("_slab", slab)
    used = tagged if only is None else tagged.where(only)
    parts = used.groupBy(*keys, "_slab").agg(*[expr.alias(name) for name, expr in partial.items()])
    group = Window.partitionBy(*keys)
    whole = parts.select(*keys, "_slab", *[expr.over(group).alias(name) for name, expr in combine.items()])
    joined = null_safe(tagged, whole, [*keys, "_slab"], "inner" if only is None else "left")
    return joined.select(*df.columns, *combine)


def attach(rows: DataFrame, info: DataFrame, key: str, slab: Column, how: str = "inner") -> DataFrame:
    """Join one-row-per-key ``info`` to ``rows`` by (key, slab) instead of by key."""
    tagged = rows.withColumn("_slab", slab)
    present = tagged.groupBy(key, "_slab").agg(F.lit(1).alias("_one")).drop("_one")
    spread = null_safe(present, info, [key])
    return null_safe(tagged, spread, [key, "_slab"], how).drop("_slab")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group; Spark cuts to n per map task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
