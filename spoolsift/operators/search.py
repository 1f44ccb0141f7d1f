"""Search of event text: ranked sessions, hits in order, context windows, totals."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoolsift.functions.patterns import matches
from spoolsift.functions.text import SCAN_BUDGET, event_line, event_number, preview, short_id, title_cell
from spoolsift.functions.times import is_live
from spoolsift.model import KEY, slab_of
from spoolsift.operators.slabs import attach, null_safe, running, sums_before
from spoolsift.sources.store import BROADCAST_ROWS, kept

SORTS = ("matches", "started")
# A context window prints at least one line with mark, id, number, clock and role, and a rule below.
_LEAST_WINDOW = 29


def find(events: DataFrame, pattern: str, fixed: bool = False, ignore_case: bool = False) -> DataFrame:
    """Events whose text holds the pattern."""
    return events.where((F.col("text") != "") & matches(F.col("text"), pattern, fixed, ignore_case))


def search_table(
    events: DataFrame,
    sessions: DataFrame,
    pattern: str,
    now: datetime | Column,
    fixed: bool = False,
    ignore_case: bool = False,
    include_all: bool = False,
    sort: str = "matches",
    limit: int = 0,
) -> DataFrame:
    """Per session the matching events and the first matching record, best first."""
    if sort not in SORTS:
        raise ValueError(f"sort takes {' or '.join(SORTS)}, not {sort!r}")
    counts = find(events, pattern, fixed, ignore_case).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("matches"), F.min("seq").alias("first")
    )
    rows = sessions.join(counts, KEY, "left" if include_all else "inner")
    newest = [F.desc("started"), F.desc("session_id"), F.desc(KEY)]
    order = [F.desc("matches"), *newest] if sort == "matches" else [F.asc("started"), *newest[1:]]
    ranked = rows.withColumn("matches", F.coalesce("matches", F.lit(0))).orderBy(*order)
    return (ranked.limit(limit) if limit else ranked).select(
        "session_id",
        short_id(F.col("provider"), F.col("session_id")).alias("short_id"),
        "matches",
        F.coalesce("first", F.lit(0)).alias("first"),
        F.left("started", F.lit(10)).alias("started"),
        is_live(F.col("ended"), now).alias("live"),
        title_cell(F.col("name"), F.col("title")).alias("title"),
    )


def search_totals(
    events: DataFrame, sessions: DataFrame, pattern: str, fixed: bool = False, ignore_case: bool = False
) -> DataFrame:
    """One row: matching events, sessions with a match, sessions scanned; no cap applies."""
    per_session = find(events, pattern, fixed, ignore_case).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    hits = per_session.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.count(F.lit(1)).alias("sessions_matched")
    )
    return hits.crossJoin(sessions.agg(F.count(F.lit(1)).alias("sessions_scanned")))  # one row by one row


def search_sessions(
    events: DataFrame,
    sessions: DataFrame,
    pattern: str,
    fixed: bool = False,
    ignore_case: bool = False,
    limit: int | None = None,
    budget: int = SCAN_BUDGET,
) -> DataFrame:
    """Sessions with at least one match, newest first, under the same caps as hits."""
    found = find(events, pattern, fixed, ignore_case).select(KEY).distinct()
    matched = sessions.join(found, KEY, "left_semi")
    rows = matched.select(
        KEY, "session_id", "started", short_id(F.col("provider"), F.col("session_id")).alias("short_id")
    )
    order = [F.desc("started"), F.desc("session_id"), F.desc(KEY)]
    budget = 0 if limit == 0 else budget
    most = _most(budget, limit)
    if most is None:
        return rows.orderBy(*order).select("session_id", "short_id")
    near = rows.orderBy(*order).limit(most).withColumn("_slab", F.lit(0).cast("bigint"))
    kept_rows = _within(near.withColumn("_cost", F.length("short_id") + 1), [F.col("_slab")], budget, limit)
    return kept_rows.select("session_id", "short_id")


def search_hits(
    events: DataFrame,
    sessions: DataFrame,
    pattern: str,
    fixed: bool = False,
    ignore_case: bool = False,
    limit: int | None = None,
    budget: int = SCAN_BUDGET,
    raw: bool = False,
) -> DataFrame:
    """Matching events, newest session first, until the row cap or the character budget ends the list.

    ``limit`` 0 gives every hit. A hit costs the length of its printed row.
    ``raw`` adds the source lines and lifts the budget.
    """
    lines = ["line"] if raw else []
    found = find(events, pattern, fixed, ignore_case).select(
        KEY,
        "seq",
        "block",
        "role",
        *lines,
        preview(F.col("text")).alias("preview"),
        short_id(F.col("provider"), F.col("session_id")).alias("short_id"),
    )
    row = F.concat_ws("\t", "short_id", event_number(F.col("seq")), "role", F.concat(F.lit('"'), "preview", F.lit('"')))
    capped = first_in_scope(found, sessions, F.length(row) + 1, 0 if limit == 0 or raw else budget, limit)
    return capped.select("session_id", "short_id", "started", "seq", "block", "role", "preview", *lines)


def search_context(
    events: DataFrame,
    sessions: DataFrame,
    pattern: str,
    context: int,
    fixed: bool = False,
    ignore_case: bool = False,
    limit: int | None = None,
    budget: int = SCAN_BUDGET,
) -> DataFrame:
    """Every hit with ``context`` events before and after it; windows of near hits repeat events.

    ``events`` carry ``pos``. A window counts against the budget as a whole.
    """
    budget = 0 if limit == 0 else budget
    found = find(events, pattern, fixed, ignore_case).select(KEY, "seq", "block", "pos")
    # No window is cheaper than this, so the hits kept here hold all that fit.
    near = first_in_scope(found, sessions, F.lit(_LEAST_WINDOW), budget, limit)
    hits = near.select(
        KEY, "session_id", "started", F.col("seq").alias("hit_seq"), F.col("block").alias("hit_block"), F.col("pos").alias("hit_pos")
    )
    around = hits.withColumn(
        "pos",
        F.explode(F.sequence(F.greatest(F.col("hit_pos") - context, F.lit(1)), F.col("hit_pos") + context)),
    )
    most = _most(budget // _LEAST_WINDOW + 1 if budget else 0, limit)
    if most is not None and most * (2 * context + 1) <= BROADCAST_ROWS:
        around = F.broadcast(around)
    shown = events.drop("session_id").join(around, [KEY, "pos"]).select(
        KEY,
        "session_id",
        "started",
        "hit_seq",
        "hit_block",
        "pos",
        "seq",
        (F.col("pos") == F.col("hit_pos")).alias("is_hit"),
        "role",
        "kind",
        event_line().alias("event_line"),
        short_id(F.col("provider"), F.col("session_id")).alias("short_id"),
    )
    columns = ["session_id", "hit_seq", "hit_block", "pos", "seq", "is_hit", "role", "kind", "event_line"]
    if _most(budget, limit) is None:
        return shown.select(*columns)
    # mark, id, number, clock (8), role (5 wide), event line, and the line end
    width = (
        F.lit(1 + 1 + 1 + 1 + 8 + 1 + 1 + 1)
        + F.length("short_id")
        + F.length(event_number(F.col("seq")))
        + F.greatest(F.length("role"), F.lit(5))
        + F.length("event_line")
    )
    costs = shown.groupBy(KEY, "session_id", "started", "hit_seq", "hit_block").agg(
        (F.sum(width) + 3).alias("_cost")
    )
    inside = [F.asc("hit_seq"), F.asc("hit_block")]
    fits = _within(costs.withColumn("_slab", slab_of("hit_seq")), inside, budget, limit).select(KEY, "hit_seq", "hit_block")
    return shown.join(fits, [KEY, "hit_seq", "hit_block"], "left_semi").select(*columns)


def search_context_merged(
    events: DataFrame,
    sessions: DataFrame,
    pattern: str,
    context: int,
    fixed: bool = False,
    ignore_case: bool = False,
) -> DataFrame:
    """Every event that is a hit or at most ``context`` events from one, once: windows that overlap or touch are one group.

    ``group`` numbers the groups of a session from 1. Only the hits' places are worked on; texts are read for the rows shown. A
    session's hits are joined slab by slab, so that one with most of the hits is spread.
    """
    hits = kept(find(events, pattern, fixed, ignore_case).select(KEY, "pos"), "hits")
    slab = slab_of("pos")
    tagged = hits.withColumn("_slab", slab)
    ends = tagged.groupBy(KEY, "_slab").agg(F.max("pos").alias("_last"))
    earlier = Window.partitionBy(KEY).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(KEY, "_slab", F.max("_last").over(earlier).alias("_before"))
    inside = Window.partitionBy(KEY, "_slab").orderBy("pos")
    placed = null_safe(tagged, ends, [KEY, "_slab"]).withColumn("_prev", F.coalesce(F.lag("pos").over(inside), F.col("_before")))
    opens = F.col("_prev").isNull() | (F.col("pos") - F.col("_prev") > 2 * context + 1)
    grouped = kept(placed.select(KEY, "pos", "_prev", opens.cast("bigint").alias("_opens")), "opens")
    grouped = running(grouped, [KEY], {"_slab": (slab, False)}, [F.col("pos")], "group", F.col("_opens"))
    # What the hit before covers is its own, so that every place comes once.
    first = F.greatest(F.col("pos") - context, F.coalesce(F.col("_prev") + context + 1, F.lit(1)), F.lit(1))
    covered = F.when(first <= F.col("pos") + context, F.sequence(first, F.col("pos") + context))
    around = grouped.select(KEY, "group", F.explode(covered).alias("pos"))
    marked = null_safe(around, hits.withColumn("is_hit", F.lit(True)), [KEY, "pos"], "left")
    info = sessions.select(KEY, "session_id", "started")
    shown = null_safe(events.drop("session_id", "started"), marked, [KEY, "pos"])
    named = attach(shown, info, KEY, slab_of("pos"))
    return named.select(
        *("provider", "project", "session_id", KEY, "started", "group", "pos", "seq"),
        F.coalesce("is_hit", F.lit(False)).alias("is_hit"),
        *("role", "kind"),
        event_line().alias("event_line"),
    )


def first_in_scope(
    found: DataFrame, sessions: DataFrame, cost: Column, budget: int = 0, limit: int | None = None
) -> DataFrame:
    """Rows in order of newest session and record until the budget or the row cap is spent.

    Costs are summed per slab first, then per day, so that what comes before a row is known from a few sums and no task sees
    all rows. Slabs that lie behind the cut are left out before the rows are read. The
    rows found are kept, so that the texts are searched once.
    """
    found = kept(found.withColumn("_cost", cost.cast("bigint")), "found")
    info = sessions.select(KEY, "session_id", "started")
    if _most(budget, limit) is None:
        return attach(found.drop("session_id", "started", "_cost"), info, KEY, slab_of("seq"))
    tagged = found.drop("session_id", "started").withColumn("_slab", slab_of("seq"))
    return _within(tagged, [F.asc("seq"), F.asc("block")], budget, limit, info)


def _most(budget: int, limit: int | None) -> int | None:
    """Most rows any capped view can show, None where there is no cap."""
    caps = [cap for cap in (budget, limit or 0) if cap > 0]
    return min(caps) if caps else None


def _within(rows: DataFrame, inside: list[Column], budget: int, limit: int | None, info: DataFrame | None = None) -> DataFrame:
    """The exact cut, newest session first: the first row always stays, the first overflow ends the list.

    ``rows`` have _slab and _cost and come in the order ``inside`` within it; session_id and started are theirs or those of
    ``info``. What is before a row is what is before its slab, which is summed up by days, and in its slab.
    """
    names = ["session_id", "started"]
    keys = [KEY, *([] if info is not None else names), "_slab"]
    sizes = rows.groupBy(*keys).agg(F.sum("_cost").alias("_size"), F.count(F.lit(1)).alias("_count"))
    sizes = sizes if info is None else sizes.join(info, KEY)
    order = [F.desc("started"), F.desc("session_id"), F.desc(KEY), F.asc("_slab")]
    # A row costs a character at least, so slabs beyond that many hold nothing that is shown.
    sizes = sizes.orderBy(*order).limit(_most(budget, limit))
    near = sums_before(sizes, F.left("started", F.lit(10)), True, order, {"_chars": "_size", "_rows": "_count"})
    open_still = F.lit(True)
    if budget > 0:
        open_still &= F.col("_chars") <= budget
    if limit:
        open_still &= F.col("_rows") < limit
    near = near.where(open_still).select(KEY, "_slab", *names, "_chars", "_rows")
    joined = null_safe(rows.drop(*names), near, [KEY, "_slab"])
    ordered = Window.partitionBy(KEY, "_slab").orderBy(*inside)
    placed = joined.withColumns(
        {
            "_place": F.col("_rows") + F.row_number().over(ordered),
            "_sum": F.col("_chars") + F.sum("_cost").over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    keep = F.lit(True)
    if budget > 0:
        keep &= (F.col("_place") == 1) | (F.col("_sum") <= budget)
    if limit:
        keep &= F.col("_place") <= limit
    return placed.where(keep).orderBy(*order, *inside)
