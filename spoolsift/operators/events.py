"""Place of events in their session, and tool calls paired with results."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolsift.model import KEY, slab_of
from spoolsift.operators.slabs import running, whole_group
from spoolsift.sources.store import kept


def number_events(events: DataFrame, slab: int | None = None) -> DataFrame:
    """Add ``pos``, the 1-based place of the event in its session."""
    order = [F.col("seq"), F.col("block")]
    return running(events, [KEY], {"_slab": (slab_of("seq", slab), False)}, order, "pos")


def pair_tools(events: DataFrame, slab: int | None = None) -> DataFrame:
    """Give results the tool of their call, and calls ``ok`` or ``err``, matched on call id in a session.

    File order is ignored. Of several calls with an id only the last is
    answered, by the last result with that id.
    """
    call, result = F.col("kind") == "tool", F.col("kind") == "result"
    # Record number and block order events as their place does, and need no numbering first.
    at = F.struct("seq", "block")
    paired = whole_group(
        events,
        [KEY, "call_id"],
        slab_of("seq", slab),
        partial={
            "_call": F.max(F.when(call, F.struct(at.alias("at"), "tool"))),
            "_result": F.max(F.when(result, F.struct(at.alias("at"), "is_error"))),
        },
        combine={"_call": F.max("_call"), "_result": F.max("_result")},
        only=(call | result) & F.col("call_id").isNotNull(),
    )
    answered = call & F.col("_result").isNotNull() & (at == F.col("_call.at"))
    state = F.when(F.col("_result.is_error"), "err").otherwise("ok")
    return paired.withColumns(
        {
            "tag": F.when(answered, state).otherwise(F.col("tag")),
            "tool": F.when(result & F.col("_call").isNotNull(), F.col("_call.tool")).otherwise(F.col("tool")),
        }
    ).drop("_call", "_result")


def ready_events(events: DataFrame, stored: bool = False) -> DataFrame:
    """Freshly parsed events, paired and numbered.

    The parsed events are written to the shared folder first (unless they are ``stored`` already), so no line is
    parsed twice. Both steps then work on a few narrow columns, and what they
    find is joined to the texts and lines once.
    """
    table = events if stored else kept(events, "events")
    row = [KEY, "seq", "block"]
    narrow = table.select(*row, "kind", "tool", "is_error", "tag", "call_id")
    found = number_events(pair_tools(narrow)).select(*row, "pos", "tool", "tag")
    return table.drop("tool", "tag").join(found, row)
