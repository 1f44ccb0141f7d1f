"""Conversations as training texts: windows of whole turns within a budget of tokens, with the spans that a loss may count.

A window holds the system turn of its conversation, some turns that the window before ended with, and then new turns. Only texts of new
assistant turns are under the loss mask, so each is learnt once. Sums of the turns' tokens say where windows end.

A turn is ``<|im_start|>role``, a line feed, its text, ``<|im_end|>`` and a line feed. A ``<`` and a ``|`` of a text with nothing or
backslashes between get one backslash more, so no text holds a mark, and taking one away gives the text back.
"""

import bisect
import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolsift.llm import encoding
from spoolsift.llm.encoding import encoder
from spoolsift.llm.tables import kept
from spoolsift.operators import slabs

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(encoding)

START, END = "<|im_start|>", "<|im_end|>"
LEARNT, RETAINED = "assistant", "system"

# Turns that are cut into windows together; a longer conversation is dealt out by so many turns.
BLOCK = 256
# Turns that a window may repeat of the one before.
REPEATED = 8


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text starts and ends in it. A role stays on one line."""
    line = escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))
    head, body = f"{START}{line}\n", escaped(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parsed(window: str) -> Iterator[tuple[str, str, int, int]]:
    """role, text, start and end of the escaped text of every turn of a window."""
    at = 0
    while at < len(window):
        if not window.startswith(START, at):
            raise ValueError(f"no turn starts at character {at}")
        line = window.index("\n", at)
        end = window.index(END, line)
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(window[at + len(START) : line]))
        yield role, unescaped(window[line + 1 : end]), line + 1, end
        at = end + len(END) + 1


def spans(tokens: list[int], first: int, system: int, budget: int, history: int) -> Iterator[tuple[int, int, int]]:
    """(history from, new from, end) of the windows over turns of so many tokens; turns before ``first`` are only repeated.

    Sums up to each turn are searched for the longest history within its own limit, and the most new turns within the budget that
    ``system`` and history leave. A window has a new turn at least, and only as much history as that turn fits beside.
    """
    before = [0]
    for n in tokens:
        before.append(before[-1] + n)
    at = first
    while at < len(tokens):
        room = budget - system
        back = max(bisect.bisect_left(before, max(before[at] - history, before[at + 1] - room), 0, at), at - REPEATED)
        end = max(bisect.bisect_right(before, before[back] + room, at + 1) - 1, at + 1)
        yield back, at, end
        at = end


_WINDOW_FIELDS = [
    *(("first_turn", pa.int64()), ("turns", pa.int32()), ("repeated", pa.int32()), ("tokens", pa.int64()), ("text", pa.string())),
    ("loss", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
]
_WINDOW = "first_turn long, turns int, repeated int, tokens long, text string, loss array<struct<start:int,length:int>>"


def chat_windows(conversations: DataFrame, vocabulary: str, budget: int = 4096, history: int = 512) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text): conv_id, first_turn (place of its first new turn, from 0), turns (new ones),
    repeated (turns before them in the text), tokens, text, and loss (start and length in the text, in code points).

    A turn is never cut: one that exceeds the budget beside the system turn stands with that alone. The system turn, if the
    first turn has that role, starts every window; after it come turns of up to ``history`` tokens that were new in windows before,
    REPEATED at most. Turns come by number, nulls first, then by role and text; null roles and texts are empty, null ids are one
    conversation, repeated rows are turns of their own. An empty table has no windows. Extra columns are ignored.

    A conversation is cut into blocks of BLOCK turns that tasks work on apart; a block is given the system turn and the last turns before it.
    """
    plain = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), plain("role"), plain("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.withColumns({"_key": F.xxhash64("role", "text"), "_row": F.monotonically_increasing_id()})
    counted = kept(rows.mapInArrow(_counter(vocabulary), f"conv_id {kind}, turn long, role string, text string, _key long, _row long, tokens long"), "turns")
    slab = {"_slab": (F.floor(F.col("turn") / 1024), False)}
    order = [F.col("turn").asc_nulls_first(), F.col("_key"), F.col("_row")]
    placed = slabs.running(counted, ["conv_id"], slab, order, "_place").withColumn("_place", F.col("_place") - 1)
    placed = kept(placed.select("conv_id", "role", "text", "tokens", "_place"), "places")

    block = F.floor(F.col("_place") / BLOCK).cast("long")
    own = placed.withColumns({"_block": block, "_what": F.lit(2)})
    # The end of a block also goes to the next one, the system turn of a long conversation to all others.
    last = placed.where(F.col("_place") % BLOCK >= BLOCK - REPEATED).withColumns({"_block": block + 1, "_what": F.lit(1)})
    long = placed.groupBy(F.col("conv_id").alias("_long")).agg(F.max(block).alias("_last")).where("_last > 0")
    system = placed.where((F.col("_place") == 0) & (F.col("role") == RETAINED))
    system = system.join(long, F.col("conv_id").eqNullSafe(F.col("_long")))
    system = system.withColumn("_block", F.explode(F.sequence(F.lit(1).cast("long"), "_last"))).withColumn("_what", F.lit(0))
    names = ("conv_id", "_block", "_what", "_place", "role", "text", "tokens")
    dealt = own.select(*names).unionByName(last.select(*names)).unionByName(system.select(*names)).repartition("conv_id", "_block")
    dealt = dealt.sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in names[:4]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *_WINDOW_FIELDS])
            out: list[dict] = []
            for conv, number, *row in zip(*(batch[name].to_pylist() for name in names)):
                if group is not None and (conv, number) != group:
                    out += _windows(group[0], held, budget, history)
                    held = []
                group = conv, number
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)
        if group is not None:
            yield pa.RecordBatch.from_pylist([*_windows(group[0], held, budget, history)], schema)

    windows = dealt.mapInArrow(work, f"conv_id {kind}, {_WINDOW}")
    # A block without new turns gives none: the end of a conversation whose length is a multiple of BLOCK.
    return windows.where("turns > 0")


def _counter(vocabulary: str):
    """The rows with the tokens of each formatted turn."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        for batch in batches:
            turns = zip(batch["role"].to_pylist(), batch["text"].to_pylist())
            tokens = [len(words.encode(formatted(role, text)[0])) // 4 for role, text in turns]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64())], [*batch.schema.names, "tokens"])

    return count


def _windows(conv, rows: list[tuple], budget: int, history: int) -> Iterator[dict]:
    """Windows of one block's rows (what, place, role, text, tokens), in order: system turn, turns before, own turns."""
    own = next((k for k, row in enumerate(rows) if row[0] == 2), len(rows))
    if own == len(rows):
        return
    has_system = rows[0][0] == 0 or (rows[0][1] == 0 and rows[0][2] == RETAINED)
    system = rows[0] if has_system else None
    if rows[0][0] == 0:
        rows, own = rows[1:], own - 1
    turns = [formatted(role, text) for _, _, role, text, _ in rows]
    tokens = [row[4] for row in rows]
    # The system turn of the block's own rows is new in the first window and retained from then on; it is never history.
    for back, at, end in spans(tokens, own, 0, budget, history) if system is None else _with_system(rows, tokens, own, system, budget, history):
        kept_turn = system is not None and rows[at][1] != 0
        if kept_turn and rows[back][1] == 0:
            back += 1
        parts = [formatted(system[2], system[3])] if kept_turn else []
        parts += turns[back:end]
        repeated = len(parts) - (end - at)
        loss, size = [], 0
        for k, (text, start, stop) in enumerate(parts):
            if k >= repeated and rows[at + k - repeated][2] == LEARNT and stop > start:
                loss.append({"start": size + start, "length": stop - start})
            size += len(text)
        yield {
            "conv_id": conv,
            "first_turn": rows[at][1],
            "turns": end - at,
            "repeated": repeated,
            "tokens": (system[4] if kept_turn else 0) + sum(tokens[back:end]),
            "text": "".join(text for text, _, _ in parts),
            "loss": loss,
        }


def _with_system(rows, tokens, own, system, budget, history) -> Iterator[tuple[int, int, int]]:
    """Spans of a block whose windows all start with the system turn; where it is the block's own first row, it costs once."""
    if rows[own][1] != 0:
        yield from spans(tokens, own, system[4], budget, history)
        return
    _, _, end = next(spans(tokens, own, 0, budget, history))
    yield own, own, end
    # As history the system turn costs nothing, as it is there anyway.
    yield from spans([0, *tokens[1:]], end, system[4], budget, history)


def turns_of(windows: DataFrame) -> DataFrame:
    """The turns read back from windows, each once: conv_id, place, role, text, learnt (its text under the loss mask, else null)."""
    kind = windows.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("place", pa.int64()), *((n, pa.string()) for n in ("role", "text", "learnt"))])
            rows = zip(*(batch[name].to_pylist() for name in ("conv_id", "first_turn", "repeated", "text", "loss")))
            out = [(conv, *turn) for conv, first, repeated, text, loss in rows for turn in new_turns(first, repeated, text, loss)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)

    columns = windows.select("conv_id", "first_turn", "repeated", "text", "loss")
    return columns.mapInArrow(work, f"conv_id {kind}, place long, role string, text string, learnt string")


def new_turns(first: int, repeated: int, window: str, loss: list[dict]) -> Iterator[tuple[int, str, str, str | None]]:
    """place, role, text and what the mask covers of it, of the turns that a window does not repeat."""
    under = {span["start"]: span["start"] + span["length"] for span in loss}
    for k, (role, text, start, end) in enumerate(parsed(window)):
        covered = under.pop(start, None)
        if k >= repeated:
            yield first + k - repeated, role, text, None if covered is None else unescaped(window[start:covered])
        elif covered is not None:
            raise ValueError("a repeated turn is under the mask")
    if under:
        raise ValueError("the mask covers more than texts of turns")


def digests(windows: DataFrame) -> DataFrame:
    """What windows hold, read back from them: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    turns_sha256 is of role, line feed, text, line feed of every turn in order; the loss is all that masks cover, without anything
    between. A digest is one pass over a conversation's windows in order; they stream through a task that holds one of them.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()
    fields = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())]
    fields += [("formatted_chars", pa.int64()), ("n_windows", pa.int64())]
    names = ("conv_id", "first_turn", "repeated", "text", "loss")
    dealt = windows.select(*names).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "first_turn")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def row() -> tuple:
            return state["conv"], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"], state["windows"]

        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *fields])
            out = []
            for k in range(batch.num_rows):
                conv, first, repeated, text, loss = (batch[name][k].as_py() for name in names)
                if state is None or conv != state["conv"]:
                    if state is not None:
                        out.append(row())
                    state = {"conv": conv, "turns": 0, "chars": 0, "size": 0, "windows": 0, "all": hashlib.sha256(), "loss": hashlib.sha256()}
                if first != state["turns"]:
                    raise ValueError(f"the windows of conversation {conv} have no turn {state['turns']}")
                for _, role, said, learnt in new_turns(first, repeated, text, loss):
                    state["all"].update(f"{role}\n{said}\n".encode())
                    state["loss"].update((learnt or "").encode())
                    state["chars"] += len(learnt or "")
                    state["turns"] += 1
                state["size"] += len(text)
                state["windows"] += 1
            yield _table(out, schema)
        if state is not None:
            yield _table([row()], schema)

    return dealt.mapInArrow(work, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)
