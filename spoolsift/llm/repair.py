"""Conversations whose turns are out of order, cut short, empty or repeated, brought back to a form that can be trained on.

Each row is kept, given another role or deleted, and empty rows may be inserted, at the least cost that leaves an optional system
turn and then pairs of a user and an assistant turn. The edits' initials are the audit of a conversation.

Ways to edit the rows so far are strings that share their beginnings: nodes linked to the node before, as nothing that was found is ever
changed. Of two equally dear strings the smaller one is found by a search for what they begin with in common: every node knows
its ancestors 1, 2, 4, ... edits back and a rolling hash of all its edits, and a prefix that the hashes call common is checked by
its letters.

Long conversations are cut into runs. A run is worked out for every state it may begin in, and the outcomes are joined in order, so
that one conversation of any length is spread over the tasks.
"""

import hashlib
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolsift.llm.tables import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Costs of edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# What has been read: nothing, the system turn, a user turn, an assistant turn. Where each role leads, and where one may end.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
LEADS = {(EMPTY, "s"): SYSTEM, **{(state, "u"): USER for state in (EMPTY, SYSTEM, ASSISTANT)}, (USER, "a"): ASSISTANT}
ENDS = (EMPTY, ASSISTANT)
# From each state the one role that may be inserted, or given to a row.
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}

# Faults of a row.
BLANK, DUPLICATE, TRUNCATED_ROW = 1, 2, 3

# Rows of one run: what a task holds of the strings at a time.
RUN = 2_000
SPACE = " \t\n\x0b\x0c\r"
MODULUS, BASE = (1 << 61) - 1, 0x1B873593


class Edits:
    """Strings of edits as linked nodes; node 0 is the empty string."""

    def __init__(self):
        self.letter = [0]
        self.depth = [0]
        self.hash = [0]
        self.back: list[list[int]] = [[0]]

    def add(self, node: int, letter: int) -> int:
        """The string of ``node`` and one more letter."""
        new = len(self.letter)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + letter + 1) % MODULUS)
        for level, ups in enumerate(self.back):
            ups.append(node if level == 0 else self.back[level - 1][self.back[level - 1][new]])
        if self.depth[new] >> len(self.back):
            last = self.back[-1]
            self.back.append([last[up] for up in last])
        return new

    def lifted(self, node: int, depth: int) -> int:
        """The node's ancestor at a depth that is not below its own."""
        for level in range(len(self.back) - 1, -1, -1):
            if self.depth[node] - (1 << level) >= depth:
                node = self.back[level][node]
        return node

    def smaller(self, a: int, b: int) -> bool:
        """Is the string of ``a`` before that of ``b``?"""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lifted(a, depth), self.lifted(b, depth)
        if self.hash[x] == self.hash[y]:
            return self._by_letters(x, y, self.depth[a] < self.depth[b])
        # Up to just below what they have in common, as far as the hashes tell.
        for ups in reversed(self.back):
            if self.hash[ups[x]] != self.hash[ups[y]]:
                x, y = ups[x], ups[y]
        return self._by_letters(self.back[0][x], self.back[0][y], self.letter[x] < self.letter[y])

    def _by_letters(self, x: int, y: int, otherwise: bool) -> bool:
        """The order that letters of two nodes of one depth give; ``otherwise`` if they are equal, as their hashes say."""
        found = otherwise
        while x != y:
            if self.letter[x] != self.letter[y]:
                found = self.letter[x] < self.letter[y]
            x, y = self.back[0][x], self.back[0][y]
        return found

    def text(self, node: int) -> str:
        out = bytearray()
        while node:
            out.append(self.letter[node])
            node = self.back[0][node]
        return out[::-1].decode("ascii")


Best = dict[int, tuple[int, int]]


def _offer(edits: Edits, best: Best, state: int, cost: int, node: int, letter: str) -> None:
    """Take a way to ``state`` if it is cheaper than the one known, or as cheap and its string smaller."""
    known = best.get(state)
    if known is not None and known[0] < cost:
        return
    new = edits.add(node, ord(letter))
    if known is None or cost < known[0] or edits.smaller(new, known[1]):
        best[state] = cost, new


def inserted(edits: Edits, best: Best) -> Best:
    """Also with empty rows inserted here; more than two never pay."""
    out = dict(best)
    for _ in range(2):
        for state, (cost, node) in sorted(out.items()):
            _offer(edits, out, NEXT[state], cost + INSERT, node, "I")
    return out


def edited(edits: Edits, best: Best, initial: str, fault: int) -> Best:
    """After one more row."""
    out: Best = {}
    for state, (cost, node) in sorted(inserted(edits, best).items()):
        _offer(edits, out, state, cost + DELETE, node, "D")
        if fault in (BLANK, DUPLICATE):
            continue
        stays = cost + (TRUNCATED if fault == TRUNCATED_ROW else 0)
        if (state, initial) in LEADS:
            _offer(edits, out, LEADS[state, initial], stays, node, "K")
        _offer(edits, out, NEXT[state], stays + REROLE, node, "R")
    return out


Ways = list[tuple[int, int, int, str]]


def run_ways(rows: Iterable[tuple[str, int]], starts: Iterable[int]) -> Ways:
    """(from, to, cost, edits): the best way through the rows (initial, fault) from each start to each state."""
    rows = list(rows)
    ways = []
    for start in starts:
        edits = Edits()
        best: Best = {start: (0, 0)}
        for initial, fault in rows:
            best = edited(edits, best, initial, fault)
        ways += [(start, state, cost, edits.text(node)) for state, (cost, node) in sorted(best.items())]
    return ways


class Joined:
    """Runs of one conversation, one after the other: states with their cost and the linked strings of the runs so far.

    Equally dear strings over the same rows never begin one with the other (what is more would be inserts, which cost), so
    the first runs in which two ways differ decide, and a way that loses inside a run loses for good.
    """

    def __init__(self):
        self.text = [""]
        self.depth = [0]
        self.back: list[list[int]] = [[0]]
        self.best: Best = {EMPTY: (0, 0)}

    def add(self, ways: Ways) -> None:
        out: Best = {}
        for start, state, cost, text in ways:
            if start not in self.best:
                continue
            before, node = self.best[start]
            known = out.get(state)
            if known is not None and known[0] < before + cost:
                continue
            new = self._node(node, text)
            if known is None or before + cost < known[0] or self._smaller(new, known[1]):
                out[state] = before + cost, new
        self.best = out

    def end(self) -> tuple[int, str]:
        """Cost and audit of the whole conversation."""
        tail = [(start, state, cost, text) for start in self.best for state, cost, text in _tails(start)]
        self.add(tail)
        (cost, node), *others = [self.best[state] for state in ENDS if state in self.best]
        for other in others:
            if other[0] < cost or (other[0] == cost and self._smaller(other[1], node)):
                cost, node = other
        parts = []
        while node:
            parts.append(self.text[node])
            node = self.back[0][node]
        return cost, "".join(reversed(parts))

    def _node(self, node: int, text: str) -> int:
        new = len(self.text)
        self.text.append(text)
        self.depth.append(self.depth[node] + 1)
        for level, ups in enumerate(self.back):
            ups.append(node if level == 0 else self.back[level - 1][self.back[level - 1][new]])
        if self.depth[new] >> len(self.back):
            last = self.back[-1]
            self.back.append([last[up] for up in last])
        return new

    def _smaller(self, a: int, b: int) -> bool:
        """Both of as many runs. Lifted to just below the last node that they share, then compared by their letters."""
        x, y = a, b
        for ups in reversed(self.back):
            if ups[x] != ups[y]:
                x, y = ups[x], ups[y]
        left, right = self.text[x], self.text[y]
        if x == a or not (left.startswith(right) or right.startswith(left)):
            return left < right
        return self._since(a, self.back[0][x]) < self._since(b, self.back[0][y])

    def _since(self, node: int, ancestor: int) -> str:
        parts = []
        while node != ancestor:
            parts.append(self.text[node])
            node = self.back[0][node]
        return "".join(reversed(parts))


def _tails(start: int) -> list[tuple[int, int, str]]:
    """(state, cost, edits): inserts after the last row."""
    edits = Edits()
    return [(state, cost, edits.text(node)) for state, (cost, node) in inserted(edits, {start: (0, 0)}).items()]


def best_edits(rows: Iterable[tuple[str, int]]) -> tuple[int, str]:
    """Cost and audit of one conversation's rows (initial of the role, fault)."""
    joined = Joined()
    joined.add(run_ways(rows, [EMPTY]))
    return joined.end()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by a rule: conv_id, turn, role, text. Nulls of role and text, and in the rule's key, are one space.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes out `.`, `!` and `?`, 3 repeats it next to
    itself, 4 makes its role user.
    """
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rule = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), rule.alias("_rule"))
    text = F.when(F.col("_rule") == 1, "").when(F.col("_rule") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_rule") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_rule") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.where("_rule <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy"))
    return rows.drop("_copy")


def _fault(repeated: Column) -> Column:
    """The first fault that a row has, else 0."""
    bare = F.trim(F.col("text"), F.lit(SPACE))
    sound = F.right(bare, F.lit(1)).isin(".", "!", "?")
    return F.when(bare == "", BLANK).when(repeated, DUPLICATE).when(~sound, TRUNCATED_ROW).otherwise(0)


_ORDER = ("conv_id", "turn", "role", "_text", "_row")
_RUNS = "conv_id {id}, part int, run int, first string, last string, illegal long, faults array<long>, ways array<struct<start:int,state:int,cost:long,edits:string>>"


def repair(rows: DataFrame) -> DataFrame:
    """What is wrong with each conversation of ``rows`` (conv_id, turn, role, text) and how to mend it at the least cost.

    conv_id, gaps (turn numbers missing between the smallest and the largest), blank, duplicate, truncated (each row's first
    fault), illegal (neighbours whose roles' initials are not su, ua or au), cost, audit (initials of the edits Keep, Rerole, Delete and
    Insert in order; of equally cheap ones the least in ASCII), repaired_sha256 (of ``role:text`` lines after the edits).

    A conversation's rows come by turn, nulls first, then by role and text; null roles and texts are one space, and an empty role
    has no initial. Null ids are one conversation. Repeated rows are duplicates. Without rows there is no conversation, and an
    empty table gives none. Extra columns are ignored.

    Rows are dealt by ranges of (conversation, turn), so a long conversation is spread; tasks hold a run of RUN rows at a time. The digest is
    by nature one pass over a conversation's text in order: it streams through one task, which holds one audit and no rows.
    """
    spaced = lambda name: F.coalesce(F.col(name), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"))
    # Written once: the numbers of rows must be the same in all passes.
    rows = kept(rows.withColumns({"_text": F.sha2("text", 256), "_row": F.monotonically_increasing_id()}), "turns")
    place = F.struct(F.col("turn").isNotNull(), "turn", "_row")
    repeats = rows.groupBy("conv_id", "role", "_text").agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
    repeats = repeats.where("_n > 1").select(*(F.col(c).alias(f"_{c}_") for c in ("conv_id", "role", "_text")), "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id_")) & (F.col("role") == F.col("_role_")) & (F.col("_text") == F.col("__text_"))
    marked = rows.withColumn("_place", place).join(repeats, same, "left")
    fault = _fault(F.coalesce(F.col("_place") != F.col("_first"), F.lit(False)))
    narrow = marked.select("conv_id", "turn", "role", "_text", "_row", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))
    order = [F.col(c).asc_nulls_first() for c in _ORDER]
    dealt = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = rows.schema["conv_id"].dataType.simpleString()
    runs = kept(dealt.select("conv_id", "initial", "fault").mapInArrow(_runs, _RUNS.format(id=kind)), "runs")

    by_place = ("conv_id", "part", "run")
    spread = runs.repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in by_place))
    counts = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    mended = kept(spread.mapInArrow(_joined, f"conv_id {kind}, {counts}"), "audits")

    # Each conversation's audit comes before its rows.
    audits = mended.select("conv_id", F.lit(0).alias("_kind"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("_text", "string"), ("_row", "long"), ("text", "string"))), "audit")
    lines = rows.select("conv_id", F.lit(1).alias("_kind"), "turn", "role", "_text", "_row", "text", F.lit(None).cast("string").alias("audit"))
    together = audits.unionByName(lines).repartition("conv_id")
    in_order = together.sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv_id", "_kind", *_ORDER[1:])))
    digests = in_order.select("conv_id", "role", "text", "audit").mapInArrow(_digests, f"_conv {kind}, repaired_sha256 string")

    turns = rows.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("_one"))
    gaps = turns.groupBy(F.col("conv_id").alias("_gap_conv")).agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("_gaps"))
    whole = mended.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv"))).join(gaps, F.col("conv_id").eqNullSafe(F.col("_gap_conv")), "left")
    return whole.select(
        "conv_id",
        F.coalesce("_gaps", F.lit(0).cast("long")).alias("gaps"),
        *("blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the rows of one range, in order."""
    part = TaskContext.get().partitionId()
    out: list[dict] = []
    held: list[tuple[str, int]] = []
    number = 0

    def close(conv) -> None:
        pairs = [a[0] + b[0] for a, b in zip(held, held[1:])]
        # A conversation may have begun in a range before this one.
        starts = [EMPTY] if number and whole else range(4)
        out.append(
            {
                "conv_id": conv,
                "part": part,
                "run": number,
                "first": held[0][0],
                "last": held[-1][0],
                "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
                "faults": [sum(f == kind for _, f in held) for kind in (BLANK, DUPLICATE, TRUNCATED_ROW)],
                "ways": [dict(zip(("start", "state", "cost", "edits"), w)) for w in run_ways(held, starts)],
            }
        )

    current, whole, schema = None, False, None
    for batch in batches:
        schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *_RUN_FIELDS])
        for row in zip(*(batch[name].to_pylist() for name in ("conv_id", "initial", "fault"))):
            if held and (row[0] != current or len(held) >= RUN):
                close(current)
                held.clear()
                number += 1
                whole = row[0] != current
            current = row[0]
            held.append(row[1:])
            if len(out) >= 1_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
    if held:
        close(current)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


_WAY = pa.struct([("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
_RUN_FIELDS = [("part", pa.int32()), ("run", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("faults", pa.list_(pa.int64())), ("ways", pa.list_(_WAY))]
_AUDIT_FIELDS = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its runs in order."""
    out: list[tuple] = []
    state = None

    def close() -> None:
        cost, audit = state["joined"].end()
        out.append((state["conv"], *state["faults"], state["illegal"], cost, audit))

    def table(schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    schema = None
    for batch in batches:
        schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *_AUDIT_FIELDS])
        for k in range(batch.num_rows):
            r = {name: batch[name][k].as_py() for name in ("conv_id", "first", "last", "illegal", "faults", "ways")}
            if state is None or r["conv_id"] != state["conv"]:
                if state is not None:
                    close()
                state = {"conv": r["conv_id"], "joined": Joined(), "faults": [0, 0, 0], "illegal": 0, "last": None}
            elif state["last"] + r["first"] not in ("su", "ua", "au"):
                state["illegal"] += 1
            state["joined"].add([tuple(w.values()) for w in r["ways"]])
            state["faults"] = [a + b for a, b in zip(state["faults"], r["faults"])]
            state["illegal"] += r["illegal"]
            state["last"] = r["last"]
            if len(out) >= 1_000:
                yield table(schema)
                out.clear()
    if state is not None:
        close()
        yield table(schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's repaired lines; its audit comes before its rows."""
    out: list[tuple] = []
    digest = None
    audit, at, state, first = "", 0, EMPTY, True
    conv = None

    def line(role: str, text: str) -> None:
        nonlocal first
        digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = NEXT[state]
            line("user" if state == USER else "assistant", "")
            at += 1

    def close() -> None:
        inserts()
        out.append((conv, digest.hexdigest()))

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv_id, role, text, edits in zip(*(batch[name].to_pylist() for name in ("conv_id", "role", "text", "audit"))):
            if edits is not None:
                if digest is not None:
                    close()
                conv, digest, audit, at, state, first = conv_id, hashlib.sha256(), edits, 0, EMPTY, True
                continue
            inserts()
            if audit[at] == "K":
                state = LEADS[state, role[:1]]
                line(role, text)
            elif audit[at] == "R":
                state = NEXT[state]
                line("user" if state == USER else "assistant", text)
            at += 1
        if len(out) >= 1_000:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([d for _, d in out])], ["_conv", "repaired_sha256"])
            out.clear()
    if digest is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([d for _, d in out])], ["_conv", "repaired_sha256"])


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows, for every conversation given: one that lost all its rows has zeros and empty texts."""
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "_found")
    ids = conversations.select("conv_id").distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left").drop("_found")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
