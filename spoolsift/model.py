"""Column layout shared by all operators.

A session is one log file, so ``path`` is the key of every per-session step.
Long sessions are worked on in slabs of ``SLAB`` records: steps that need a
whole session combine small per-slab results first, so no task has to hold one.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = "path"
SLAB = 50_000

EVENT_COLUMNS = (
    "provider",
    "project",
    "session_id",
    "path",
    "seq",
    "block",
    "ts",
    "role",
    "kind",
    "text",
    "tool",
    "is_error",
    "tag",
    "call_id",
    "line",
)


def slab_of(seq: str | Column = "seq", size: int | None = None) -> Column:
    """Number of the slab a record falls in."""
    size = size or SLAB
    col = F.col(seq) if isinstance(seq, str) else seq
    return F.call_function("div", col, F.lit(size))
