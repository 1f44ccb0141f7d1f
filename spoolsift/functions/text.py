"""Previews and labels of result rows."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The display sizes the result rows use.
LINE_CHARS = 200
MIDDLE_HEAD = 200
MIDDLE_TAIL = 120
SCAN_BUDGET = 40_000
SEARCH_TITLE = 50
LIST_TITLE = 80

# Unicode white space plus the four separator controls that Python also splits on.
_BLANKS = r"(?U)[\s\x1c-\x1f]+"


def flat(text: Column) -> Column:
    """Text on one line: every run of white space becomes one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def preview(text: Column, limit: int = LINE_CHARS) -> Column:
    """One-line text cut at ``limit`` characters, saying how many are missing."""
    line = flat(text)
    if limit <= 0:
        return line
    extra = F.length(line) - F.lit(limit)
    cut = F.concat(F.left(line, F.lit(limit)), F.lit("... [+"), extra.cast("string"), F.lit(" chars]"))
    return F.when(extra > 0, cut).otherwise(line)


def middle_cut(text: Column, head: int = MIDDLE_HEAD, tail: int = MIDDLE_TAIL) -> Column:
    """Long text without its middle, since errors sit at the end."""
    extra = F.length(text) - F.lit(head + tail)
    cut = F.concat(
        F.left(text, F.lit(head)),
        F.lit(" ...[+"),
        extra.cast("string"),
        F.lit(" chars, middle]... "),
        F.right(text, F.lit(tail)),
    )
    return F.when(extra > 0, cut).otherwise(text)


def short_id(provider: Column, session_id: Column) -> Column:
    """Display prefix of a session id: 13 characters for time-ordered ids, else 8."""
    return F.when(provider == "codex", F.left(session_id, F.lit(13))).otherwise(F.left(session_id, F.lit(8)))


def label(name: Column, title: Column) -> Column:
    """The name a person gave the session, else its title."""
    return F.coalesce(F.nullif(name, F.lit("")), title, F.lit(""))


def title_cell(name: Column, title: Column, width: int = SEARCH_TITLE) -> Column:
    """Label on one line, cut to a table cell."""
    return F.left(flat(label(name, title)), F.lit(width))


def event_number(seq: Column) -> Column:
    """``#`` and the record number with at least four digits."""
    return F.concat(F.lit("#"), F.format_string("%04d", seq))


def event_line(cap: int = LINE_CHARS) -> Column:
    """One trimmed line for an event: what was said, or the tool with its call and state."""
    text, tool, tag = F.col("text"), F.col("tool"), F.col("tag")
    quoted = F.concat(F.lit('"'), preview(text, cap), F.lit('"'))
    call = F.concat(tool, F.lit(" "), quoted, F.when(tag != "", F.concat(F.lit(" -> "), tag)).otherwise(""))
    head = F.concat(F.lit("("), tool, F.when(F.col("is_error"), ", is_error)").otherwise(")"))
    result = F.concat(head, F.lit(' "'), middle_cut(flat(text)), F.lit('"'))
    talk = F.concat(F.when(tag != "", F.concat(F.lit("("), tag, F.lit(") "))).otherwise(""), quoted)
    kind = F.col("kind")
    return (
        F.when(kind == "tool", call)
        .when(kind == "result", result)
        .when(kind.isin("text", "thinking"), talk)
        .otherwise(preview(text, cap))
    )
