"""Smart-case patterns: checked on the driver, run by Spark's own regex engine.

Patterns are written the way Python's ``re`` reads them. The few spellings the
JVM reads differently are rewritten. ASCII letters, sets and ranges of them match the same
characters in both, in any case too, so a plain pattern never leaves the JVM. Python itself
searches, in Arrow batches, where the JVM would not do the same: patterns that cannot be
rewritten, those that repeat groups so often that the JVM, which descends once per repetition, might
run out of stack, and, for patterns with classes that differ beyond ASCII, the texts with such characters.
"""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ignores_case(pattern: str, ignore_case: bool = False) -> bool:
    """A pattern without capitals matches any case."""
    return ignore_case or pattern == pattern.lower()


def check(pattern: str, fixed: bool = False) -> None:
    """Raise ``ValueError`` for a pattern that is not a regex."""
    if fixed:
        return
    try:
        re.compile(pattern)
    except (re.error, RecursionError, OverflowError) as exc:
        raise ValueError(f"bad regex {pattern!r}: {exc}; quote metacharacters or match it as fixed text") from exc


# Spellings both engines know but name differently.
_GROUP_OPENERS = {"(?P<": "(?<", "(?P=": "\\k<"}


def to_jvm(pattern: str) -> str | None:
    """The same pattern in the JVM's spelling, or None where there is none."""
    if re.search(r"\(\?\(|\\[0N]|\(\?[aiLmsux-]+[:)]", pattern):
        return None  # conditionals, octal and named characters and flag groups are spelt differently
    names = {n: f"g{i}x" for i, n in enumerate(re.compile(pattern).groupindex)}
    out, i, in_class, class_start = [], 0, False, 0
    while i < len(pattern):
        two, char = pattern[i : i + 2], pattern[i]
        if char == "\\":
            out.append({"\\Z": "\\z", "\\v": "\\x0B"}.get(two, two))
            i += 2
            continue
        if in_class:
            if char == "]" and i > class_start:
                in_class = False
                out.append(char)
            else:
                out.append("\\" + char if char in "[]&~" else char)
        elif char == "[":
            in_class = True
            negated = pattern[i + 1 : i + 2] == "^"
            out.append("[^" if negated else "[")
            i += 1 if negated else 0
            class_start = i + 1
        elif pattern[i : i + 4] in _GROUP_OPENERS:
            back = pattern[i + 3] == "="
            end = pattern.index(")" if back else ">", i)
            out.append(_GROUP_OPENERS[pattern[i : i + 4]] + names[pattern[i + 4 : end]] + ">")
            i = end
        elif char == "{":
            times = re.match(r"\{(\d*)(,?)(\d*)\}", pattern[i:])
            if times and (times[1] or times[3]):
                out.append(f"{{{times[1] or '0'}{times[2]}{times[3]}}}")
                i += times.end() - 1
            else:
                out.append("\\{")
        elif char == "}":
            out.append("\\}")
        else:
            out.append(char)
        i += 1
    return "".join(out)


# Escapes and classes stand for one character each.
_SINGLE = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", re.S)
_PARENTHESIS = re.compile(r"\(|\)(?:(?P<endless>[*+])|\{(?P<least>\d*)(?P<range>,?)(?P<most>\d*)\})?")
# Repetitions of groups, and groups in each other, that the JVM's stack is trusted with.
MOST_DESCENTS = 50


def descents(pattern: str) -> float:
    """How often groups repeat at most, one inside another, and how deep they lie: the JVM's stack grows with both."""
    inner: list[float] = [1]
    deepest = 1
    for part in _PARENTHESIS.finditer(_SINGLE.sub("x", pattern)):
        if part[0] == "(":
            inner.append(1)
            deepest = max(deepest, len(inner))
            continue
        times = 1.0
        if part["endless"] or (part["range"] and not part["most"]):
            times = float("inf")
        elif part["most"] or part["least"]:
            times = int(part["most"] or part["least"])
        times *= inner.pop() if len(inner) > 1 else 1
        inner[-1] = max(inner[-1], times)
    return max(inner[0], deepest)


def differs(pattern: str) -> bool:
    """Has it classes, letters beyond ASCII (spelt or escaped) or repeated finds, which both engines read alike for ASCII texts only?"""
    return bool(re.search(r"\\[wWsSbBdDxuU1-9]", pattern)) or not pattern.isascii() or "(?" in pattern


def matches(text: Column, pattern: str, fixed: bool = False, ignore_case: bool = False) -> Column:
    """Does the text hold the pattern? Case is ignored unless the pattern has capitals."""
    check(pattern, fixed)
    loose = ignores_case(pattern, ignore_case)
    if fixed:
        return F.contains(F.lower(text), F.lit(pattern.lower())) if loose else F.contains(text, F.lit(pattern))
    jvm = None if descents(pattern) >= MOST_DESCENTS else to_jvm(pattern)
    if jvm is None:
        return _python_search(pattern, loose)(text)
    # U: Unicode classes and case, d: only \n ends a line, both as in Python.
    plain = F.rlike(text, F.lit(("(?idU)" if loose else "(?dU)") + jvm))
    if not differs(pattern):
        return plain
    # Python takes the separators from 1C to 1F for white space too.
    other = F.rlike(text, F.lit(r"[^\x00-\x1B\x20-\x7F]"))
    return F.when(other, _python_search(pattern, loose)(F.when(other, text))).otherwise(plain)


def _python_search(pattern: str, loose: bool):
    @F.pandas_udf("boolean")
    def search(texts: pd.Series) -> pd.Series:
        needle = re.compile(pattern, re.IGNORECASE if loose else 0)
        return texts.map(lambda t: needle.search(t) is not None, na_action="ignore")

    return search
