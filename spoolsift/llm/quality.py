"""Quality rules on repetition: how much of a text stands in runs of words and in lines that it holds already."""

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolsift.llm import words
from spoolsift.llm.words import Words, grouped, runs, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(words)

# The published limits for the share of characters in the most frequent run of n words, in
# runs of n words that occurred before, and for lines that occurred before (share of lines, of characters).
TOP_RUNS = {2: 0.20, 3: 0.18, 4: 0.16}
REPEATED_RUNS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
REPEATED_LINES = 0.30
REPEATED_LINE_CHARS = 0.20
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words")
RUNS = (*(f"top_{n}_chars" for n in TOP_RUNS), *(f"dup_{n}_chars" for n in REPEATED_RUNS))
MEASURES = ", ".join(f"{name} long" for name in (*COUNTS, *RUNS))


def lines_again(text: str) -> tuple[int, int, int]:
    """Lines with a word, those of them equal to an earlier one, and the characters of the latter."""
    seen: set[str] = set()
    n = again = chars = 0
    for line in text.split("\n"):
        if line in seen:
            n, again, chars = n + 1, again + 1, chars + len(line)
        elif line.strip(BLANKS):
            n += 1
            seen.add(line)
    return n, again, chars


def measure(texts: Sequence[str | None], letters: np.ndarray) -> pd.DataFrame:
    """The measures of each text, from rolling hashes over all of them at once."""
    out = {name: np.zeros(len(texts), np.int64) for name in (*COUNTS, *RUNS)}
    for begin, group in grouped(texts):
        rows = slice(begin, begin + len(group))
        w = Words(group, letters)
        owner = np.repeat(np.arange(len(group), dtype=np.int64), w.per_text)
        # Code points: all bytes but those that continue one.
        points = np.concatenate([[0], np.cumsum((w.norm & 0xC0) != 0x80)])
        chars = points[w.ends] - points[w.starts]
        out["n_words"][rows] = w.per_text
        out["word_chars"][rows] = _per_text(chars, w)
        hashes = w.hashes()
        for n in sorted({3, *TOP_RUNS, *REPEATED_RUNS}):
            if n > len(w):
                continue
            places = np.flatnonzero(w.valid(n))
            # Equal runs of one text side by side, in their order; sorted by text first, so runs of others never meet.
            key, text = runs(hashes, n)[places], owner[places]
            order = np.lexsort((places, key, text))
            same = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
            later = np.zeros(len(places), bool)
            later[order[1:][same]] = True
            if n == 3:
                both = later.copy()
                both[order[:-1][same]] = True
                out["n_repeat_words"][rows] = _per_text(_covered(places[both], n, len(w)), w)
            if n in REPEATED_RUNS:
                out[f"dup_{n}_chars"][rows] = _per_text(np.where(_covered(places[later], n, len(w)), chars, 0), w)
            if n in TOP_RUNS:
                out[f"top_{n}_chars"][rows] = _top(order, same, places, text, chars, n, len(group))
    for i, text in enumerate(texts):
        if text:
            out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
            out["n_lines"][i], out["n_dup_lines"][i], out["dup_line_chars"][i] = lines_again(text)
    return pd.DataFrame(out)


def _per_text(values: np.ndarray, w: Words) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[w.first[1:]] - sums[w.first[:-1]]


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words stand in a run of ``n`` from one of the starts?"""
    change = np.zeros(size + 1, np.int64)
    change[starts] = 1
    change[:size] -= np.bincount(starts + n, minlength=size + 1)[:size]
    return np.cumsum(change[:size]) > 0


def _top(order, same, places, text, chars, n: int, size: int) -> np.ndarray:
    """Characters in all occurrences of each text's run that has most of them, if it occurs twice or more."""
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    counts = np.diff(np.concatenate([heads, [len(order)]]))
    first = order[heads]
    sums = np.concatenate([[0], np.cumsum(chars)])
    total = counts * (sums[places[first] + n] - sums[places[first]])
    out = np.zeros(size, np.int64)
    np.maximum.at(out, text[first][counts > 1], total[counts > 1])
    return out


def repetition(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, the struct ``repetition`` with what was measured, and ``kept``, the verdict.

    A text is dropped if the share of its word characters in its top run of 2 to 4 words, in runs of 5 to 10 words that
    occurred before, or the share of repeated lines or of their characters is above the published limit. The struct's
    n_repeat_words counts words in runs of three that occur twice or more, first ones included. A null or empty text
    has no words and breaks no rule here; columns of the two names are replaced; each row is judged by itself, so neither
    repeated rows nor an empty table are special. Hashes have 64 bits and are compared within one text only.
    """
    letters = table(letters_and_digits=False, lower=False)

    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield measure([t if isinstance(t, str) else None for t in batch], letters)

    judged = docs.withColumn("repetition", F.pandas_udf(measured, MEASURES)(F.col(text)))
    m = F.col("repetition")
    limits = {**{f"top_{n}_chars": s for n, s in TOP_RUNS.items()}, **{f"dup_{n}_chars": s for n, s in REPEATED_RUNS.items()}}
    bad = F.lit(False)
    for name, share in limits.items():
        bad = bad | (m[name] > share * m["word_chars"])
    bad = bad | (m["n_dup_lines"] > REPEATED_LINES * m["n_lines"])
    bad = bad | (m["dup_line_chars"] > REPEATED_LINE_CHARS * F.char_length(F.coalesce(F.col(text), F.lit(""))))
    return judged.withColumn("kept", ~bad)
