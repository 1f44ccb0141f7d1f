"""Words of many texts at once, as numpy arrays: places, hashes and hashes of n words in a row.

Both alphabets of the operators separate words by ASCII characters only, so all is done on UTF-8 bytes.
Hashes find candidates or equal sequences within one text; operators that join texts by a hash say how they confirm it.
"""

import sys
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANK = 32
# Bytes of text that are handled at once; one text of more is handled alone.
GROUP_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1


def table(letters_and_digits: bool, lower: bool) -> np.ndarray:
    """What each byte becomes: a separator becomes a blank, and A-Z a-z if ``lower``.

    With ``letters_and_digits`` all ASCII but those separates words, else white space does.
    """
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    if letters_and_digits:
        for low, high in ((0, 48), (58, 65), (91, 97), (123, 128)):
            out[low:high] = BLANK
    else:
        out[9:14] = BLANK
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


class Words:
    """The words of some texts.

    ``norm``: all words, each followed by one blank; ``starts``, ``ends``: a word's bytes in it;
    ``first``: the number of words before each text, and of all words at last.
    """

    def __init__(self, texts: Sequence[bytes], letters: np.ndarray):
        raw = letters[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        inside = raw != BLANK
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        self.norm = raw[keep]
        self.ends = np.flatnonzero(self.norm == BLANK)
        self.starts = np.empty_like(self.ends)
        self.starts[1:] = self.ends[:-1] + 1
        self.starts[:1] = 0
        last = np.flatnonzero(inside[:-1] & ~inside[1:])
        self.first = np.searchsorted(last, np.cumsum([0, *(len(t) + 1 for t in texts)]))

    def __len__(self) -> int:
        return len(self.ends)

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        sizes = self.ends - self.starts
        at = np.arange(len(self.norm)) - np.repeat(self.starts, sizes + 1)
        terms = (self.norm.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, int(sizes.max()) + 1)[at]
        terms[self.ends] = 0
        return mix(np.add.reduceat(terms, self.starts) + sizes.astype(np.uint64) * np.uint64(_STEP))

    def valid(self, n: int) -> np.ndarray:
        """Is a word the first of ``n`` in a row within its text? For the places that ``runs`` gives."""
        left = np.repeat(self.first[1:], self.per_text)[: max(0, len(self) - n + 1)]
        return np.arange(len(left)) + n <= left

    def sequence(self, start: int, n: int) -> bytes:
        """The bytes of ``n`` words, joined by blanks."""
        return self.norm[self.starts[start] : self.ends[start + n - 1]].tobytes()


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` words in a row, by doubling; runs across texts are in it too."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out, done, part, size = None, 0, hashes, 1
    while True:
        if n & size:
            if out is None:
                out, done = part, size
            else:
                count = len(hashes) - done - size + 1
                out = out[:count] * np.uint64(pow(_STEP, size, 1 << 64)) + part[done : done + count]
                done += size
        if done == n:
            return mix(out[: len(hashes) - n + 1] + np.uint64(n))
        part = part[: len(part) - size] * np.uint64(pow(_STEP, size, 1 << 64)) + part[size:]
        size *= 2


def grouped(texts: Sequence[str | None], most: int = GROUP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes in groups of at most ``most`` bytes, each with the place of its first; null is empty."""
    group: list[bytes] = []
    start = size = 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if group and size + len(raw) > most:
            yield start, group
            group, start, size = [], i, 0
        group.append(raw)
        size += len(raw)
    if group:
        yield start, group
