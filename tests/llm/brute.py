"""The agreed results by plain loops."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def contamination(docs, items, size=13):
    """(id, words, hit words, sorted item ids) of each document."""
    windows = defaultdict(set)
    for i, text in items:
        words = TERM.findall(lower(text))
        n = min(size, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[at : at + n])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        words, hit, found = TERM.findall(lower(text)), set(), set()
        for n in sizes:
            for at in range(len(words) - n + 1):
                if owners := windows.get(tuple(words[at : at + n])):
                    hit.update(range(at, at + n))
                    found |= owners
        out.append((i, len(words), len(hit), sorted(found)))
    return out


def repeats(docs, size=50):
    """(id, words, removed words, digest of the rest) of each document."""
    first = {}
    split = [(i, WORD.findall(text or "")) for i, text in docs]
    for i, words in split:
        for at in range(len(words) - size + 1):
            if i is not None:
                key = tuple(words[at : at + size])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, words in split:
        gone = set()
        for at in range(len(words) - size + 1):
            if i is not None and first[tuple(words[at : at + size])] < i:
                gone.update(range(at, at + size))
        rest = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(rest.encode()).hexdigest()))
    return out


def components(docs, percent, n=5):
    """(id, shingles, component, kept) of each document; ids are unique."""
    sets = {}
    for i, text in docs:
        words = WORD.findall(lower(text))
        sets[i] = set(zip(*(words[k:] for k in range(n)))) if len(words) >= n else {tuple(words)} if words else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return [(i, len(sets[i]), find(i), find(i) == i) for i in ids]
