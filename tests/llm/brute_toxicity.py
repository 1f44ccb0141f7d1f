"""Toxicity by plain loops: folding, what is learnt from labelled rows, and scores."""

import math
import zlib
from collections import defaultdict

import numpy as np
import regex
import xxhash
from spoolsift.llm import toxicity as fixed


def folded(text):
    """The words of a folded text."""
    looks = {ord(c): to for c, to in {**fixed.LOOKALIKES, **fixed.FULL_WIDTH}.items()}
    text = (text or "").lower().translate({**looks, **{ord(c): None for c in fixed.INVISIBLE}})
    spelled = "[" + regex.escape("".join(fixed.DIGITS)) + "]"
    if regex.search(rf"\p{{L}}{spelled}|{spelled}\p{{L}}", text):
        text = regex.sub(r"(?<![\p{L}0-9@$|])[!|]+|!+(?!\p{L})", " ", text)
        text = text.translate({ord(c): to for c, to in fixed.DIGITS.items()})
    return regex.findall(r"[\p{L}\p{M}]+", text)


def signed_hash(*words):
    seed = 42
    for word in words:
        seed = xxhash.xxh64_intdigest(word.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def kind(words):
    if not words:
        return signed_hash("")
    return min(signed_hash(*words[i : i + 2]) for i in range(len(words)))


def entries_of(word):
    return [f" {word} ", *(f" {word[:n]}" for n in range(4, 9) if len(word) >= n)]


def evidence(toxic, clean, expected):
    share = toxic / (toxic + clean)
    out = share * math.log(share / expected) if share > 0 else 0
    out += (1 - share) * math.log((1 - share) / (1 - expected)) if share < 1 else 0
    return (toxic + clean) * out


def heaviest(word, weights):
    return max((weights[e] for e in entries_of(word) if e in weights), default=0)


def chosen(found):
    """Of {entry: (texts, weight)} those to keep."""
    begins = lambda e: [e[:n] for n in range(2, len(e)) if e[:n] in found]
    less = {s for e, (t, w) in found.items() for s in begins(e) if t >= 0.7 * found[s][0] and w > found[s][1] + 0.3}
    covered = {e for e, (t, w) in found.items() for s in begins(e) if s not in less and found[s][1] >= w - 0.5}
    return {e: w for e, (t, w) in found.items() if e not in less | covered}


def learn(docs, labels):
    """(weights, exceptions, training rows as words and label) of documents (id, text) and labels (id, toxic)."""
    known = {}
    for i, toxic in labels:
        if toxic is not None:
            known[i] = max(int(toxic), known.get(i, 0))
    rows = [(folded(text), known[i]) for i, text in docs if i in known and zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(words, kind(words), toxic) for words, toxic in rows]
    toxic = sum(t for _, _, t in rows)
    clean = len(rows) - toxic
    texts, kinds = defaultdict(lambda: [0, 0]), defaultdict(set)
    for words, k, t in rows:
        for word in set(words):
            for entry in entries_of(word):
                texts[entry][t] += 1
                kinds[entry].add((k, t))
    base = {(k, t) for _, k, t in rows}
    rate = sum(t for _, t in base) / len(base)
    tried = [e for e, (_, t) in texts.items() if t >= fixed.LEAST_KINDS]
    found = {}
    for entry in tried:
        c, t = texts[entry]
        weight = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        bad = sum(x for _, x in kinds[entry])
        good = len(kinds[entry]) - bad
        if weight >= fixed.LEAST_WEIGHT and bad >= fixed.LEAST_KINDS and bad / (bad + good) > rate:
            if evidence(bad, good, rate) >= math.log(len(tried)) + fixed.LEAST_EVIDENCE:
                found[entry] = t, weight
    weights = chosen(found)

    phrases = defaultdict(dict)
    for words, k, t in rows:
        for i, word in enumerate(words):
            if weight := heaviest(word, weights):
                for pair in (words[i - 1 : i + 1], words[i : i + 2]):
                    if len(pair) == 2:
                        held = phrases[" ".join(pair)]
                        held[k, t] = min(weight, held.get((k, t), weight))
    tried = []
    for phrase, held in phrases.items():
        bad = sum(t for _, t in held)
        if len(held) - bad >= fixed.EXCEPTION_KINDS:
            tried.append((phrase, bad, len(held) - bad, min(held.values())))
    exceptions = set()
    for phrase, bad, good, weight in tried:
        expected = min(1 / (1 + math.exp(-weight) * (1 - rate) / rate), 1 - 1e-9)
        if bad / (bad + good) <= rate and evidence(bad, good, expected) >= math.log(len(tried)) + fixed.LEAST_EVIDENCE:
            exceptions.add(phrase)
    return weights, exceptions, [(words, t) for words, _, t in rows]


def features(words, weights, exceptions):
    found = [heaviest(word, weights) for word in words]
    for i in range(len(words) - 1):
        if " ".join(words[i : i + 2]) in exceptions:
            found[i] = found[i + 1] = 0
    total = sum(found)
    return float(total > 0), math.log1p(total), math.log1p(1000 * total / (len(words) + 1 + 20))


def curve(rows, weights, exceptions, ridge=0.1):
    """The least penalised loss of the logistic curve, by steps that halve until the loss falls."""
    x = np.array([(1.0, *features(words, weights, exceptions)) for words, _ in rows])
    y = np.array([t for _, t in rows])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + ridge / 2 * w @ w
    w = np.zeros(4)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (p - y) + ridge * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(4), slope)
        size = 1.0
        while size > 1e-9 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return w


def scores(docs, labels):
    """(weights, exceptions, {id: score})."""
    weights, exceptions, rows = learn(docs, labels)
    w = curve(rows, weights, exceptions)
    out = {i: 1 / (1 + math.exp(-(w[0] + w[1:] @ features(folded(text), weights, exceptions)))) for i, text in docs}
    return weights, exceptions, out
