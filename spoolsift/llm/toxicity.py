"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, letters that look alike and digits that stand for letters become one letter, invisible
characters go. The lexicon is learnt from labelled texts: beginnings of words and whole words with the log of the odds they
speak for. Aho-Corasick automata find its entries in the folded text; those inside an exception phrase (a pair of
words whose labelled texts are clean far more often than those of its entry, or given ones) do not count. A logistic curve over the sum of weights,
by itself and for the length of the text, gives the score.
"""

import math
import pickle
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolsift.llm.tables import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What is read as another letter, and what is not seen at all.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
INVISIBLE = "­​‌‍⁠﻿"
FULL_WIDTH = {chr(0xFF21 + i): chr(ord("a") + i) for i in range(26)} | {chr(0xFF41 + i): chr(ord("a") + i) for i in range(26)}

# Limits of what is learnt: beginnings of words, kinds of text an entry must be in, its
# least weight, and the least log of the odds against chance.
PREFIXES = range(4, 9)
LEAST_KINDS = 4
LEAST_WEIGHT = 2.0
LEAST_EVIDENCE = 1.0
# Kinds of clean text that a phrase must be in to be an exception, and labelled rows that the curve is fitted on at most.
EXCEPTION_KINDS = 3
FIT_ROWS = 20_000
# Entries and exceptions in one automaton, some 60 bytes of memory a letter; of more, each batch of texts is read once for each part.
ENTRIES_A_PASS = 100_000


@dataclass(frozen=True)
class Model:
    """Entries with weights (a blank before: beginning of a word; behind as well: whole word), exceptions, curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = ()


def folded(text: Column) -> Column:
    """Folded words of a text, a blank before and behind each.

    A digit or sign stands for a letter only right before or behind one.
    """
    seen = F.translate(F.lower(F.coalesce(text, F.lit(""))), "".join([*LOOKALIKES, *FULL_WIDTH, *INVISIBLE]), "".join([*LOOKALIKES.values(), *FULL_WIDTH.values()]))
    spelled = "[" + "".join("\\" + c if not c.isalnum() else c for c in DIGITS) + "]"
    inside = F.regexp_replace(seen, rf"(?<![\p{{L}}0-9@$|])[!|]+|[!]+(?![\p{{L}}])", " ")
    letters = F.translate(inside, "".join(DIGITS), "".join(DIGITS.values()))
    # Without a digit or sign next to a letter there is nothing to spell out.
    plain = F.when(seen.rlike(rf"\p{{L}}{spelled}|{spelled}\p{{L}}"), letters).otherwise(seen)
    return F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), r"[^\p{L}\p{M}]+", " ")


def training_rows(doc_id: Column) -> Column:
    """Rows that labels may be learnt from: one in four is held out, by its id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def _parts(model: Model) -> list[bytes]:
    """Entries (text, 0, weight) and exceptions (text, 1, 0) in parts of one automaton each, packed small."""
    every = [(entry, 0, weight) for entry, weight in model.weights.items()]
    every += [(f" {phrase} ", 1, 0.0) for phrase in model.exceptions]
    return [pickle.dumps(every[i : i + ENTRIES_A_PASS]) for i in range(0, len(every), ENTRIES_A_PASS)]


class Matcher:
    """The automata over folded texts, given a model or the parts of one. Only one automaton is in memory at a time."""

    def __init__(self, model: Model | list[bytes]):
        self.parts = _parts(model) if isinstance(model, Model) else model
        self.only = self._machine(self.parts[0]) if len(self.parts) == 1 else None

    def _machine(self, part: bytes):
        import ahocorasick

        # An exception may be an entry as well, so both kinds of a text are kept together.
        kinds: dict[str, list] = {}
        for entry, kind, weight in pickle.loads(part):
            kinds.setdefault(entry, []).append((kind, len(entry), weight))
        machine = ahocorasick.Automaton()
        for entry, values in kinds.items():
            machine.add_word(entry, values)
        machine.make_automaton()
        return machine

    def matches(self, text: str) -> list[tuple[int, float]]:
        return self.matches_of([text])[0]

    def matches_of(self, texts: Sequence[str]) -> list[list[tuple[int, float]]]:
        """(place of the word, weight) of every word with an entry and outside of exceptions; of several the heaviest."""
        best: list[dict[int, float]] = [{} for _ in texts]
        excepted: list[list[tuple[int, int]]] = [[] for _ in texts]
        for part in self.parts:
            machine = self.only or self._machine(part)
            for text, mine, spans in zip(texts, best, excepted):
                for end, values in machine.iter(text):
                    for kind, size, weight in values:
                        start = end - size + 1
                        if kind:
                            spans.append((start, end))
                        elif weight > mine.get(start, 0.0):
                            mine[start] = weight
            del machine
        for mine, spans in zip(best, excepted):
            for start, end in spans:
                for place in [p for p in mine if start <= p < end]:
                    del mine[place]
        return [sorted(mine.items()) for mine in best]

    def features_of(self, texts: Sequence[str]) -> list[tuple[float, float, float]]:
        """Of each folded text: is there any, sum of weights, sum for the length."""
        rows = []
        for text, found in zip(texts, self.matches_of(texts)):
            total = sum(weight for _, weight in found)
            rows.append((float(bool(found)), float(np.log1p(total)), float(np.log1p(1000 * total / (text.count(" ") + 20)))))
        return rows


def score_of(features: Sequence[float], curve: Sequence[float]) -> float:
    if not curve:
        return 0.0
    z = curve[0] + sum(c * x for c, x in zip(curve[1:], features))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.1) -> tuple[float, ...]:
    """Logistic regression with a small penalty, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        curvature = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(curvature, gradient)
    return tuple(w.tolist())


def learn(docs: DataFrame, labels: DataFrame, exceptions: Sequence[str] = ()) -> Model:
    """A model from the labelled rows (doc_id, toxic) that are not held out.

    Words are counted over all of them. Labels that are null are not used; an id with several is toxic if one of them says so.
    Without labels of both kinds the model is empty and gives 0.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where(F.col("toxic").isNotNull() & training_rows(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.where(training_rows(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Labels grow with the documents, so both are shuffled at any size.
    train = texts.join(known.hint("merge"), "doc_id").select("doc_id", "toxic", folded(F.col("text")).alias("text"))
    words = F.split(F.trim("text"), " ")
    # The words are not named inside the function, where they would be cut anew for each of them.
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))
    # Copies of a text with changes mostly share their least pair of words, so it names the kind of a text.
    kind = F.coalesce(F.array_min(pairs), F.xxhash64("text"))
    train = scratch.keep(train.withColumn("kind", kind), "train")
    sizes = train.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    toxic, clean = sizes["toxic"], sizes["n"] - sizes["toxic"]
    if not toxic or not clean:
        return Model()

    each = F.array_distinct(F.split(F.trim("text"), " "))
    words = train.select("toxic", "kind", F.explode(each).alias("word")).where("word != ''")
    counts = words.groupBy("word").agg(F.sum("toxic").alias("t"), (F.count("*") - F.sum("toxic")).alias("c"))
    counts = scratch.keep(counts, "words")
    # A beginning is in at most as many texts as all words that begin with it.
    parts = [F.concat(F.lit(" "), F.col("word"), F.lit(" "))]
    parts += [F.when(F.length("word") >= n, F.concat(F.lit(" "), F.substring("word", 1, n))) for n in PREFIXES]
    parts = counts.select("word", "t", "c", F.explode(F.array(*parts)).alias("entry")).where(F.col("entry").isNotNull())
    entries = parts.groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    often = scratch.keep(entries.where(F.col("t") >= LEAST_KINDS).withColumn("weight", weight), "often")

    # Kinds are told apart only for entries of enough weight, which few clean texts hold.
    heavy = often.where(F.col("weight") >= LEAST_WEIGHT)
    held = parts.join(heavy, "entry", "left_semi").groupBy("word").agg(F.collect_list("entry").alias("entries"))
    kinds = _kinds(words.join(held, "word").select("toxic", "kind", F.explode("entries").alias("entry")), "entry")
    base = train.select("toxic", "kind").distinct().groupBy().pivot("toxic", [0, 1]).count().first()
    rate = base["1"] / (base["0"] + base["1"])
    best = heavy.join(kinds.where(F.col("toxic_kinds") >= LEAST_KINDS), "entry")
    share = F.col("toxic_kinds") / (F.col("toxic_kinds") + F.col("clean_kinds"))
    best = best.where((share > rate) & (_evidence(share, F.lit(rate)) >= math.log(max(1, often.count())) + LEAST_EVIDENCE))
    best = scratch.keep(best.select("entry", "t", "weight"), "best")
    weights = {r["entry"]: r["weight"] for r in _chosen(best).orderBy(F.desc("t"), F.desc("weight"), "entry").collect()}

    phrases = _exceptions(train, Model(weights), rate, scratch) if weights else []
    model = Model(weights, (*exceptions, *phrases))
    sample = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    fit = _features(sample, model, "toxic").toPandas()
    scratch.drop("train", "words", "often", "best", "phrases")
    curve = fitted(fit[["any", "total", "density"]].to_numpy(float), fit["toxic"].to_numpy(float))
    return Model(weights, model.exceptions, curve)


def _kinds(rows: DataFrame, name: str) -> DataFrame:
    """Different kinds of toxic and of clean texts for each value of a column, however many: toxic_kinds, clean_kinds."""
    each = rows.select(name, "kind", "toxic").distinct()
    return each.groupBy(name).agg(F.sum("toxic").alias("toxic_kinds"), F.sum(1 - F.col("toxic")).alias("clean_kinds"))


def _evidence(share: Column, expected: Column) -> Column:
    """The log of the odds against such a share of toxic kinds by chance, where another is expected."""
    toxic = F.when(share > 0, share * F.log(share / expected)).otherwise(0.0)
    clean = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - expected))).otherwise(0.0)
    return (F.col("toxic_kinds") + F.col("clean_kinds")) * (toxic + clean)


def _chosen(found: DataFrame) -> DataFrame:
    """Of entries that begin alike, the ones to keep: a longer one if it says more about nearly all texts, else the shorter."""
    lengths = F.sequence(F.lit(PREFIXES.start + 1), F.least(F.lit(PREFIXES.stop), F.length("entry") - 1))
    begins = F.when(F.length("entry") > PREFIXES.start + 1, F.transform(lengths, lambda n: F.substring(F.col("entry"), F.lit(1), n)))
    longer = found.select(F.col("entry").alias("longer"), F.col("t").alias("lt"), F.col("weight").alias("lw"), F.explode(begins).alias("entry"))
    pairs = longer.join(found, "entry")
    less = pairs.where((F.col("lt") >= 0.7 * F.col("t")) & (F.col("lw") > F.col("weight") + 0.3)).select("entry")
    covered = pairs.where(F.col("weight") >= F.col("lw") - 0.5).join(less, "entry", "left_anti").select(F.col("longer").alias("entry"))
    return found.join(less, "entry", "left_anti").join(covered, "entry", "left_anti")


def _shared(df: DataFrame, model: Model):
    """The model on all executors, its entries in packed parts."""
    return df.sparkSession.sparkContext.broadcast((_parts(model), model.curve))


def _exceptions(train: DataFrame, model: Model, rate: float, scratch: Scratch) -> list[str]:
    """Pairs of words with an entry that speak for clean texts, though the entry by itself speaks for toxic ones.

    Toxic kinds are no more frequent among the phrase's kinds than among all, and the evidence that they are rarer than the weight
    of its lightest entry lets expect is held to the limit for entries.
    """
    shared = _shared(train, model)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shared.value[0])
        for batch in batches:
            rows: dict[tuple, float] = {}
            for text, toxic, kind, found in zip(batch["text"], batch["toxic"], batch["kind"], matcher.matches_of(batch["text"])):
                for place, weight in found:
                    end = text.index(" ", place + 1)
                    before = text.rfind(" ", 0, place)
                    behind = text.find(" ", end + 1)
                    phrases = [text[before + 1 : end]] if before >= 0 and place > before + 1 else []
                    phrases += [text[place + 1 : behind]] if behind > end + 1 else []
                    for phrase in phrases:
                        row = phrase, int(toxic), kind
                        rows[row] = min(weight, rows.get(row, weight))
            yield pd.DataFrame([(*row, w) for row, w in rows.items()], columns=["phrase", "toxic", "kind", "weight"])

    found = train.select("text", "toxic", "kind").mapInPandas(pairs, "phrase string, toxic int, kind long, weight double")
    found = scratch.keep(found.groupBy("phrase", "toxic", "kind").agg(F.min("weight").alias("weight")), "phrases")
    tried = found.groupBy("phrase").agg(
        F.sum("toxic").alias("toxic_kinds"), F.sum(1 - F.col("toxic")).alias("clean_kinds"), F.min("weight").alias("weight")
    )
    tried = tried.where(F.col("clean_kinds") >= EXCEPTION_KINDS)
    share = F.col("toxic_kinds") / (F.col("toxic_kinds") + F.col("clean_kinds"))
    # Less than 1, so that one clean text is never out of the question.
    expected = F.least(1 / (1 + F.exp(-F.col("weight") - math.log(rate / (1 - rate)))), F.lit(1 - 1e-9))
    clean = tried.where((share <= rate) & (_evidence(share, expected) >= math.log(max(1, tried.count())) + LEAST_EVIDENCE))
    return [r["phrase"] for r in clean.orderBy(F.desc("clean_kinds"), "phrase").collect()]


def _features(rows: DataFrame, model: Model, *columns: str) -> DataFrame:
    shared = _shared(rows, model)

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shared.value[0])
        for batch in batches:
            yield pd.DataFrame(matcher.features_of(batch), columns=["any", "total", "density"])

    made = F.pandas_udf(work, "any double, total double, density double")(F.col("text"))
    return rows.select(*columns, made.alias("f")).select(*columns, "f.*")


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``toxicity``, from 0 to 1; a column of that name is replaced.

    Only the text is looked at. A null or empty text, or one without any entry, has the score of none found; each row is scored by
    itself, so repeated rows get equal scores; an empty table gives an empty one. Texts are read whole.
    """
    shared = _shared(docs, model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value[0])
        for batch in batches:
            yield pd.Series([score_of(f, shared.value[1]) for f in matcher.features_of(batch)], dtype=float)

    return docs.withColumn("toxicity", F.pandas_udf(score, "double")(folded(F.col(text))))
