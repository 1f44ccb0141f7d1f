"""Token counts by a transducer compiled from a sentencepiece BPE vocabulary.

The last token of the encoding of a prefix follows from the last tokens of shorter prefixes: it is the one token
that ends there and may stand behind the last token before it. Two tokens may stand side by side if merging
their letters from scratch gives just these two. So a state need only hold, for every place from which
a longer token may still grow, the last token up to there; states and transitions are made when they
are first met, and each transition carries the number of tokens it adds (or takes back).

A blank after another letter always starts a token. From there on a state no longer depends on what
was before, so a text may be cut into chunks: the map of a chunk is the part before its first such place, to be
run from the state before it, and count and end state of the rest. Maps compose in any grouping.
"""

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

META = "▁"  # what sentencepiece writes for a blank
CHUNK = 1 << 15
STATES_KEPT = 200_000


class Transducer:
    """Counts the tokens of any text as the library would encode it; its tables are bounded by STATES_KEPT."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = (
            i
            for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        )
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in usable}
        # Beginnings of tokens that can still grow.
        self.beginnings = {piece[:n] for piece in self.scores for n in range(1, len(piece))}
        self.fits: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drop all states but the first: the one behind a blank that follows another letter, or at the start of a text."""
        self.states: dict[tuple, dict] = {}
        # (text since the place, last token before it, tokens up to it less those up to here), for each live place
        self.start = self.state(((META, "", -1),))

    def state(self, live: tuple) -> dict:
        """A state is the dictionary of its transitions, to (state, tokens added); None holds its description."""
        found = self.states.get(live)
        if found is None:
            found = self.states[live] = {None: live}
        return found

    def transition(self, state: dict, letter: str) -> tuple[dict, int]:
        live = state[None]
        if letter == META and live[0][0][-1] != META:
            state[letter] = self.start, 1
            return state[letter]
        grown = [(text + letter, before, count) for text, before, count in live]
        here = (letter, self.last_token(live), 0)
        grown.append(here)
        token, count = next((text, count) for text, before, count in grown if self.fit(before, text))
        # An unknown letter gives its bytes, a token each.
        added = count + (1 if token in self.scores else len(token.encode("utf-8", "surrogatepass")))
        places = [(text, before, n - added) for text, before, n in grown if text in self.beginnings]
        if token not in self.beginnings:
            # It only matters as the last token, so states that differ in how it came about are one.
            places.insert(0, (token, "", 0))
        state[letter] = self.state(tuple(places)), added
        return state[letter]

    def last_token(self, live: tuple) -> str:
        """The token that ends here: the first live place whose text is a token that fits."""
        return next(text for text, before, _ in live if self.fit(before, text))

    def fit(self, before: str, token: str) -> bool:
        """Do both stand side by side in an encoding? An unknown single letter is a token of its own."""
        if token not in self.scores and len(token) > 1:
            return False
        found = self.fits.get((before, token))
        if found is None:
            if len(self.fits) >= 2 * STATES_KEPT:
                self.fits.clear()
            found = self.merged(before + token) == ([before, token] if before else [token])
            self.fits[before, token] = found
        return found

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text: again and again the adjacent pair of the highest score is joined."""
        parts = list(text)
        while True:
            pairs = [(self.scores.get(a + b), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best = max((p for p in pairs if p[0] is not None), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def run(self, state: dict, text: str) -> tuple[dict, int]:
        total = 0
        for letter in text:
            try:
                state, added = state[letter]
            except KeyError:
                state, added = self.transition(state, letter)
            total += added
        return state, total

    def chunk_map(self, chunk: str) -> tuple[str, int | None, dict | None]:
        """(text before the first fresh start, tokens from there on, end state); without such a place all is text."""
        at = fresh_start(chunk)
        if at < 0:
            return chunk, None, None
        end, count = self.run(self.start, chunk[at + 1 :])
        return chunk[:at], count + 1, end

    def compose(self, one: tuple, two: tuple) -> tuple:
        """The map of a chunk and the next one."""
        if one[1] is None:
            # The cut may hide a fresh start between the two.
            if two[0][:1] == META and one[0] and one[0][-1] != META:
                end, count = self.run(self.start, two[0][1:])
                rest = (count + 1, end) if two[1] is None else (count + 1 + two[1], two[2])
                return one[0], *rest
            return one[0] + two[0], two[1], two[2]
        end, count = self.run(one[2], two[0])
        return (one[0], one[1] + count, end) if two[1] is None else (one[0], one[1] + count + two[1], two[2])

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = META + text.replace(" ", META)
        if len(self.states) > STATES_KEPT:
            self.forget()
        maps = [self.chunk_map(text[at : at + CHUNK]) for at in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            pairs = zip(maps[::2], [*maps[1::2], None] if len(maps) % 2 else maps[1::2])
            maps = [one if two is None else self.compose(one, two) for one, two in pairs]
        head, count, _ = maps[0]
        return 1 + self.run(self.start, head[1:])[1] + (count or 0)


def fresh_start(text: str) -> int:
    """The first blank after another letter, or -1."""
    at = len(text) - len(text.lstrip(META))
    return text.find(META, at) if at else text.find(META, 1)


def transducer(path: str) -> Transducer:
    """The transducer of this worker process; its tables outlive a task."""
    known = sys.__dict__.setdefault("_spoolsift_transducers", {})
    if path not in known:
        known[path] = Transducer(path)
    return known[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    Columns of these names are replaced. A null text counts as empty: no bytes, no tokens. Texts of any length
    are counted whole, chunk by chunk; repeated rows give repeated rows; an empty table gives an empty one.
    ``vocabulary`` is a sentencepiece BPE model without normalisation, readable on every executor.
    """

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(vocabulary)
        for batch in batches:
            yield pd.Series([machine.count(t or "") for t in batch], dtype="int64")

    counted = docs.withColumn("n_tokens", F.pandas_udf(count, "long")(F.col(text)))
    return counted.withColumns(
        {"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "over_limit": F.col("n_tokens") > limit}
    )
