"""Token ids of whole texts, by the tokenizers library, with a memory of the words already encoded.

A text is cut where the library's own pre-tokenizers always cut, so that the ids of the pieces, one after
the other, are the ids of the text. Pieces seen before are looked up; only new ones go to the library: those of
plain letters straight to its model (neither a pre-tokenizer nor a special token can cut them), others whole.
Columns of texts are cut in numpy and their pieces told apart by Arrow, so that each is looked up once a stretch.
"""

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Unicode white space, letters that every regex library knows as such, and punctuation.
WHITE_SPACE = " \t\n\r\x0b\x0c\x85\xa0  -     　"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PUNCTUATION = ".,!?;:"

# A line feed alone before a letter; letters up to white space, punctuation or the end; punctuation up to white space; anything
# up to white space.
PIECES = re.compile(
    f"\n(?=[{LETTERS}])|[{WHITE_SPACE}]*[{LETTERS}]+(?=[{WHITE_SPACE}{PUNCTUATION}]|$)|[{PUNCTUATION}]+(?=[{WHITE_SPACE}]|$)"
    f"|[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+"
)
_PLAIN = re.compile(f" ?[{LETTERS}]+")

# Entries of each of a worker's two generations of remembered pieces, and the longest piece worth remembering.
KEPT = 300_000
LONGEST = 64

# Bytes of a column that are cut at a time; a longer text is a stretch of its own.
STRETCH = 4 << 20

# What a byte of UTF-8 says: a letter, punctuation, no white space, white space before which a text may be cut.
LETTER, POINT, SOLID, BLANK = 1, 2, 4, 8
_KINDS = np.zeros(256, np.uint8)
_KINDS[0x21:0x7F] = SOLID
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] |= LETTER
_KINDS[[*PUNCTUATION.encode()]] |= POINT
_KINDS[[*b" \t\n\r"]] = BLANK

# Steps before the model that cut wherever PIECES does and leave letters as letters. How two public files state them.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LOWER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}
KNOWN_STEPS = [
    (None, _BYTE_LEVEL | {"use_regex": True}),
    (
        {"type": "Sequence", "normalizers": _LOWER},
        {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTE_LEVEL | {"use_regex": False}]},
    ),
]


class Memory(dict):
    """Works out what it lacks. Of two generations the older one is dropped when the newer is full; what is met again moves up."""

    def __init__(self, work):
        super().__init__()
        self.work = work
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.work(key)
        if len(key) <= LONGEST:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Ids as bytes of little-endian unsigned 32-bit integers; the memory is bounded by twice KEPT entries.

    Texts are cut only for vocabularies whose steps before the model are known to cut there too; with any other file the
    library encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        steps = json.loads(self.library.to_str())
        self.cuts = _cuts_are_safe(steps)
        # Does the normalizer drop blanks and lower letters? Letters by themselves are as any of them leaves them.
        self.lowers = steps["normalizer"] is not None
        self.alphabet = _byte_alphabet()
        self.pieces = Memory(self._encode)

    def encode(self, text: str) -> bytes:
        if not self.cuts:
            return self._whole(text)
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text)))

    def encode_column(self, texts) -> Iterator[bytes]:
        """What ``encode`` gives for each text of an Arrow column, null as empty."""
        import pyarrow as pa

        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.cuts or not len(texts):
            yield from (self._whole(text.as_py()) for text in texts)
            return
        places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        letters = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            until = max(at + 1, int(np.searchsorted(places, places[at] + STRETCH, "right")) - 1)
            yield from self._stretch(letters[places[at] : places[until]], places[at : until + 1] - places[at])
            at = until

    def _stretch(self, letters: np.ndarray, places: np.ndarray) -> Iterator[bytes]:
        """Ids of texts that follow each other in ``letters``, from each of ``places`` to the next."""
        import pyarrow as pa

        starts = _piece_starts(letters, places)
        bounds = pa.py_buffer(np.append(starts, len(letters)))
        cut = pa.LargeStringArray.from_buffers(len(starts), bounds, pa.py_buffer(letters)).dictionary_encode()
        found = [self.pieces[piece] for piece in cut.dictionary.to_numpy(zero_copy_only=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, which = np.frombuffer(b"".join(found), "<u4"), cut.indices.to_numpy()
        counts = sizes[which]
        before = np.append(0, np.cumsum(counts))
        shifts = (np.cumsum(sizes) - sizes)[which] - before[:-1]
        ids = ids[np.repeat(shifts, counts) + np.arange(before[-1])]
        ends = before[np.searchsorted(starts, places)].tolist()
        for start, end in zip(ends, ends[1:]):
            yield ids[start:end].tobytes()

    def _encode(self, piece: str) -> bytes:
        if not _PLAIN.fullmatch(piece):
            return self._whole(piece)
        text = piece.lstrip(" ").lower() if self.lowers else piece
        if not text.isascii():
            text = text.encode().decode("latin-1")
        tokens = self.model.tokenize(text.translate(self.alphabet))
        return array("I", [t.id for t in tokens]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()


def _cuts_are_safe(steps: dict) -> bool:
    """Known steps, no truncation or padding, plain merges, and added tokens that no cut can touch."""
    if (steps["normalizer"], steps["pre_tokenizer"]) not in KNOWN_STEPS or steps["truncation"] or steps["padding"]:
        return False
    model = steps["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix"):
        return False
    plain = re.compile(f"[^{WHITE_SPACE}{LETTERS}{PUNCTUATION}][^{WHITE_SPACE}{PUNCTUATION}]*[^{WHITE_SPACE}{LETTERS}{PUNCTUATION}]")
    return all(plain.fullmatch(t["content"]) and not t["lstrip"] and not t["rstrip"] for t in steps["added_tokens"])


def _piece_starts(letters: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Where pieces start in UTF-8 texts: at each text, and where any text may be cut.

    Cuts are before white space that follows something else, between letters and punctuation, and after a line feed that
    stands alone. What a byte says of the text before does no harm, since a text's start is a cut anyway.
    """
    kinds = _KINDS[letters]
    if len(letters) and letters.max() >= 0x80:
        # Other characters than white space, by their first byte; of those of U+2000 only dashes, quotes and the like.
        two = (letters >= 0xC3) & (letters <= 0xDF)
        three = (letters == 0xE0) | (letters >= 0xE4) & (letters <= 0xEF)
        three[:-2] |= (letters[:-2] == 0xE2) & (letters[1:-1] == 0x80) & (letters[2:] >= 0x90) & (letters[2:] <= 0xA7)
        for size, first in ((2, two), (3, three), (4, letters >= 0xF0)):
            kinds[np.flatnonzero(first) + size - 1] |= SOLID
        latin = np.flatnonzero((letters[:-1] == 0xC3) & (letters[1:] != 0x97) & (letters[1:] != 0xB7))
        kinds[latin] |= LETTER | SOLID
        kinds[latin + 1] |= LETTER
    cut = np.zeros(len(letters) + 1, bool)
    solid, blank = kinds & SOLID > 0, kinds & BLANK > 0
    cut[1:-1] = solid[:-1] & blank[1:] | (kinds[:-1] & LETTER > 0) & (kinds[1:] & POINT > 0)
    cut[2:-1] |= solid[:-2] & (letters[1:-1] == 10) & solid[2:]
    cut[places] = True
    return np.flatnonzero(cut[:-1])


def _byte_alphabet() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else the next free one."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process; its memory outlives a task."""
    known = sys.__dict__.setdefault("_spoolsift_encoders", {})
    if path not in known:
        known[path] = Encoder(path)
    return known[path]
