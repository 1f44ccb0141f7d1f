import io
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spoolsift.llm import counts, encoding, packing, tokenfiles
from spoolsift.llm.encoding import Encoder

from .conftest import ODD

BITS = ["a", "The", "ing", " ", " ", "  ", "\n", " \n", "\t", ".", ",", "'s", "'", "é", "é", "世", "\U0001f600", "ß", "Σ", "1", "½", "▁", "\x1c", "\xa0", "-", "<s>", "<|endoftext|>"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(25))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_ids_of_the_library(vocabularies, name):
    encoder, library = Encoder(vocabularies[name]), Tokenizer.from_file(vocabularies[name])
    texts = odd_texts(2000) + [t or "" for _, t in ODD]
    for text, encoding in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert encoder.encode(text) == np.array(encoding.ids, "<u4").tobytes(), text


MORE_BITS = [*BITS, "word", "\r", "\x85", "\u2009", "\u2019", "\u2014", "\u201d", "\u2028", "\u202f", "\u3000", "か", "\u0301", "я", "×", ";", "?!", "12"]


@pytest.mark.parametrize("stretch", [1, 40, encoding.STRETCH])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_columns_give_the_ids_of_the_library(vocabularies, monkeypatch, name, stretch):
    monkeypatch.setattr(encoding, "STRETCH", stretch)
    rng = random.Random(7)
    texts = ["".join(rng.choices(MORE_BITS, k=rng.randrange(25))) for _ in range(4000)]
    texts += [t for _, t in ODD] + [None, "", None]
    library, encoder = Tokenizer.from_file(vocabularies[name]), Encoder(vocabularies[name])
    expected = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for column in (pa.array(texts, pa.string()), pa.array(texts, pa.large_string())):
        assert list(encoder.encode_column(column)) == expected
        assert list(encoder.encode_column(column[5:-2])) == expected[5:-2]
    for few in ([], [None], ["", None], ["\n"]):
        ids = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in few]
        assert list(encoder.encode_column(pa.array(few, pa.string()))) == ids
    encoder.cuts = False
    assert list(encoder.encode_column(pa.array(texts[-30:], pa.string()))) == expected[-30:]


def test_each_piece_of_a_column_is_looked_up_once(vocabularies):
    """Looking up every word of every text was most of the time of op4."""
    encoder, asked = Encoder(vocabularies["byte_bpe_50k.json"]), []

    class Asked(dict):
        def __missing__(self, piece):
            asked.append(piece)
            return encoder._encode(piece)

    encoder.pieces = Asked()
    texts = ["The cat, été fini. The end\nThe cat”", " cat, the été."] * 50
    list(encoder.encode_column(pa.array(texts)))
    assert sorted(asked) == sorted({"The", " cat", ",", " été", " fini", ".", " The", " end", "\n", " cat”", " the"})


@pytest.mark.parametrize("chunk", [1, 5, counts.CHUNK])
def test_transducer_counts_as_the_library(vocabularies, monkeypatch, chunk):
    monkeypatch.setattr(counts, "CHUNK", chunk)
    path = vocabularies["piece_bpe_32k.model"]
    machine, library = counts.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [library.id_to_piece(i) for i in range(300, 32000, 7)]
    rng = random.Random(2)
    texts = odd_texts(1500) + ["".join(rng.choices(pieces, k=5)) for _ in range(1500)]
    texts += [" " * n for n in range(40)] + ["=" * n for n in range(80)]
    for text in texts:
        assert machine.count(text) == len(library.encode(text)), text


def test_transducer_may_forget(vocabularies, monkeypatch):
    path = vocabularies["piece_bpe_32k.model"]
    texts = odd_texts(200)
    expected = [counts.Transducer(path).count(t) for t in texts]
    monkeypatch.setattr(counts, "STATES_KEPT", 10)
    machine = counts.Transducer(path)
    assert [machine.count(t) for t in texts] == expected
    assert len(machine.states) < 200


def test_token_counts_of_odd_rows(odd_docs, no_docs, vocabularies):
    path = vocabularies["piece_bpe_32k.model"]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    found = counts.token_counts(odd_docs, path, limit=100)
    assert set(found.columns) == {*odd_docs.columns, "n_bytes", "over_limit"}
    rows = sorted(((r.doc_id or -1, r.text or "", r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect()))
    expected = [(i or -1, t or "", len((t or "").encode()), len(library.encode(t or ""))) for i, t in ODD]
    assert rows == sorted((*e, e[3] > 100) for e in expected)
    assert counts.token_counts(no_docs, path).count() == 0


def test_files_hold_what_was_written_and_single_documents_can_be_read(monkeypatch):
    monkeypatch.setattr(tokenfiles, "IDS_A_FRAME", 8)
    rng = random.Random(3)
    docs = [(i, rng.randbytes(4 * rng.randrange(1, 30))) for i in range(40)] + [(None, b"abcd"), (7, b"efgh")]
    stream = io.BytesIO()
    writer = tokenfiles.Writer(stream)
    for doc in docs:
        writer.add(*doc)
    writer.close()
    reader = tokenfiles.Reader(stream)
    assert [(i, ids) for i, _, ids in reader.read()] == docs
    assert [(i, ids) for i, _, ids in reader.read([7, 20, 1000])] == [docs[7], docs[20], docs[-1]]

    # Only the wanted document's frames are touched: damage elsewhere goes unseen, in it the checksum tells.
    at = int(reader.offsets[reader.firsts[20]])
    raw = bytearray(stream.getvalue())
    raw[at + 9] ^= 1
    damaged = tokenfiles.Reader(io.BytesIO(bytes(raw)))
    assert [(i, ids) for i, _, ids in damaged.read([19])] == [docs[19]]
    with pytest.raises(Exception):
        list(damaged.read([20]))


def test_a_file_is_a_plain_stream_to_other_tools():
    import zstandard

    stream = io.BytesIO()
    writer = tokenfiles.Writer(stream)
    for i in range(5):
        writer.add(i, bytes([i]) * 8)
    writer.close()
    stream.seek(0)
    plain = zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)
    assert plain.read(40) == b"".join(bytes([i]) * 8 for i in range(5))


def test_token_files_of_odd_rows(odd_docs, no_docs, vocabularies):
    path = vocabularies["byte_bpe_50k.json"]
    files = tokenfiles.write_token_files(odd_docs, path)
    rows = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in tokenfiles.read_token_files(files).collect()]
    rows.sort(key=lambda r: r[1])
    assert [r[1] for r in rows] == [sum(r[2] for r in rows[:i]) for i in range(len(rows))]
    assert [r[0] for r in rows] == sorted((i for i, _ in ODD), key=lambda i: -1 if i is None else i)
    library = Tokenizer.from_file(path)
    ids = lambda t: np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
    assert sorted((r[0] or -1, r[3]) for r in rows) == sorted((i or -1, ids(t)) for i, t in ODD)
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(no_docs, path)).count() == 0


def test_sum_of_squares_fills_sequences():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 101, 3000)
    bins, offsets = packing.pack(sizes, 100)
    order = np.lexsort((offsets, bins))
    ends = (offsets + sizes)[order]
    same = bins[order][1:] == bins[order][:-1]
    assert (offsets[order][1:] == np.where(same, ends[:-1], 0)).all()
    assert ends.max() <= 100
    assert bins.max() + 1 <= 1.01 * -(-sizes.sum() // 100)
    assert packing.pack(np.zeros(0, np.int64), 100)[0].size == 0


def test_finishing_reaches_the_least_number_of_sequences():
    """No packing of these sizes needs fewer than 1,536: a size x of 100 may count as floor(3x) / 2, or as x where 3x is whole."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 101, 3000)
    least = -(-sum(3 * s if 3 * s % 100 == 0 else 150 * (3 * s // 100) for s in sizes.tolist()) // 300)
    assert least == 1536
    bins, _ = packing.pack(sizes, 100)
    assert bins.max() + 1 == least


@pytest.mark.parametrize("seed", range(6))
def test_rule_places_by_the_sum_of_squares(monkeypatch, seed):
    monkeypatch.setattr(packing, "_finished", lambda held, sizes, capacity: held)
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 40))
    sizes = rng.integers(1, capacity + 1, 200)
    bins, offsets = packing.pack(sizes, capacity)
    fill = []
    for i, size in enumerate(sizes.tolist()):

        def squares(k):
            after = [n + size * (j == k) for j, n in enumerate([*fill, 0])]
            counts = defaultdict(int)
            for n in after:
                counts[n] += 0 < n < capacity
            return sum(c * c for c in counts.values())

        best = min(squares(k) for k, n in enumerate([*fill, 0]) if n + size <= capacity)
        k = int(bins[i])
        assert squares(k) == best and offsets[i] == (fill[k] if k < len(fill) else 0)
        fill = [*fill, 0] if k == len(fill) else fill
        fill[k] += size


def test_a_vocabulary_with_other_steps_is_left_to_the_library(vocabularies, tmp_path):
    steps = json.loads(Tokenizer.from_file(vocabularies["byte_bpe_50k.json"]).to_str())
    steps["normalizer"] = {"type": "Replace", "pattern": {"String": "e T"}, "content": "x"}
    path = str(tmp_path / "other.json")
    (tmp_path / "other.json").write_text(json.dumps(steps))
    encoder, library = Encoder(path), Tokenizer.from_file(path)
    assert not encoder.cuts
    for text in [*odd_texts(50), "the The end"]:
        assert encoder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_memory_keeps_what_is_met_again(monkeypatch):
    monkeypatch.setattr(encoding, "KEPT", 3)
    asked = []
    memory = encoding.Memory(lambda key: asked.append(key) or key.encode())
    for key in "abcabdaeafaga":
        assert memory[key] == key.encode()
    assert asked.count("a") == 1 and len(memory) + len(memory.older) <= 6


def test_rule_keeps_rooms_varied():
    # Room 4 is there twice, room 6 once: 3 goes where it leaves fewer squares.
    bins, _ = packing.pack(np.array([6, 6, 4, 3]), 10)
    assert bins[2] in (0, 1) and bins[3] != bins[2]


def test_packing_of_odd_rows(odd_docs, no_docs, vocabularies, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_GROUP", 4)
    path = vocabularies["word_bpe_49k.json"]
    rows = packing.pack_documents(odd_docs, path, end_id=1, capacity=64).collect()
    library = Tokenizer.from_file(path)
    expected = []
    for i, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 64):
            part = ids[at : at + 64]
            expected.append((i or -1, at // 64, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= 64
    assert len(held) <= sum(e[3] for e in expected) / 64 + 4
    assert packing.pack_documents(no_docs, path).count() == 0
