"""Token ids in files from which single documents can be read.

A file is a row of independent zstandard frames, after which come two skippable ones: the documents (id, tokens,
frames) and the seek table of the public seekable format, with size and checksum of every frame. A reader gets
the end of the file, finds a document's frames by it and decompresses nothing else; any zstandard tool reads
the file as one stream of all ids.
"""

import struct
import sys
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoolsift.llm import encoding
from spoolsift.llm.encoding import encoder
from spoolsift.llm.tables import kept, text_key, work_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(encoding)

# Fixed values of the seekable format: skippable frames, and the mark at the end of a file.
DOCUMENTS_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
END_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

# Ids in one frame at most; longer documents take several.
IDS_A_FRAME = 1 << 20
_DOCUMENT = np.dtype([("id", "<i8"), ("known", "u1"), ("tokens", "<u8"), ("frames", "<u4")])
_FILES = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_FRAME = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])


class Broken(ValueError):
    """A file or frame that is not what was written."""


class Writer:
    """Writes documents one by one to an open binary stream."""

    def __init__(self, stream, level: int = 3):
        import zstandard

        self.stream = stream
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.frames: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int, bool, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        step = 4 * IDS_A_FRAME
        for at in range(0, len(ids), step):
            plain = ids[at : at + step]
            packed = self.packer.compress(plain)
            self.stream.write(packed)
            self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        known = doc_id is not None
        self.documents.append((doc_id if known else 0, known, len(ids) // 4, -(-len(ids) // step)))

    def close(self) -> None:
        documents = np.array(self.documents, _DOCUMENT).tobytes()
        self.stream.write(struct.pack("<II", DOCUMENTS_MAGIC, len(documents)) + documents)
        table = np.array([*self.frames, (8 + len(documents), 0, 0)], _FRAME)
        body = table.tobytes() + struct.pack("<IBI", len(table), WITH_CHECKSUMS, END_MAGIC)
        self.stream.write(struct.pack("<II", TABLE_MAGIC, len(body)) + body)


class Reader:
    """Reads documents from an open, seekable binary stream; only their frames are decompressed."""

    def __init__(self, stream):
        import zstandard

        self.stream = stream
        self.unpacker = zstandard.ZstdDecompressor()
        stream.seek(0, 2)
        size = stream.tell()
        count, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != END_MAGIC or flags != WITH_CHECKSUMS:
            raise Broken("no seek table at the end")
        start = size - 9 - count * _FRAME.itemsize
        table = np.frombuffer(self._read(start, count * _FRAME.itemsize), _FRAME)
        self.table = table[:-1]
        self.offsets = np.concatenate([[0], np.cumsum(self.table["packed"].astype(np.int64))])
        packed = int(table["packed"][-1])
        raw = self._read(start - 8 - packed, packed)
        if struct.unpack("<II", raw[:8]) != (DOCUMENTS_MAGIC, packed - 8):
            raise Broken("no list of documents")
        self.documents = np.frombuffer(raw[8:], _DOCUMENT)
        self.firsts = np.concatenate([[0], np.cumsum(self.documents["frames"].astype(np.int64))])

    def _read(self, at: int, size: int) -> bytes:
        if at < 0:
            raise Broken("the file is too short")
        self.stream.seek(at)
        return self.stream.read(size)

    def ids(self, place: int) -> bytes:
        """Ids of the document at a place in the file."""
        import xxhash

        parts = []
        for k in range(int(self.firsts[place]), int(self.firsts[place + 1])):
            packed, plain, checksum = (int(v) for v in self.table[k])
            part = self.unpacker.decompress(self._read(int(self.offsets[k]), packed), max_output_size=plain)
            if len(part) != plain or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != checksum:
                raise Broken(f"frame {k} does not match its checksum")
            parts.append(part)
        return b"".join(parts)

    def read(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(id, tokens of the file before it, ids) of all documents, or of those wanted."""
        before = np.cumsum(self.documents["tokens"]) - self.documents["tokens"]
        known = self.documents["known"].astype(bool)
        chosen = range(len(known)) if wanted is None else np.flatnonzero(known & np.isin(self.documents["id"], [*wanted]))
        for place in chosen:
            yield int(self.documents["id"][place]) if known[place] else None, int(before[place]), self.ids(place)


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encode whole texts, end each with ``end_id``, and write them in ascending doc_id order; the table of the files.

    The table (part, file, n_docs, n_tokens) is in order of ``part``. It alone says which files count: a task that
    was run again leaves another file behind that is not in it. A null text is empty and has its end id only; null
    ids come first; rows of one id follow each other by a hash of their text, so that one id may hold any share of the
    rows; repeated rows are written as often. An empty table gives an empty table of files. Extra columns are ignored.
    ``folder`` is on storage that all executors share, by default in that of spark.checkpoint.dir. Ranges become files, as
    many as the session's shuffle partitions at most; a task writes as it reads, so a range of any size is fine.
    """
    folder = folder or f"{work_folder(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), text_key().alias("_key"))
    dealt = rows.repartitionByRange("doc_id", "_key").sortWithinPartitions("doc_id", "_key")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        words, end = encoder(vocabulary), struct.pack("<I", end_id)
        writer = None
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), words.encode_column(batch["text"])):
                if writer is None:
                    part = TaskContext.get().partitionId()
                    attempt = TaskContext.get().taskAttemptId()
                    store, place = fs.FileSystem.from_uri(folder)
                    store.create_dir(place, recursive=True)
                    name = f"{part:06d}-{attempt}.ids.zst"
                    writer = Writer(store.open_output_stream(f"{place}/{name}", compression=None))
                writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            writer.stream.close()
            tokens = sum(d[2] for d in writer.documents)
            row = {"part": part, "file": f"{folder}/{name}", "n_docs": len(writer.documents), "n_tokens": tokens}
            yield pa.RecordBatch.from_pylist([row], _FILES)

    files = dealt.select("doc_id", "text").mapInArrow(write, "part int, file string, n_docs long, n_tokens long")
    return kept(files, "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32).

    One row of ``files`` is one file, so the running sum over them is short. A damaged frame raises. Documents come as they were
    written: null ids stay null, those of empty texts have the end id only, repeated rows come as often; no file, no row.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    dealt = placed.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for file, before in zip(batch["file"], batch["before"]):
                store, place = fs.FileSystem.from_uri(file)
                with store.open_input_file(place) as stream:
                    rows, size = [], 0
                    for doc_id, start, ids in Reader(stream).read():
                        rows.append((doc_id, before + start, len(ids) // 4, ids))
                        size += len(ids)
                        if size >= 1 << 22:
                            yield _documents(rows)
                            rows, size = [], 0
                    yield _documents(rows)

    return dealt.select("file", "before").mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def _documents(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])
    return frame.astype({"doc_id": "Int64"})
