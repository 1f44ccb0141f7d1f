"""WARC archives of pages, and a normaliser for archives that were compressed as one stream.

Archives come as whole-file gzip streams. The normaliser inflates such a stream once from begin to end, writes every record
as a gzip member of its own to a new archive, and beside it an index with offset and size of each member, by which a
single record can be read.
"""

import base64
import gzip
import hashlib
import json
import sys
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolsift.llm.tables import Scratch, kept, text_key, work_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, name: str, date: str) -> bytes:
    """A response with its payload, or a revisit without that names the record with an equal one."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        "WARC-Date": date,
        "WARC-Target-URI": json.dumps(url)[1:-1] if url else "",
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "Content-Type": "application/http; msgtype=response",
        "X-Page-Id": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        headers |= {"WARC-Profile": SAME_PAYLOAD, "X-Refers-To-Page": str(refers_to)}
    return record(headers, http if revisit else http + payload)


class Records:
    """The records of an uncompressed stream, one after the other; at most one of them is in memory."""

    def __init__(self, stream):
        self.stream = stream
        self.rest = b""

    def _more(self) -> bool:
        part = self.stream.read(READ)
        self.rest += part
        return bool(part)

    def __iter__(self) -> Iterator[bytes]:
        while True:
            while (end := self.rest.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.rest.strip():
                        raise ValueError("the archive ends inside a record's header")
                    return
            size = end + 4 + int(headers_of(self.rest[:end])["content-length"]) + 4
            parts, have = [self.rest], len(self.rest)
            while have < size:
                part = self.stream.read(READ)
                if not part:
                    raise ValueError("the archive ends inside a record")
                parts.append(part)
                have += len(part)
            whole = b"".join(parts)
            self.rest = whole[size:]
            yield whole[:size]


def headers_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    return dict(_field(line) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)


def _field(line: str) -> tuple[str, str]:
    name, _, value = line.partition(":")
    return name.strip().lower(), value.strip()


def normalise(source, target) -> list[tuple[int, int, str]]:
    """Rewrite one gzip stream as a member per record; (offset, size, record id) of each."""
    index, at = [], 0
    with gzip.GzipFile(fileobj=source) as plain:
        for whole in Records(plain):
            # No time in the member's header, so that the same records give the same bytes.
            member = gzip.compress(whole, compresslevel=6, mtime=0)
            target.write(member)
            index.append((at, len(member), headers_of(whole[: whole.index(b"\r\n\r\n")])["warc-record-id"]))
            at += len(member)
    return index


def _decided(pages: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """page_id, url, html, refers_to: the page with the largest id among those of the same payload, else null."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        text_key("html").alias("_key"),
        F.sha1(html.cast("binary")).alias("_sha1"),
    )
    # Only ids and digests meet. A page without id refers to others, but none refers to it.
    ids = keyed.where(F.octet_length("html") >= least).select("page_id", "_key", "_sha1")
    last = ids.groupBy("_sha1").agg(F.max("page_id").alias("_last"), F.count("*").alias("_many"))
    last = last.where((F.col("_many") > 1) & F.col("_last").isNotNull())
    found = ids.join(last, "_sha1").where(~F.col("page_id").eqNullSafe(F.col("_last")))
    found = found.groupBy(F.col("page_id").alias("_id"), F.col("_key").alias("_of")).agg(F.first("_last").alias("refers_to"))
    found = scratch.keep(found, "revisits")
    joined = keyed.join(found, keyed["page_id"].eqNullSafe(found["_id"]) & (keyed["_key"] == found["_of"]), "left")
    return joined.select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, least: int = 0, folder: str | None = None, date: str | None = None) -> DataFrame:
    """Write a record for every page (page_id, url, html) into archives of one gzip stream each; the table of them: part, file.

    Of pages with equal payloads of ``least`` bytes or more, that with the largest page_id is a response and the others are
    revisits of it; smaller ones are all responses. A null html is empty; pages without id are revisits if one with an id
    has their payload, else responses; rows that share the largest id are all responses; repeated rows give repeated
    records. An empty table gives no archive. The table says which files count; a task that runs again writes another.
    """
    spark = pages.sparkSession
    folder = folder or f"{work_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    decided = _decided(pages, least, Scratch(spark, "warc"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        archive = None
        n = 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if archive is None:
                    part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
                    store, place = fs.FileSystem.from_uri(folder)
                    store.create_dir(place, recursive=True)
                    name = f"{part:06d}-{attempt}.whole.warc.gz"
                    stream = store.open_output_stream(f"{place}/{name}", compression=None)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    archive = f"{folder}/{name}"
                page_id = None if pd.isna(row.page_id) else int(row.page_id)
                refers_to = None if pd.isna(row.refers_to) else int(row.refers_to)
                payload = row.html.encode("utf-8", "surrogatepass")
                stream.write(packer.compress(page_record(page_id, row.url, payload, refers_to, f"{part}/{n}", date)))
                n += 1
        if archive is not None:
            stream.write(packer.flush())
            stream.close()
            yield pd.DataFrame({"part": [part], "file": [archive], "n_records": [n]})

    return kept(decided.mapInPandas(write, "part int, file string, n_records long"), "archives")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """Rewrite each archive of one gzip stream (column file) as one of a member per record, with an index beside it.

    The table of the new ones: file, index_file, n_records. The index has a line of offset, size and record id for each record.
    """
    dealt = archives.select("file").repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for file in batch["file"]:
                store, place = fs.FileSystem.from_uri(file)
                mark = f"{file.removesuffix('.whole.warc.gz')}-{TaskContext.get().taskAttemptId()}"
                _, new = fs.FileSystem.from_uri(mark)
                with store.open_input_stream(place, compression=None) as source:
                    with store.open_output_stream(f"{new}.warc.gz", compression=None) as target:
                        index = normalise(source, target)
                lines = "".join(f"{offset} {size} {name}\n" for offset, size, name in index)
                with store.open_output_stream(f"{new}.idx", compression=None) as target:
                    target.write(lines.encode())
                yield pd.DataFrame({"file": [f"{mark}.warc.gz"], "index_file": [f"{mark}.idx"], "n_records": [len(index)]})

    return kept(dealt.mapInPandas(rewrite, "file string, index_file string, n_records long"), "normalised")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of normalised archives, each read by its place in the index: page_id, url, payload (null in a revisit),
    payload_bytes, payload_digest, record_type, refers_to. A payload that does not match its digest raises."""
    dealt = archives.repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for file, index_file in zip(batch["file"], batch["index_file"]):
                store, place = fs.FileSystem.from_uri(file)
                with store.open_input_stream(fs.FileSystem.from_uri(index_file)[1], compression=None) as stream:
                    lines = stream.read().decode().splitlines()
                with store.open_input_file(place) as stream:
                    rows, size = [], 0
                    for line in lines:
                        offset, length, _ = line.split(" ", 2)
                        stream.seek(int(offset))
                        rows.append(_parsed(gzip.decompress(stream.read(int(length)))))
                        size += len(rows[-1][2] or b"")
                        if size >= 1 << 22:
                            yield _pages(rows)
                            rows, size = [], 0
                    yield _pages(rows)

    return dealt.select("file", "index_file").mapInPandas(
        read,
        "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def _parsed(whole: bytes) -> tuple:
    end = whole.index(b"\r\n\r\n")
    fields = headers_of(whole[:end])
    block = whole[end + 4 : end + 4 + int(fields["content-length"])]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    payload = None
    if fields["warc-type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if payload_digest(payload) != digest or len(payload) != int(fields["x-payload-length"]):
            raise ValueError(f"record {fields['warc-record-id']} does not match its digest")
    page, refers_to = fields["x-page-id"], fields.get("x-refers-to-page")
    url = json.loads(f'"{fields["warc-target-uri"]}"') or None
    size = int(fields["x-payload-length"])
    return int(page) if page else None, url, payload, size, digest, fields["warc-type"], int(refers_to) if refers_to else None


def _pages(rows: list[tuple]) -> pd.DataFrame:
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
