import base64
import gzip
import hashlib
import io

import pytest

from spoolsift.llm import warc


def test_one_stream_becomes_a_member_for_each_record():
    payloads = [b"", b"a" * 3_000_000, b"\r\n\r\nWARC/1.1\r\n", "größe".encode()]
    records = [warc.page_record(i, f"http://h/{i}", p, None, f"n{i}", "2026-01-01T00:00:00Z") for i, p in enumerate(payloads)]
    whole, target = gzip.compress(b"".join(records)), io.BytesIO()
    index = warc.normalise(io.BytesIO(whole), target)
    raw = target.getvalue()
    assert [gzip.decompress(raw[at : at + size]) for at, size, _ in index] == records
    assert gzip.decompress(raw) == b"".join(records)
    assert sum(size for _, size, _ in index) == len(raw)
    assert len({name for *_, name in index}) == len(records)


@pytest.mark.parametrize("cut", [5, 200])
def test_a_cut_stream_is_an_error(cut):
    whole = warc.page_record(1, "u", b"x" * 100, None, "n", "2026-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(gzip.compress(whole[:-cut])), io.BytesIO())


def test_odd_pages(spark):
    pages = [
        (1, "http://a/\r\nX: 1", "<p>same</p>"),
        (5, None, "<p>same</p>"),
        (3, "", "<p>same</p>"),
        (2, "u", None),
        (4, "u", ""),
        (6, "ü", "größe \U0001f600\r\n\r\n"),
        (7, "u", "x" * 2_000_000),
        (9, "u", "twice"),
        (9, "u", "twice"),
        (None, "u", "<p>same</p>"),
        (None, None, "alone"),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS refers_to", "'x' AS _sha1")
    read = warc.read_archives(warc.normalise_archives(warc.write_archives(table.repartition(3))))
    rows = sorted(map(tuple, read.collect()), key=lambda r: (r[0] or 0, r[1] or ""))
    last = {"<p>same</p>": 5, "": 4, "twice": 9}
    expected = []
    for page, url, html in pages:
        raw = (html or "").encode()
        refers = last.get(html or "")
        refers = refers if refers != page else None
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        kind = "revisit" if refers else "response"
        expected.append((page, url or None, None if refers else bytearray(raw), len(raw), digest, kind, refers))
    assert rows == sorted(expected, key=lambda r: (r[0] or 0, r[1] or ""))


def test_small_payloads_and_empty_tables(spark):
    table = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    read = warc.read_archives(warc.normalise_archives(warc.write_archives(table, least=3))).collect()
    assert {r.page_id: r.refers_to for r in read} == {1: None, 2: None, 3: 4, 4: None}
    assert warc.read_archives(warc.normalise_archives(warc.write_archives(table.where("false")))).count() == 0
