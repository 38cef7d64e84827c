import base64
import hashlib
import io

import pytest

from agora.llm.warc import ArchiveWriter, archive_pages, build_dictionary, page_row, parse_record, read_archive, record
from tests.llm.cases import prose

PAGES = "page_id long, url string, html string"


def table():
    rows = [(i, f"http://h{i % 3}.example.com/{i}", f"<html><body><p>{prose(i % 20, 60)}</p></body></html>") for i in range(60)]
    return rows + [
        (100, None, None), (101, "http://x.example.com/", ""), (102, "bad\r\nurl: x", "é" * 3), (103, "http://long.example.com/", "x" * 3_000_000),
        (104, "http://tie.example.com/", "é" * 3), (105, "u", "WARC/1.1\r\n\r\n(µµ"), (106, "u", "p"), (106, "u", "p"), (None, "u", "p"), (None, None, None),
    ]


def test_round_trip(spark):
    from tests.llm.cases import clashing

    rows = table()
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    got = archive_pages(clashing(spark.createDataFrame(rows, PAGES).repartition(3))).collect()
    want = []
    for i, _, t in rows:
        data = (t or "").encode()
        keep = i is None or first[t or ""] == i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if keep else "revisit", None if keep else first[t or ""]))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.record_type == "revisit" for r in got) > 35


def test_smaller_payloads_are_always_responses(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    got = archive_pages(spark.createDataFrame(rows, PAGES), least_bytes=5).collect()
    assert {r.page_id: r.refers_to for r in got} == {1: None, 2: None, 3: None, 4: 3}


def test_unlike_rows_of_one_page(spark):
    rows = [(1, "u", "AAA"), (5, "u", "AAA"), (5, "u", "BBB"), (7, "u", "BBB")]
    got = archive_pages(spark.createDataFrame(rows, PAGES)).collect()
    named = {base64.b32encode(hashlib.sha1(t).digest()).decode(): t for t in (b"AAA", b"BBB")}
    assert sorted((r.page_id, named[r.payload_digest], r.record_type, r.refers_to) for r in got) == [
        (1, b"AAA", "response", None), (5, b"AAA", "revisit", 1), (5, b"BBB", "response", None), (7, b"BBB", "revisit", 5),
    ]


def test_empty_table(spark):
    assert archive_pages(spark.createDataFrame([], PAGES)).count() == 0


def archive(pages, dictionary):
    sink = io.BytesIO()
    writer = ArchiveWriter(sink, dictionary)
    offsets = [writer.add(record(i, f"http://a/{i}", p, None)) for i, p in enumerate(pages)]
    return sink.getvalue(), offsets


def test_records_are_read_alone_and_the_dictionary_helps():
    pages = [f"<html><head><title>{i}</title></head><body>{prose(i, 40)}</body></html>".encode() for i in range(300)]
    data, offsets = archive(pages, build_dictionary(pages, 8192))
    assert [o for o, _ in read_archive(io.BytesIO(data), 777)] == offsets
    rows = [page_row(parse_record(d)) for _, d in read_archive(io.BytesIO(data))]
    assert [r[1] for r in rows] == [len(p) for p in pages]
    plain, _ = archive(pages, b"")
    assert len(data) < len(plain)


def test_damage_is_noticed():
    data, offsets = archive([b"one page", b"another page"], b"")
    with pytest.raises(Exception):
        list(read_archive(io.BytesIO(data[:-3])))
    with pytest.raises(ValueError):
        list(read_archive(io.BytesIO(b"no dictionary here")))
    broken = record(1, "u", b"payload", None).replace(b"payload", b"pAyload")
    with pytest.raises(ValueError):
        page_row(parse_record(broken))
