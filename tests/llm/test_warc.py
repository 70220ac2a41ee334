import base64
import gzip
import hashlib
from collections import Counter

import pytest

from tessera.llm import warc
from tessera.llm.store import new_folder

PAGES = "page_id long, url string, html string"


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(pages, least=0):
    """(page_id, bytes, digest, type, refers_to) by a plain loop; a null page_id is the largest."""
    out = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == payload]
        known = [p for p in same if p is not None]
        first = min(known) if known else None
        again = len(same) > 1 and len(payload) >= least and page_id != first
        out.append((page_id, len(payload), sha(payload), "revisit" if again else "response", first if again else None))
    return Counter(out)


def hard_pages():
    long = "é😀x" * 9000
    return [
        (3, "http://a.org/1", "<p>one</p>"), (1, "http://a.org/2", "<p>one</p>"), (2, None, "<p>one</p>"), (4, "u", None), (5, "u\r\nWARC-Type: fake", ""),
        (6, "http://b.org/ä", long), (7, "x y", long), (7, "x y", long), (6, "http://b.org/ä", long), (None, None, "<p>one</p>"), (None, "n", "alone"), (8, "", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 700),
        (9, "z", "\r\n\r\n0\r\n\r\n"), (10, "z", "WARC/1.1\r\n"), (-(2**63), "low", "least id"), (11, "nul", "a\u0000b\r"), (12, "edge", "y" * (warc.SEGMENT * 2)),
    ]


@pytest.mark.parametrize("least", [0, 1, 11, 10**9])
def test_archives_give_back_every_page(spark, least):
    pages = hard_pages()
    df = spark.createDataFrame(pages, PAGES).selectExpr("*", "1 AS number", "'x' AS payload", "'y' AS origin", "0 AS row")
    where = warc.write(df, least=least, segment=1000)
    got = warc.read(spark, where)
    rows = got.collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == brute(pages, least)
    assert not any(r.fault for r in rows) and len({r.record_id for r in rows}) == len(rows)
    whole = Counter((r.page_id, bytes(r.payload)) for r in rows if r.record_type == "response")
    assert whole <= Counter((p, (h or "").encode()) for p, _, h in pages)
    assert {r.page_id: r.url for r in rows}[5] == "u%0D%0AWARC-Type:%20fake"


def test_no_pages_no_records(spark):
    assert warc.read(spark, warc.write(spark.createDataFrame([], PAGES))).collect() == []


def test_results_do_not_depend_on_how_pages_are_dealt(spark):
    pages = [(i, f"http://h/{i}", f"text {i % 7} " * (i % 50)) for i in range(300)]
    for parts in (1, 7):
        df = spark.createDataFrame(pages, PAGES).repartition(parts)
        rows = warc.read(spark, warc.write(df, segment=100), payload=False).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == brute(pages)


def archive(spark, tmp_path, records):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records))
    return sorted(warc.read(spark, f"file://{tmp_path}").collect(), key=lambda r: str(r.page_id))


def test_archives_of_others(spark, tmp_path):
    """Members of their own for each record, folded and odd fields, bodies without chunks,
    chunks with extensions and trailing fields, other types of records, segments in any order."""
    http = b"HTTP/1.0 200 OK\r\nTRANSFER-ENCODING:\r\n chunked\r\n\r\n3;x=y\r\nabc\r\n0002\r\nde\r\n0\r\nTrailer: z\r\n\r\n"
    plain = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nWARC/1.1\r\nbody"
    info = warc.record({"WARC-Type": "warcinfo"}, b"software: x")
    one = warc.record({"warc-type": "response", "WARC-Record-ID": "<a>", "WARC-Page-ID": 1}, http)
    two = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<b>", "WARC-Page-ID": 2}, plain)
    last = warc.record({"WARC-Type": "continuation", "WARC-Segment-Origin-ID": "<c>", "WARC-Segment-Number": 3, "WARC-Segment-Total-Length": len(http)}, http[50:])
    first = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<c>", "WARC-Page-ID": 3, "WARC-Segment-Number": 1}, http[:20])
    middle = warc.record({"WARC-Type": "continuation", "WARC-Segment-Origin-ID": "<c>", "WARC-Segment-Number": 2}, http[20:50])
    got = archive(spark, tmp_path, [info, last, one, middle, two, first])
    assert [(r.page_id, bytes(r.payload), r.fault) for r in got] == [(1, b"abcde", None), (2, b"WARC/1.1\r\nbody", None), (3, b"abcde", None)]


def test_what_is_broken_is_returned_with_its_fault(spark, tmp_path):
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    response = lambda page, block, **more: warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<{page}>", "WARC-Page-ID": page} | {k.replace("_", "-"): v for k, v in more.items()}, block)
    gap = [response(4, head, WARC_Segment_Number=1), warc.record({"WARC-Type": "continuation", "WARC-Segment-Origin-ID": "<4>", "WARC-Segment-Number": 3, "WARC-Segment-Total-Length": 99}, b"0\r\n\r\n")]
    short = [response(5, head, WARC_Segment_Number=1), warc.record({"WARC-Type": "continuation", "WARC-Segment-Origin-ID": "<5>", "WARC-Segment-Number": 2, "WARC-Segment-Total-Length": 999}, b"0\r\n\r\n")]
    lost = warc.record({"WARC-Type": "continuation", "WARC-Segment-Origin-ID": "<gone>", "WARC-Segment-Number": 2, "WARC-Segment-Total-Length": 5}, b"0\r\n\r\n")
    revisit = warc.record({"WARC-Type": "revisit", "WARC-Record-ID": "<6>", "WARC-Page-ID": 6, "WARC-Payload-Digest": "sha1:NOTHING"}, b"")
    records = [response(1, head + b"5\r\nabc"), response(2, head + b"zz\r\n"), response(3, head + b"0\r\n\r\n", WARC_Payload_Digest="sha1:OTHER"), *gap, *short, lost, revisit, b"WARC/1.1\r\nContent-Length: x\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort"]
    faults = Counter((r.page_id, r.fault) for r in archive(spark, tmp_path, records))
    assert faults == Counter([(1, "framing"), (2, "framing"), (3, "digest"), (4, "segments"), (5, "segments"), (None, "segments"), (6, "origin"), (None, "header"), (None, "length")])


def test_framing_is_undone():
    for n in (0, 1, 4095, 4096, 4097, 9000):
        payload = bytes(i * 7 % 256 for i in range(n))
        for chunk in (1, 16, 4096):
            assert warc.payload_of(warc.framed(payload, chunk)) == payload


def test_folders_are_new(spark):
    assert new_folder(spark, "a") != new_folder(spark, "a")
