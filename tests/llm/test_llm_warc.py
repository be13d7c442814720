import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from custvalue.llm import warc as X

NASTY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb\r\n"
PAGES = [
    (1, "http://a/x?y#z", "hello", "clash"), (2, "http://b/", "hello", ""), (3, None, None, ""),
    (4, "http://c/ü", "ünï" * 1000, ""), (5, "http://d\r\nX: y/", NASTY, ""), (6, "", "", ""),
    (None, "http://e/", "hello", ""), (7, "http://f/", "tail\r\n\r\n", ""), (8, "x", "\ufeff\0", ""),
    (4, "http://c/ü", "ünï" * 1000, ""),
]


def expected(rows):
    first = {}
    for page, _, html, _ in rows:
        data = (html or "").encode()
        if page is not None:
            first[data] = min(first.get(data, page), page)
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        response = page == first.get(data, page)
        out.append((page, len(data), digest, "response" if response else "revisit",
                    None if response else first[data]))
    return sorted(out, key=repr)


def round_trip(spark, folder, rows, compression="gzip", payload=True):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    X.write_archives(df.repartition(3), folder, compression)
    return X.read_captures(spark, folder, payload)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, tmp_path, compression):
    got = round_trip(spark, str(tmp_path / "w"), PAGES, compression).collect()
    found = [
        (None if r.page_id is None else int(r.page_id), r.payload_bytes, r.payload_digest,
         r.record_type, None if r.refers_to is None else int(r.refers_to))
        for r in got
    ]
    assert sorted(found, key=repr) == expected(PAGES)
    for r in got:
        assert r.request.record_id and r.metadata.record_id
        if r.record_type == "response":
            page = next(p for p in PAGES if str(p[0]) == str(r.page_id))
            assert bytes(r.response.payload) == (page[2] or "").encode()


def test_without_payloads_and_empty(spark, tmp_path):
    got = round_trip(spark, str(tmp_path / "w"), PAGES, payload=False)
    assert got.count() == len(PAGES)
    none = round_trip(spark, str(tmp_path / "e"), PAGES[:1], payload=False).limit(0)
    assert none.collect() == []
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    X.write_archives(empty, str(tmp_path / "n"))
    assert X.read_captures(spark, str(tmp_path / "n")).collect() == []


def record(kind, name, block=b"", **fields):
    lines = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + name + b">"]
    lines += [k.replace("_", "-").encode() + b": <" + v + b">" for k, v in fields.items()]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_join_whichever_names_the_other(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    foreign = [
        # The response names the request; the metadata names the request.
        record(b"request", b"q1", b"GET"),
        record(b"response", b"r1", http, WARC_Concurrent_To=b"q1"),
        record(b"metadata", b"m1", b"page-id: 5\r\n", WARC_Concurrent_To=b"q1"),
        # Request and metadata name the response.
        record(b"response", b"r2", http + b"2"),
        record(b"request", b"q2", b"GET", WARC_Concurrent_To=b"r2"),
        record(b"metadata", b"m2", b"page-id: 6\r\n", WARC_Concurrent_To=b"q2"),
        # No response: no capture.
        record(b"warcinfo", b"i", b"software: x"),
        record(b"response", b"r3", http),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in foreign))
    rows = {r.capture_id: r for r in X.read_captures(spark, str(tmp_path)).collect()}
    assert set(rows) == {"<r1>", "<r2>", "<r3>"}
    assert (rows["<r1>"].request.record_id, rows["<r1>"].page_id) == ("<q1>", "5")
    assert (rows["<r2>"].request.record_id, rows["<r2>"].page_id) == ("<q2>", "6")
    assert rows["<r3>"].request is None and rows["<r3>"].payload_bytes == 4


def test_broken_archives_are_errors():
    whole = record(b"response", b"r", b"HTTP/1.1 200 OK\r\n\r\nbody")
    assert len(list(X.parse(whole + whole))) == 2
    for broken in (whole[:-8], b"nonsense", whole + b"WARC/1.1\r\n"):
        with pytest.raises(ValueError):
            list(X.parse(broken))


def test_base32_is_that_of_rfc_4648(spark):
    texts = ["", "a", "ü", "x" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", X.base32_sha1(F.encode("t", "UTF-8")).alias("d")).collect()
    for r in rows:
        assert r.d == base64.b32encode(hashlib.sha1(r.t.encode()).digest()).decode()
