import gzip

import pytest

from factline.llm import warc as W


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [("http://a/b c", b"x\n\ny\r\n\r\nz"), ("http://b", b""), ("http://c", "é\n".encode() * 3)]
    records = [(W.safe_url(u), b) for u, b in records]
    got = list(W.parse_arc(W.arc_file(records, version)))
    assert [(h["URL"], b) for h, b in got] == records
    assert all(h["Archive-date"] == W.DATE for h, _ in got)


def test_arc_errors():
    data = W.arc_file([("http://a", b"abc")], 1)
    with pytest.raises(ValueError):
        list(W.parse_arc(data[:-3]))
    with pytest.raises(ValueError):
        list(W.parse_arc(W.arc_file([], 1) + b"no header\n"))


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'x' as first", "'x' as k", "'x' as block", "'x' as n")


def read(spark, rows, **kw):
    out = W.read_archives(spark, W.convert_pages(pages(spark, rows), **kw)).collect()
    assert all(r["intact"] for r in out)
    return {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out}, len(out)


def test_pages_come_back(spark):
    body = "<p>é\r\n\r\nWARC/1.1\r\n</p>\n"
    rows = [(5, "http://a/ b", body), (2, "http://b", body), (9, None, body), (7, "u", None), (8, "u", ""), (4, "u", "x" * 3_000_000)]
    got, n = read(spark, rows)
    d = lambda t: W.digest_of((t or "").encode())
    size = len(body.encode())
    assert n == 6 and got == {
        (2, size, d(body), "response", None), (5, size, d(body), "revisit", 2), (9, size, d(body), "revisit", 2),
        (7, 0, d(""), "response", None), (8, 0, d(""), "revisit", 7), (4, 3_000_000, d("x" * 3_000_000), "response", None),
    }


def test_small_payloads_repeated_rows_null_ids(spark):
    got, _ = read(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], least_bytes=3)
    assert {(p, t, f) for p, _, _, t, f in got} == {(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)}
    got, n = read(spark, [(1, "u", "ab"), (1, "u", "ab"), (None, "u", "ab"), (None, "u", "q"), (None, "u", "q")])
    assert n == 5 and {(p, t, f) for p, _, _, t, f in got} == {(1, "response", None), (None, "revisit", 1), (None, "response", None)}


def test_many_large_payloads_in_one_file(spark):
    """40 MB of pages in a file, some of one line, some that look like records, line ends of all kinds."""
    kinds = ["x" * 1_000_000, "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 30_000, "\n" * 1_000_000, "\r\n\r\n" * 250_000, "\r" * 1_000_000 + "é"]
    rows = [(i, "u", kinds[i % 5] + str(i)) for i in range(40)] + [(100 + i, "u", t) for i, t in enumerate(("\n", "\r", "\r\n\r\n", "\ufeffa", "a\u2028b\x0b\x85"))]
    out = W.read_archives(spark, W.convert_pages(pages(spark, rows).coalesce(1))).collect()
    assert all(r["intact"] and r["record_type"] == "response" for r in out)
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in out} == {(i, len(t.encode()), W.digest_of(t.encode())) for i, _, t in rows}


def test_broken_archives():
    record = W.warc_record(1, "u", "d", "HTTP/1.0 200 OK\r\n\r\na\nb", 3, "x", None).encode()
    assert [b for _, b in W.parse_warc(record.split(b"\n") * 2)] == [b"HTTP/1.0 200 OK\r\n\r\na\nb"] * 2
    for bad in (record[:-9], record.replace(b"a\nb", b"a\nbc"), record[5:]):
        with pytest.raises(ValueError):
            list(W.parse_warc(bad.split(b"\n")))


def test_no_pages(spark):
    assert read(spark, []) == (set(), 0)


def test_files_are_warc(spark):
    folder = W.convert_pages(pages(spark, [(1, "http://a", "<p>")]))
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).collect()
    data = b"".join(gzip.decompress(r["content"]) for r in content)
    head, block = next(W.parse_warc(data.split(b"\n")[:-1]))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and head["WARC-Date"] == "2020-01-01T00:00:00Z" and block.endswith(b"<p>")
