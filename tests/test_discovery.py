"""Links and payload types on literal pages and bytes with known answers."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from factline.operators import discovery as D


def links(spark, *pages):
    df = spark.createDataFrame([(i, "http://h.org/a/p.html", h) for i, h in enumerate(pages)], "id int, url string, html string")
    out = {}
    for r in sorted(D.link_candidates(df, "id", "url", "html").collect(), key=lambda r: (r.id, r.pos)):
        out.setdefault(r.id, []).append((r.url.removeprefix("http://h.org"), r.text))
    return [out.get(i, []) for i in range(len(pages))]


def test_pages_with_known_links(spark):
    got = links(
        spark,
        "<!-- <a href='/old.csv'>old</a> --><a title=\"a>b\" href='/d.csv'>new <b class='x>y'>one</b></a>",
        "<script>var x = '<a href=\"/js.csv\">';</script><style><a href=/css></style><a href=/ok.csv>ok</a>",
        "<a href='/x&#8211;y.csv'>caf&eacute; &#x2013; &amp;amp; &#150; &nope; &#0; &#xD800; AT&T</a>",
        "<a title=it's href=/first>don't</a> <a title=\"href='/wrong'\" href='/right'>r</a>",
        "<div title=\"<!-- \"><a href=/kept>k</a></div><div data-url='/f.csv' data-file-url=/g.csv>data-url=/text.csv</div>",
        "<a href=\"/open>text</a><A HREF=/upper>U</A><link rel=x href=/l.css><a href='mailto:x@y'>m</a><a>none</a><a href=''>e</a>",
        "<!-- never closed <a href=/lost>", "", None,
    )
    assert got == [
        [("/d.csv", "new one")],
        [("/ok.csv", "ok")],
        [("/x–y.csv", "café – &amp; – &nope; � � AT&T")],
        [("/first", "don't"), ("/right", "r")],
        [("/kept", "k"), ("/f.csv", ""), ("/g.csv", "")],
        [("/upper", "U"), ("/l.css", "")],
        [], [], [],
    ]


def test_very_long_tags_and_many_links(spark):
    page = f"<a title='{'y ' * 40_000}' href=/long>{'t' * 50_000}</a>" + "".join(f"<a class=c{i} href='/n{i}'>n</a>" for i in range(5000))
    (got,) = links(spark, page)
    assert len(got) == 5001 and got[0] == ("/long", "t" * 50_000)


def archive(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "x")
    return out.getvalue()


@pytest.mark.parametrize("content,kind", [
    (b"\x89PNG\r\n\x1a\n\x00\xff", "csv"), ("Name,Größe".encode("latin-1"), "csv"), ("größe".encode("latin-1"), "text"), ("größe".encode(), "text"),
    (b"\xff\xfe" + '{"a": 1}'.encode("utf-16-le"), "json"), (b"\xfe\xff" + "<html>".encode("utf-16-be"), "html"), (b"\xff\xfe\x00", "text"),
    (b"\xef\xbb\xbf{}", "json"), (b"\n\t <!DOCTYPE html><p>", "html"), (b"  [1]", "json"), (b"a\tb", "tsv"), (b"", "text"), (b"MZ\x90", "executable"), (b"\x1f\x8b\x08", "gz"),
    (b"%PDF-1.7 \xe2\xe3", "pdf"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1..", "xls"), (b"PK\x03\x04 cut off", "invalid_zip"),
    (archive("a.csv"), "zip"), (archive("[Content_Types].xml", "xl/workbook.xml"), "xlsx"), (archive("[Content_Types].xml", "word/document.xml"), "docx"),
    (archive("[Content_Types].xml", "ppt/presentation.xml"), "pptx"), (archive("xl/workbook.xml"), "zip"),
])
def test_payloads_of_every_kind(spark, content, kind):
    df = spark.createDataFrame([(bytearray(content),)], "c binary").select(D.sniff(F.col("c")).alias("k"), D.validity(D.sniff(F.col("c")), F.col("c"), F.length("c"), ["csv"], 0).alias("v"))
    row = df.first()
    assert row.k == kind and row.v == {"executable": "executable", "text": "unrecognized", "html": "html_instead_of_data"}.get(kind)


def test_challenges_are_seen_in_any_encoding(spark):
    page = "<html>Please Sign in"
    rows = [(bytearray(b),) for b in (page.encode(), b"\xff\xfe" + page.encode("utf-16-le"), page.encode() + b"\xe9")]
    got = spark.createDataFrame(rows, "c binary").select(D.validity(D.sniff(F.col("c")), F.col("c"), F.length("c"), ["html"]).alias("v")).collect()
    assert [r.v for r in got] == ["challenge_page"] * 3
