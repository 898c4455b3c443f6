"""Long pages, ids and record files of the WARC operator."""
import time
from collections import Counter

import pytest

from tessera.llm import warc

BIG = 9007199254740993


def test_ids_next_to_nulls(spark):
    pages = spark.createDataFrame([(BIG, "http://a/", "x"), (None, "http://b/", "y"), (-BIG, None, None)], "page_id long, url string, html string")
    found = warc.derive(warc.responses(pages.coalesce(1))).collect()
    assert Counter(r.page_id for r in found) == {BIG: 2, None: 2, -BIG: 2}


@pytest.mark.parametrize("opener", ["<!--", "<script>", "<head>", "<template >", "<", "<title>", "<a ", "<a href=\"", "<a href='x", "<html lang", "</script ",
                                    "&#1", "<p", "<a href=x><", " \n", "<noscript><!-->"])
def test_long_pages_end(opener):
    page = opener * (5_000_000 // len(opener))
    start = time.process_time()
    warc.plain_text(page), warc.page_facts(page)
    assert time.process_time() - start < 6


def test_unclosed_elements():
    assert warc.plain_text("a<!-- b") == "a" and warc.plain_text("a<script>b") == "a" and warc.plain_text("a<head>b<head>c") == "abc"
    assert warc.plain_text("1 < 2") == "1 < 2" and warc.plain_text("x<br>y<b>z</b>") == "x\nyz"
    assert warc.plain_text("<style>s</STYLE >a<!-- > -->b") == "a b" and warc.plain_text("&#" + "9" * 5000 + ";") == "�"
    facts = warc.page_facts("<HTML x='1' lang=FR><title>A <i>b</i>\n&amp;</title><a href=\"a>b\">x<a name=n><a href='c'><a href=d>")
    assert facts == {"title": "A b &", "language": "fr", "links": ["a>b", "c", "d"]}


def test_response_files(spark, tmp_path):
    """Responses with their own headers and dates, written and read again; a page that quotes a record."""
    quoted = "see\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1 end"
    rows = [(None, f"<urn:{i}>", f"http://h/{i}", f"2023-0{i + 1}-02T03:04:05Z", h, p) for i, (h, p) in enumerate([
        ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8", "<p>é</p>"), ("HTTP/1.1 404 Not Found", ""),
        ("HTTP/1.1 200 OK\r\nX: y", quoted), ("HTTP/1.0 200", "\r\n\r\n"), ("HTTP/1.0 200 OK", "last")])]
    found = spark.createDataFrame(rows, warc.RESPONSE).coalesce(1)
    warc.write_warc(warc.response_records(found), str(tmp_path / "w"))
    back = warc.read_responses(spark, str(tmp_path / "w"))
    assert [tuple(r) for r in back.collect()] == rows
    first = warc.derive(found).drop("record").collect()
    assert Counter(first) == Counter(warc.derive(back).drop("record").collect())
    assert {(r.warc_date, r.source_headers) for r in first} == {(d, h) for *_, d, h, _ in rows}
    warc.write_warc(warc.derive(found), str(tmp_path / "m"))
    assert warc.read_responses(spark, str(tmp_path / "m")).count() == 0       # metadata and conversions are passed over
    latin = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 58\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: t; charset=iso-8859-1\r\n\r\n".encode() + b"\xe9"
    latin = latin.replace(b"58", str(len(latin.partition(b"\r\n\r\n")[2])).encode())
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.warc").write_bytes(latin + b"\r\n\r\n")
    assert [r.page for r in warc.read_responses(spark, str(tmp_path / "l")).collect()] == ["é"]
