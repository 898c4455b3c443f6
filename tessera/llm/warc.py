"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response gives a ``metadata`` record (title, language, links, digest of
the source) and a ``conversion`` record (its text), both with
``WARC-Refers-To`` set to the response's record id, the response's target,
date and source headers preserved, and SHA-1 digests of block and payload.
Records are plain rows; :func:`write_warc` writes them as gzip WARC files with
Spark's text writer, whose line separator ends the records.

Nulls and ties: a null page is an empty payload and a null address an empty
target; both still give two records. Repeated rows give repeated records with
equal ids, as ids are digests of the page id and its content. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n\r\n"

_HIDDEN = re.compile(r"<(script|style|head|noscript|template)\b", re.I)
_CLOSER = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "head", "noscript", "template", "title")}
_RAW = ("script", "style")           # unclosed, these hide the rest of the page; others are then plain tags
_BREAK = re.compile(r"<\s*/?\s*(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|nav|header|footer|main|aside|blockquote|pre)\b", re.I)
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_HUGE = re.compile(r"&#(?:[0-9]{20,}|[xX][0-9a-fA-F]{20,});?")
_TITLE = re.compile(r"<title\b", re.I)
_HTML = re.compile(r"<html\b", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_ANCHOR = re.compile(r"<a\b", re.I)
_HREF = re.compile(r"\bhref\s*=\s*", re.I)
_VALUE = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>]+)")


def unescape(text: str) -> str:
    """Character references resolved; numbers of 20 digits or more are U+FFFD."""
    return html.unescape(_HUGE.sub("\ufffd", text))


def visible(page: str):
    """Pieces of a page's text in one pass: what stands between tags, a line end for a block's tag.

    Comments and hidden elements go, up to the end of the page where a comment, a script or a style isn't closed.
    A "<" after which no ">" comes is text. Every closer is looked for once: where there is none, none is sought again.
    """
    at, unclosed = 0, set()
    while True:
        start = page.find("<", at)
        if start < 0:
            yield page[at:]
            return
        yield page[at:start]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            if end < 0:
                return
            yield " "
            at = end + 3
            continue
        hidden = _HIDDEN.match(page, start)
        name = hidden[1].lower() if hidden else None
        if hidden and name not in unclosed:
            closer = _CLOSER[name].search(page, hidden.end())
            if closer:
                yield " "
                at = closer.end()
                continue
            if name in _RAW:
                return
            unclosed.add(name)
        end = page.find(">", start)
        if end < 0:
            yield page[start:]
            return
        if _BREAK.match(page, start, end):
            yield "\n"
        at = end + 1


def plain_text(page: str) -> str:
    """Visible text of a page, a line for each block."""
    text = _BLANK.sub(" ", unescape("".join(visible(page))))
    return _LINES.sub("\n", text).strip(" \n")


def links(page: str) -> list[str]:
    """The targets of a page's anchors; a tag ends at the first ">" or at its quoted target's end."""
    out, at = [], 0
    while anchor := _ANCHOR.search(page, at):
        end = page.find(">", anchor.end())
        if end < 0:
            break
        at = end + 1
        href = _HREF.search(page, anchor.end(), end)
        value = _VALUE.match(page, href.end()) if href else None
        if value:
            out.append(unescape(value[1] or value[2] or value[3] or ""))
            at = max(at, value.end())
    return out


def page_facts(page: str) -> dict:
    """Title, language and links; of several titles or html tags the first counts."""
    title, tag, lang = "", _TITLE.search(page), _HTML.search(page)
    if tag:
        start = page.find(">", tag.end()) + 1
        closer = _CLOSER["title"].search(page, start) if start else None
        title = " ".join(unescape("".join(visible(page[start:closer.start()]))).split()) if closer else ""
    end = page.find(">", lang.end()) if lang else -1
    lang = _LANG.search(page, lang.end(), end) if end >= 0 else None
    return {"title": title, "language": lang[1].lower() if lang else "", "links": links(page)}


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def one_line(value: str) -> str:
    """A header value without line ends."""
    return " ".join(value.split())


def record_header(kind: str, rid: str, uri: str, date: str, content_type: str, block: bytes, digest: str,
                  more: list[tuple[str, str]]) -> str:
    """A record up to its block."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri), *more,
             ("WARC-Block-Digest", digest), ("WARC-Payload-Digest", digest), ("Content-Type", content_type),
             ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {one_line(v)}\r\n" for k, v in lines if v) + "\r\n"


CUT = "\r\n\r\nWARC/1."        # a record may begin here
NAMES = ["page_id", "record_id", "target_uri", "warc_date", "headers", "page"]
RESPONSE = "page_id long, record_id string, target_uri string, warc_date string, headers string, page string"


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html", headers_col: str | None = None) -> DataFrame:
    """Response records of crawled pages. ``headers_col`` names a column of HTTP header lines, if there is one."""
    headers: Column = F.coalesce(F.col(headers_col).cast("string"), F.lit("")) if headers_col else \
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"),
                        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("target_uri"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("page"), headers.alias("headers"))

    def task(batches):
        for batch in batches:
            key, uri, page = (batch.column(c).to_pylist() for c in (1, 2, 3))
            ids = pa.array([derived_id("response", *x) for x in zip(key, uri, page)], pa.string())
            dates = pa.array([date] * batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, batch.column(2), dates, batch.column(4), batch.column(3)], names=NAMES)
    return rows.mapInArrow(task, RESPONSE)


def response_records(found: DataFrame) -> DataFrame:
    """(record): the responses themselves as WARC records, for :func:`write_warc`."""
    def task(batches):
        for batch in batches:
            out = []
            for rid, uri, date, headers, page in zip(*(c.to_pylist() for c in batch.columns)):
                block = f"{headers}\r\n\r\n{page}".encode()
                lines = [("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri),
                         ("WARC-Payload-Digest", sha1(page.encode())), ("Content-Type", "application/http;msgtype=response"),
                         ("Content-Length", str(len(block)))]
                out.append(("WARC/1.1\r\n" + "".join(f"{k}: {one_line(v)}\r\n" for k, v in lines if v) + "\r\n").encode() + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
    return found.select(*NAMES[1:]).mapInArrow(task, "record binary").select(F.col("record").cast("string").alias("record"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files (gzip or plain), with their own dates and HTTP headers; ``page_id`` is null.

    Spark's text reader cuts the files where a record may begin; a block that holds such a place itself is put together
    again by its Content-Length. Headers end at the first empty line; a page is decoded by the charset its headers name,
    else as UTF-8, bytes that don't decode as U+FFFD. Other record types are passed over. A gzip file is one task's; a plain
    file is cut at records, so there a block that quotes a whole record may be taken apart.
    """
    rows = spark.read.option("lineSep", CUT).text(path).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"))

    def whole(batches):
        """Records, put together from the pieces of a file, as (head fields, block)."""
        held, need, at = b"", 0, None
        for batch in batches:
            for piece, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != file:
                    held, need, at = b"", 0, file
                elif need:
                    held += CUT.encode() + piece
                if not need:
                    held = piece
                head, _, block = held.partition(b"\r\n\r\n")
                fields = {k.strip().lower(): v.strip() for k, c, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]) if c}
                need = int(fields.get(b"content-length", b"0") or 0)
                if len(block) >= need:
                    yield fields, block[:need]
                    need = 0

    def task(batches):
        out = []
        for fields, block in whole(batches):
            if fields.get(b"warc-type") != b"response":
                continue
            head, _, body = block.partition(b"\r\n\r\n")
            headers = head.decode("utf-8", "replace")
            charset = re.search(r"(?im)^content-type:.*?charset=[\"']?([\w.-]+)", headers)
            try:
                page = body.decode(charset[1] if charset else "utf-8", "replace")
            except LookupError:
                page = body.decode("utf-8", "replace")
            text = [fields.get(k, b"").decode("utf-8", "replace") for k in (b"warc-record-id", b"warc-target-uri", b"warc-date")]
            out.append((None, *text, headers, page))
            if len(out) >= 256:
                yield rows_batch(out)
                out = []
        if out:
            yield rows_batch(out)

    def rows_batch(out):
        kinds = [pa.int64()] + [pa.string()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=NAMES)
    return rows.mapInArrow(task, RESPONSE)


DERIVED = ("page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, "
           "source_headers string, payload_digest string, block_digest string, content_length long, text string, header string")


def derive(found: DataFrame) -> DataFrame:
    """The metadata and the conversion record of every response."""
    kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in DERIVED.split(", ")]
    names = [c.split()[0] for c in DERIVED.split(", ")]

    def task(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*(r for x in batch.slice(lo, 64).to_pylist() for r in records(**x))), kinds)],
                                                 names=names)
    return found.select(*NAMES).mapInArrow(task, DERIVED).withColumn("record", F.concat("header", "text"))


def records(page_id, record_id: str, target_uri: str, warc_date: str, headers: str, page: str):
    """Rows of DERIVED for one response."""
    source, facts, text = sha1(page.encode()), page_facts(page), plain_text(page)
    lines = json.dumps(headers.split("\r\n"))
    meta = "".join(f"{k}: {one_line(v)}\r\n" for k, v in (
        ("title", facts["title"]), ("languages-html", facts["language"]), ("source-payload-digest", source),
        ("source-http-headers", lines))) + "".join(f"outlink: {one_line(x)}\r\n" for x in facts["links"])
    for kind, block, mime in (("metadata", meta, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
        data = block.encode()
        own, digest = derived_id(kind, record_id), sha1(data)
        more = [("WARC-Refers-To", record_id), ("WARC-Refers-To-Target-URI", target_uri), ("WARC-Refers-To-Date", warc_date),
                ("WARC-Source-Payload-Digest", source), ("WARC-Source-HTTP-Headers", lines)]
        yield (page_id, kind, own, record_id, target_uri, warc_date, headers, source, digest, len(data), block,
               record_header(kind, own, target_uri, warc_date, mime, data, digest, more))


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files under ``path``, one a partition: records end with an empty line pair."""
    records.select("record").write.option("lineSep", END).option("compression", "gzip").text(path)
