"""WARC derivatives: a metadata record and a plain-text conversion record for each response."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnguard.llm.columns import only, with_columns_of

#: The capture time of pages that come without one.
CAPTURED = "2000-01-01T00:00:00Z"
PAGE_HEADERS = (("Server", "unknown"), ("Content-Type", "text/html; charset=utf-8"))
RECORD = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, record_date string, content_type string, "
    "content_length long, block_digest string, payload_digest string, block binary"
)
FIELDS = [f.split(" ")[0] for f in RECORD.split(", ")]
#: WARC header fields of a record's columns, in the order of writing.
HEADERS = [
    ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
    ("WARC-Date", "record_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"),
    ("Content-Type", "content_type"), ("Content-Length", "content_length"),
]
SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
BREAKS = re.compile(r"</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|title|body|blockquote|pre|hr)\b[^<>]*>", re.I)
TAG = re.compile(r"<[/!?a-zA-Z][^<>]*>")
BLANKS = re.compile(r"[^\S\n]+")
LINES = re.compile(r" ?\n[ \n]*")
TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
LANGUAGE = re.compile(r"<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
LINK = re.compile(r"<a\s[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

#: Content encodings that are undone; the names of Latin-1; byte order marks; and how far into a page it may name its charset.
ENCODINGS = ("gzip", "x-gzip", "deflate", "zstd")
LATIN = ("iso-8859-1", "latin-1", "latin1", "us-ascii", "ascii")
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
DECLARED_WITHIN = 1024
CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_:.-]+)", re.I)
SIZE = re.compile(rb"[0-9A-Fa-f]+(?=\s*(?:;|$))")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """An identifier that follows from what the record is made of, so that a repeated run gives the same ones."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16], version=5)}>"


def plain_text(page: str) -> str:
    """The page's visible text, one line for each block of it."""
    text = TAG.sub(" ", BREAKS.sub("\n", SKIPPED.sub(" ", page)))
    return LINES.sub("\n", BLANKS.sub(" ", html.unescape(text))).strip()


def one_line(text: str) -> str:
    return " ".join(text.split())


def outlinks(page: str, base: str | None) -> list[str]:
    """Targets of the page's links in their order, each once, as absolute addresses where they can be made so."""
    out: dict[str, None] = {}
    for m in LINK.finditer(SKIPPED.sub(" ", page)):
        target = one_line(html.unescape(m[1] or m[2] or m[3] or ""))
        try:
            out[urljoin(base or "", target)] = None
        except ValueError:
            out[target] = None
    return list(out)


def split_response(block: bytes) -> tuple[list[str], bytes]:
    """Status and header lines of an HTTP response, and its payload."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    return (head.decode("utf-8", "replace").split("\r\n"), payload) if mark else ([], block)


def unchunked(body: bytes) -> bytes:
    """A body without its transfer chunks; from the first thing that is no chunk on, as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = SIZE.match(body[at:end]) if end >= 0 else None
        if not size:
            return b"".join(out) + body[at:]
        n, at = int(size[0], 16), end + 2
        if not n:
            return b"".join(out)
        out.append(body[at : at + n])
        at += n + 2


def inflated(body: bytes, kind: str) -> bytes:
    """A compressed body's bytes, as many as can be read; an empty one of a kind that is not known."""
    out = []
    try:
        if kind == "zstd":
            with zstandard.ZstdDecompressor().stream_reader(body, read_across_frames=True) as whole:
                return whole.read()
        for width in (47, -15) if kind == "deflate" else (47,):  # with a header, or, as some servers send it, without
            rest = body
            while rest:
                one = zlib.decompressobj(width)
                try:
                    out.append(one.decompress(rest) + one.flush())
                except zlib.error:
                    break
                rest = one.unused_data
            if out:
                break
    except zstandard.ZstdError:
        pass
    return b"".join(out)


def page_of(lines: list[str], payload: bytes) -> tuple[str, list[str]]:
    """The page of a response, by its transfer and content encodings and its charset, and the encodings that are not known.

    The charset is that of a byte order mark, else of the Content-Type header, else of the page's own declaration, else
    UTF-8; one that is not known counts as UTF-8, and Latin-1 as its superset cp1252, as browsers do. Bytes that the
    charset does not have become replacement characters."""
    header = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    body, unknown = payload, []
    if "chunked" in header.get("transfer-encoding", "").lower():
        body = unchunked(body)
    for kind in reversed([k.strip().lower() for k in header.get("content-encoding", "").split(",") if k.strip()]):
        if kind in ENCODINGS:
            body = inflated(body, kind)
        elif kind != "identity":
            unknown.append(kind)
    if unknown:
        return "", unknown
    for mark, name in MARKS:
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace"), []
    found = CHARSET.search(header.get("content-type", "")) or CHARSET.search(body[:DECLARED_WITHIN].decode("latin-1"))
    name = found[1].lower() if found else "utf-8"
    try:
        return body.decode("cp1252" if name in LATIN else name, "replace"), []
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace"), []


def record(source: dict, kind: str, content_type: str, block: bytes) -> dict:
    return {
        "page_id": source["page_id"], "record_type": kind, "record_id": record_id(kind, source["record_id"]), "refers_to": source["record_id"],
        "target_uri": source["target_uri"], "record_date": source["record_date"], "content_type": content_type, "content_length": len(block),
        "block_digest": digest(block), "payload_digest": None, "block": block,
    }


def response_of(page_id: int | None, url: str | None, page: str | None) -> dict:
    payload = (page or "").encode()
    lines = ["HTTP/1.1 200 OK", *(f"{k}: {v}" for k, v in PAGE_HEADERS), f"Content-Length: {len(payload)}"]
    block = "\r\n".join(lines).encode() + b"\r\n\r\n" + payload
    return {
        "page_id": page_id, "record_type": "response", "record_id": record_id("response", page_id, url, digest(payload)), "refers_to": None,
        "target_uri": None if url is None else one_line(url), "record_date": CAPTURED, "content_type": "application/http; msgtype=response",
        "content_length": len(block), "block_digest": digest(block), "payload_digest": digest(payload), "block": block,
    }


def derivatives_of(source: dict) -> list[dict]:
    """The metadata record and the conversion record of a response. The metadata keep the source's HTTP status and headers,
    its digests and length, and list the page's title, language and links."""
    lines, payload = split_response(source["block"] or b"")
    page, unknown = page_of(lines, payload)
    fields = [("source-payload-digest", source["payload_digest"] or digest(payload)), ("source-block-digest", source["block_digest"]), ("source-content-length", len(payload))]
    fields += [("source-status", lines[0])] if lines else []
    fields += [("source-header", one_line(line)) for line in lines[1:]] + [("source-undecoded", kind) for kind in unknown]
    fields += [("title", one_line(html.unescape(m[1]))) for m in [TITLE.search(page)] if m] + [("lang", m[1]) for m in [LANGUAGE.search(page)] if m]
    fields += [("outlink", link) for link in outlinks(page, source["target_uri"])]
    metadata = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode("utf-8", "replace")
    text = plain_text(page).encode("utf-8", "replace")
    return [record(source, "metadata", "application/warc-fields", metadata), record(source, "conversion", "text/plain; charset=utf-8", text)]


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "content_length": pa.int64(), "block": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], kinds.get(f, pa.string())) for f in FIELDS], FIELDS)


def responses(pages: DataFrame) -> DataFrame:
    """Response records of a table of pages (page_id, url, html). A null page has an empty payload, a null url no target."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html")]
        yield batch_of([response_of(*row) for row in zip(*columns, strict=True)])

    return with_columns_of(RECORD, of, only(pages, "page_id", "url", "html"))


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response among ``records``; records of other types give none.

    Each refers to its response by ``refers_to`` and has its target and date; its own id follows from the response's, so
    repeated rows and repeated runs give equal records. Bodies are read by the response's own encodings and charset; of an
    encoding that is not known the text is empty and the metadata say so. A null or empty block gives records with empty
    text. Pages are read whole, whatever their length. Other columns are not read. An empty table gives no records.
    """

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch_of([d for r in batch.to_pylist() for d in derivatives_of(r)])

    return with_columns_of(RECORD, of, only(records, *FIELDS).filter(F.col("record_type") == "response"))


def serialize(row: dict) -> bytes:
    """A record in the WARC format, version 1.1."""
    lines = ["WARC/1.1", *(f"{name}: {row[c]}" for name, c in HEADERS if row[c] is not None)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + row["block"] + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file's bytes, by the lengths that they state."""
    at, columns = 0, dict(HEADERS)
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        row: dict = dict.fromkeys(FIELDS)
        for line in data[at:head_end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(": ")
            row[columns[name]] = value
        row["content_length"] = int(row["content_length"])
        start = head_end + 4
        row["block"] = data[start : start + row["content_length"]]
        yield row
        at = start + row["content_length"] + 4


def serialized(records: DataFrame) -> DataFrame:
    """``page_id``, ``record_id`` and the bytes ``record`` of each record; joined, they are a WARC file."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = pa.array([serialize(r) for r in batch.to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("record_id"), made], ["page_id", "record_id", "record"])

    return with_columns_of("page_id long, record_id string, record binary", of, only(records, *FIELDS))
