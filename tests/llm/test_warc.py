import base64
import gzip
import hashlib
import time
import zlib
from html.parser import HTMLParser

import pytest
import zstandard
from pyspark.sql import functions as F

from txnguard.llm import warc
from txnguard.llm.catalog import catalog

PAGES = "page_id long, url string, html string"


class Words(HTMLParser):
    """The visible words and the links, by the library's parser."""

    def __init__(self):
        super().__init__()
        self.words, self.links, self.hidden = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "template", "noscript")
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "template", "noscript") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.words += [data]


def test_query_against_the_pages(spark, sf_dir):
    got = [r.asDict() for r in catalog()["op8_warc_derivatives"][0](spark, sf_dir).collect()]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == 2 * len(pages)
    by_page = {(r["page_id"], r["record_type"]): r for r in got}
    assert len({r["record_id"] for r in got}) == len(got)
    for p in pages:
        meta, text = by_page[p.page_id, "metadata"], by_page[p.page_id, "conversion"]
        source = warc.response_of(p.page_id, p.url, p.html)
        assert meta["refers_to"] == text["refers_to"] == source["record_id"] and meta["target_uri"] == p.url
        payload = "sha1:" + base64.b32encode(hashlib.sha1(p.html.encode()).digest()).decode()
        assert f"source-payload-digest: {payload}\r\n" in meta["block"]
        assert "source-status: HTTP/1.1 200 OK\r\n" in meta["block"] and "source-header: Content-Type: text/html; charset=utf-8\r\n" in meta["block"]
        for r in (meta, text):
            data = r["block"].encode()
            assert r["content_length"] == len(data) and r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
        seen = Words()
        seen.feed(p.html)
        assert "".join(text["block"].split()) == "".join("".join(seen.words).split())
        assert meta["block"].count("outlink: ") == len({warc.urljoin(p.url, x) for x in seen.links})


def test_round_trip(spark, sf_dir):
    records = warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    every = records.unionByName(warc.derive(records))
    rows = {r.record_id: r.asDict() for r in every.collect()}
    data = b"".join(bytes(r.record) for r in warc.serialized(every).collect())
    back = list(warc.parse(data))
    assert len(back) == len(rows)
    for r in back:
        assert {**r, "page_id": None} == {**rows[r["record_id"]], "page_id": None, "block": bytes(rows[r["record_id"]]["block"])}


def test_text_of_broken_pages():
    assert warc.plain_text("<p>a<b>b</b> &amp; c<p>d<!-- x <p>") == "a b & c\nd"
    assert warc.plain_text("x<script>var t='</p>';</script>y<style>p{}") == "x y"
    assert warc.plain_text("1 < 2 and 3 > 2 <br>next") == "1 < 2 and 3 > 2\nnext"
    assert warc.outlinks("<a href='/x'>1</a><a class=q href=y>2</a><a HREF=\"//h/z\">3</a><a href='/x'>4</a><!--<a href=no>-->", "http://s/d/e") == ["http://s/x", "http://s/d/y", "http://h/z"]


def test_long_pages_take_little_time():
    start = time.perf_counter()
    for page in ("<a" * 100_000, "<a href='" * 40_000, "<!--" * 100_000, "<script>" * 50_000, "<" * 300_000, "&" * 300_000, "\n " * 200_000):
        warc.derivatives_of(warc.response_of(1, "http://x/", page))
    assert time.perf_counter() - start < 20


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "http://a/", ""), (2, "http://b/\r\nX: y", "<p>é</p>"), (2, "http://b/\r\nX: y", "<p>é</p>")]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(1) for c in ("block", "record_id", "refers_to")})
    got = warc.derive(warc.responses(df).withColumn("extra", F.lit(1))).collect()
    assert [(r.page_id, r.record_type) for r in got] == [(i, k) for i, _, _ in rows for k in ("metadata", "conversion")]
    assert bytes(got[1].block) == b"" and got[5].block.decode() == "é" and got[4].target_uri == "http://b/ X: y"
    assert got[4].record_id == got[6].record_id
    other = warc.responses(df).withColumn("record_type", F.lit("request"))
    assert warc.derive(other).count() == 0
    assert warc.derive(warc.responses(spark.createDataFrame([], PAGES))).count() == 0


def test_response_without_head():
    source = warc.response_of(1, "http://x/", "") | {"block": b"no head at all", "payload_digest": None}
    meta, text = warc.derivatives_of(source)
    assert text["block"] == b"no head at all" and b"source-status" not in meta["block"]


PAGE = "<html><head><title>Größe</title></head><body><p>Ein Café kostet 5 €.</p></body></html>"


def chunked(body, size=7):
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    return b"".join(f"{len(p):x};name=1\r\n".encode() + p + b"\r\n" for p in parts) + b"0\r\n\r\n"


def two_members(data):
    return gzip.compress(data[:20]) + gzip.compress(data[20:])


@pytest.mark.parametrize(
    ("headers", "body"),
    [
        ("Content-Type: text/html; charset=windows-1252", PAGE.encode("cp1252")),
        ("Content-Type: text/html; charset=ISO-8859-1", PAGE.encode("cp1252")),
        ('content-type: text/html; Charset="utf-16-le"', PAGE.encode("utf-16-le")),
        ("Content-Type: text/html", b"\xff\xfe" + PAGE.encode("utf-16-le")),
        ("Content-Type: text/html", PAGE.replace("<head>", "<head><meta charset='cp1252'>").encode("cp1252")),
        ("Content-Type: text/html; charset=no-such-one", PAGE.encode()),
        ("Content-Encoding: gzip", gzip.compress(PAGE.encode())),
        ("Content-Encoding: x-gzip", two_members(PAGE.encode())),
        ("Content-Encoding: deflate", zlib.compress(PAGE.encode())),
        ("Content-Encoding: deflate", zlib.compress(PAGE.encode())[2:-4]),
        ("Content-Encoding: zstd", zstandard.compress(PAGE.encode())),
        ("Content-Encoding: deflate, gzip", gzip.compress(zlib.compress(PAGE.encode()))),
        ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunked(gzip.compress(PAGE.encode()))),
        ("Transfer-Encoding: chunked", chunked(PAGE.encode())),
        ("Content-Encoding: identity", PAGE.encode()),
    ],
)
def test_bodies_by_their_encoding_and_charset(headers, body):
    block = f"HTTP/1.1 200 OK\r\n{headers}\r\n\r\n".encode() + body
    source = dict.fromkeys(warc.FIELDS) | {"record_type": "response", "record_id": "<urn:uuid:x>", "block": block}
    metadata, text = warc.derivatives_of(source)
    assert text["block"].decode() == "Größe\nEin Café kostet 5 €."
    assert "title: Größe\r\n" in metadata["block"].decode() and f"source-content-length: {len(body)}" in metadata["block"].decode()


def test_unknown_and_broken_encodings():
    def run(headers, body):
        block = f"HTTP/1.1 200 OK\r\n{headers}\r\n\r\n".encode() + body
        metadata, text = warc.derivatives_of(dict.fromkeys(warc.FIELDS) | {"record_id": "r", "block": block})
        return metadata["block"].decode(), text["block"].decode()

    metadata, text = run("Content-Encoding: br", b"\x0b\x02")
    assert text == "" and "source-undecoded: br\r\n" in metadata
    assert run("Content-Encoding: gzip", b"no gzip at all") [1] == ""
    assert run("Content-Encoding: gzip", gzip.compress(b"<p>" + b"word " * 500)[:60])[1].startswith("word")
    assert run("Transfer-Encoding: chunked", b"<p>plain")[1] == "plain"
