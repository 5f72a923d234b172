"""WARC derivatives: metadata and plain-text conversion records of responses (operator 5).

Each response record gives two records that point to it by WARC-Refers-To and to each other by WARC-Concurrent-To:
``metadata`` (application/warc-fields: title, language, links, the source's HTTP headers and its payload digest) and
``conversion`` (text/plain: the page's text). Record ids derive from the response's id and the record type, so reruns
write the same records. Digests are labelled SHA-256.

Text: comments, scripts, styles, templates and noscript parts go, each up to its own end tag, then the head; tags that
end a line become line ends, other tags nothing; character references are resolved, blanks collapse, empty lines go. A
comment or hidden element without an end hides the rest of the page, a head without one ends where the body begins; an
element within another of its name ends both at the first end tag. All of it is column functions but the character
references, which go through the standard library in Arrow batches. One pass, no shuffle.

Null pages are empty payloads, null addresses leave out the address fields; repeated rows give records each; an empty
table gives an empty result; columns other than those named are carried into neither record. Control characters are
dropped from titles, links, addresses and header lines (line ends between headers become bars), so no page can begin a field
or a record of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.markup import unescaped

VERSION, DATE = "WARC/1.1", "2024-01-31T00:00:00Z"
HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\b[^>]*>|\z)"
_HEAD = r"(?is)<head\b[^>]*>.*?(?:</head\b[^>]*>|(<body\b)|\z)"
#: A link's target in double, single or no quotes.
_HREF = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*"
_TARGET = r"""(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
_LINE = r"(?i)</?(address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>"
_TAG = r"<[!/a-zA-Z][^>]*>"


def plain_text(page: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.coalesce(page, F.lit("")), _HIDDEN, ""), _HEAD, "$1")
    text = F.regexp_replace(F.regexp_replace(text, _LINE, "\n"), _TAG, "")
    text = F.regexp_replace(unescaped(text), r"[ \t\r\f]{2,}|[\t\r\f]", " ")  # a lone blank needs no change
    return F.btrim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def one_line(text: Column) -> Column:
    """Text without the control characters that could end its line or begin another field."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", "")


def _uuid(of: Column) -> Column:
    h = F.md5(of)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _digest(of: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(of, 256))


def responses(
    pages: DataFrame, date: str = DATE, headers: str = HEADERS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Response records of fetched pages: source_id, record_id, target_uri, warc_date, http_headers, payload, payload_digest."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    name = F.concat_ws(
        "|", F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(url_col, F.lit("")), F.sha2(payload, 256)
    )
    return pages.select(
        F.col(id_col).alias("source_id"), _uuid(name).alias("record_id"), F.col(url_col).alias("target_uri"),
        F.lit(date).alias("warc_date"), F.lit(headers).alias("http_headers"), payload.alias("payload"),
        _digest(payload).alias("payload_digest")
    )


def derivatives(found: DataFrame) -> DataFrame:
    """Two records per response: source_id, warc_type, record_id, refers_to, concurrent_to, target_uri, warc_date,
    content_type, source_headers, source_digest, block, block_digest, content_length."""
    metadata, conversion = (_uuid(F.concat_ws("|", F.lit(t), "record_id")) for t in ("metadata", "conversion"))
    page = F.col("payload")
    title = one_line(F.trim(F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title\s*>", 1), r"\s+", " ")))
    lang = F.regexp_extract(page, r"(?is)<html[^>]*\blang=[\"']?([a-zA-Z-]+)", 1)
    links = F.transform(
        F.regexp_extract_all(page, F.lit(f"{_HREF}({_TARGET})"), F.lit(1)), lambda x: one_line(F.regexp_replace(x, "^[\"']|[\"']$", ""))
    )
    fields = F.concat(
        F.lit("title: "), title, F.lit("\r\nlanguage: "), lang, F.lit("\r\nsource-payload-digest: "), "payload_digest",
        F.lit("\r\nsource-headers: "), one_line(F.regexp_replace(F.btrim("http_headers", F.lit("\r\n")), r"[\r\n]+", " | ")),
        F.array_join(F.transform(links, lambda x: F.concat(F.lit("\r\noutlink: "), x)), ""),
    )
    made = found.select("*", plain_text(page).alias("_text"), fields.alias("_fields"))
    kinds = F.array(F.lit("metadata"), F.lit("conversion"))  # a constant, so that nothing above it is worked out again for it
    both = made.select("*", F.explode(kinds).alias("warc_type"))
    meta = F.col("warc_type") == "metadata"
    rows = both.select(
        "source_id", "warc_type", F.when(meta, metadata).otherwise(conversion).alias("new_id"), F.col("record_id").alias("refers_to"), F.when(meta, conversion).otherwise(metadata).alias("concurrent_to"),
        one_line(F.col("target_uri")).alias("target_uri"), "warc_date", F.when(meta, "application/warc-fields").otherwise("text/plain; charset=utf-8").alias("content_type"), F.col("http_headers").alias("source_headers"), F.col("payload_digest").alias("source_digest"),
        F.when(meta, F.col("_fields")).otherwise(F.col("_text")).alias("block"),
    )
    return rows.select(
        "source_id", "warc_type", F.col("new_id").alias("record_id"), "refers_to", "concurrent_to", "target_uri", "warc_date",
        "content_type", "source_headers", "source_digest", "block", _digest(F.col("block")).alias("block_digest"),
        F.octet_length("block").cast("long").alias("content_length")
    )


def write_warc(records: DataFrame, path: str, compression: str | None = "gzip") -> None:
    """WARC files through Spark's text writer: a record's header, an empty line, its block, and two line ends between records."""
    header = [
        ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"),
        ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"),
        ("Content-Type", "content_type"), ("WARC-Source-Payload-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"),
        ("Content-Length", "content_length")
    ]
    lines = F.concat_ws("\r\n", F.lit(VERSION), *[F.concat(F.lit(f"{k}: "), F.col(c).cast("string")) for k, c in header])
    out = records.select(F.concat(lines, F.lit("\r\n\r\n"), "block").alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", compression or "none").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """fields (a map of header fields, the first of repeated ones), block, complete (the block has its Content-Length) of every record.

    Files are cut where a record may begin, and the pieces of a file joined again, in order, until a block has its
    Content-Length, so a block may hold what looks like a record. Files are to be compressed, as ``write_warc`` leaves them,
    or no larger than a split: then a file's pieces are one task's. A record stands alone in memory, never a file.
    """
    cut = f"\r\n\r\n{VERSION}\r\n"

    def record(text: str) -> tuple[dict[str, str], str, int]:
        head, _, block = text.removeprefix(f"{VERSION}\r\n").partition("\r\n\r\n")
        fields: dict[str, str] = {}
        for line in head.split("\r\n"):
            name, _, value = line.partition(":")
            fields.setdefault(name, value.strip(" "))
        length = fields.get("Content-Length", "")
        return fields, block, int(length) if length.isdecimal() else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("fields", pa.map_(pa.string(), pa.string())), ("block", pa.string()), ("complete", pa.bool_())])
        file, parsed = None, None

        def done() -> pa.RecordBatch:
            fields, block, length = parsed
            if len(block.encode()) > length >= 0:  # the two line ends that close a file's last record
                block = block.removesuffix("\r\n\r\n")
            return pa.RecordBatch.from_pylist(
                [{"fields": list(fields.items()), "block": block, "complete": len(block.encode()) == length}], schema=schema
            )

        for batch in batches:
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if parsed and name == file and len(parsed[1].encode()) < parsed[2]:
                    parsed = parsed[0], parsed[1] + cut + piece, parsed[2]
                    continue
                if parsed:
                    yield done()
                file, parsed = name, record(piece)
        if parsed:
            yield done()

    rows = spark.read.option("lineSep", cut).text(path)
    rows = rows.select(rows.metadataColumn("_metadata")["file_path"].alias("file"), "value")
    return rows.mapInArrow(run, "fields map<string,string>, block string, complete boolean")


ORACLE_SQL = r"""
WITH s AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
i AS (SELECT *, 'sha256:' || sha256(payload) AS payload_digest, md5('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|' || sha256(payload)) AS h
  FROM s),
r AS (SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS record_id FROM i),
u AS (SELECT *, md5('metadata|' || record_id) AS m, md5('conversion|' || record_id) AS c FROM r),
n AS (SELECT *, '<urn:uuid:' || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || '>' AS mid,
  '<urn:uuid:' || c[1:8] || '-' || c[9:12] || '-' || c[13:16] || '-' || c[17:20] || '-' || c[21:32] || '>' AS cid FROM u),
x AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(payload, '(?is)<!--.*?(-->|\z)|<script\b[^>]*>.*?(</script\b[^>]*>|\z)|<style\b[^>]*>.*?(</style\b[^>]*>|\z)|<template\b[^>]*>.*?(</template\b[^>]*>|\z)|<noscript\b[^>]*>.*?(</noscript\b[^>]*>|\z)', '', 'g'),
  '(?is)<head\b[^>]*>.*?(</head\b[^>]*>|(<body\b)|\z)', '\2', 'g'),
  '(?i)</?(address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>', chr(10), 'g'), '<[!/a-zA-Z][^>]*>', '', 'g') AS t0
  FROM n),
y AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(t0, '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t1
  FROM x),
z AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t1, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS body,
  'title: ' || regexp_replace(trim(regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title\s*>', 1), '\s+', ' ', 'g')), '[\x00-\x1F\x7F]', '', 'g') || chr(13) || chr(10) ||
  'language: ' || regexp_extract(payload, '(?is)<html[^>]*\blang=["'']?([a-zA-Z-]+)', 1) || chr(13) || chr(10) ||
  'source-payload-digest: ' || payload_digest || chr(13) || chr(10) ||
  'source-headers: HTTP/1.1 200 OK | Content-Type: text/html; charset=utf-8' ||
  coalesce(array_to_string(list_transform(regexp_extract_all(payload, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), lambda v: chr(13) || chr(10) || 'outlink: ' || regexp_replace(regexp_replace(v, '^["'']|["'']$', '', 'g'), '[\x00-\x1F\x7F]', '', 'g')), ''), '') AS fields
  FROM y),
b AS (SELECT page_id AS source_id, 'metadata' AS warc_type, mid AS record_id, record_id AS refers_to, cid AS concurrent_to, regexp_replace(url, '[\x00-\x1F\x7F]', '', 'g') AS target_uri, 'application/warc-fields' AS content_type, payload_digest AS source_digest, fields AS block
  FROM z
  UNION ALL SELECT page_id, 'conversion', cid, record_id, mid, regexp_replace(url, '[\x00-\x1F\x7F]', '', 'g'), 'text/plain; charset=utf-8', payload_digest, body FROM z)
SELECT source_id, warc_type, record_id, refers_to, concurrent_to, target_uri, '2024-01-31T00:00:00Z' AS warc_date, content_type,
  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' AS source_headers, source_digest, block,
  'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length
FROM b
"""
