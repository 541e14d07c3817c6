"""WARC derivatives: linked metadata and plain-text conversion records for response records, and a source and sink for WARC files.

A record is a row (record_id, record_type, refers_to, target_uri, date, content_type, payload_digest, block_digest, block):
the fields that WARC/1.1 names, null where a record has none, and the block as text. Digests are ``sha256:`` and hex.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .shared import arrow_map

FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "refers_to": "WARC-Refers-To",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "block_digest": "WARC-Block-Digest",
}
END = "\r\n\r\n"

# The HTML elements that end a line of text.
BREAKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"

_mark_up = re.compile(rf"(?P<out><!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>)|(?P<end></?(?:{BREAKS})\b[^>]*>)|<[a-zA-Z/!?][^>]*>", re.I | re.S).sub
_space = re.compile(r"[ \t\r\f\xa0]+").sub
_lines = re.compile(r" ?\n[ \n]*").sub
_title = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S).search


def _sha(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(c, "UTF-8"), 256))


def _uuid(*parts: Column) -> Column:
    """A record id that is a function of what it names."""
    h = F.md5(F.encode(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), "UTF-8"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def responses(pages: DataFrame, *, url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages, with the page's other columns; a null url or page counts as empty."""
    body, uri = F.coalesce(F.col(html), F.lit("")), F.coalesce(F.col(url), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END))
    rows = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in (url, html, *FIELDS, "block")], uri.alias("target_uri"), F.concat(head, body).alias("block"), _sha(body).alias("payload_digest"))
    return rows.withColumns(
        {"record_type": F.lit("response"), "record_id": _uuid(F.lit("response"), F.col("target_uri"), F.col("payload_digest")), "refers_to": F.lit(None).cast("string"), "date": F.lit(date), "content_type": F.lit("application/http; msgtype=response"), "block_digest": _sha(F.col("block"))}
    )


def _instead(found: re.Match) -> str:
    return " " if found["out"] else "\n" if found["end"] else ""


def plain_text(html: str) -> str:
    """Text of a page: no comments, scripts, styles or tags; all character references decoded; a line for each block; white space collapsed."""
    text = _mark_up(_instead, html)
    if "&" in text:
        text = entities.unescape(text)
    return _lines("\n", _space(" ", text)).strip(" \n")


def title_of(html: str) -> str:
    found = _title(html)
    return " ".join(plain_text(found[1]).split()) if found else ""


@F.pandas_udf(StructType().add("text", StringType()).add("title", StringType()))
def _read(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"text": html.map(plain_text), "title": html.map(title_of)})


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record, with the responses' other columns, whatever their names.

    Both refer to the response's record id and keep its target and date. The metadata's fields are the status and header
    lines of the source, each as ``http-`` and its name, the source's digests, the title, and the lengths of payload and
    text; the conversion's block is the plain text of the whole payload, however long. A block without an HTTP head is all
    payload. Records of other types, and null blocks, give none; repeated records give repeated derivatives with equal ids;
    an empty table an empty one.
    """
    other = [c for c in records.columns if c not in (*FIELDS, "block")]
    rows = records.filter("record_type = 'response' and block is not null")
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in other] or [F.lit(0).alias("none")]).alias("other"), "record_id", "target_uri", "date", "payload_digest", "block_digest", "block")
    rows = rows.withColumn("cut", F.when(F.col("block").startswith("HTTP/"), F.instr("block", END)).otherwise(0))
    rows = rows.withColumns({"head": F.when(F.col("cut") > 0, F.expr("left(block, cut - 1)")).otherwise(""), "body": F.when(F.col("cut") > 0, F.expr("substring(block, cut + 4)")).otherwise(F.col("block"))})
    rows = rows.withColumn("read", _read("body"))
    lines = F.transform(F.filter(F.slice(F.split("head", "\r\n"), 2, 1 << 20), lambda x: x.contains(":")), lambda x: F.concat(F.lit("http-"), F.lower(F.substring_index(x, ":", 1)), F.lit(":"), F.regexp_replace(x, "^[^:]*:", "")))
    fields = F.concat(
        F.array(F.concat(F.lit("http-status: "), F.regexp_extract("head", r"^HTTP/\S+ (\d+)", 1))),
        lines,
        F.array(
            F.concat(F.lit("source-payload-digest: "), F.coalesce("payload_digest", F.lit(""))),
            F.concat(F.lit("source-block-digest: "), F.coalesce("block_digest", F.lit(""))),
            F.concat(F.lit("title: "), F.col("read.title")),
            F.concat(F.lit("payload-length: "), F.octet_length("body").cast("string")),
            F.concat(F.lit("text-length: "), F.octet_length("read.text").cast("string")),
        ),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), F.concat(F.array_join(fields, "\r\n"), F.lit("\r\n")).alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), F.col("read.text").alias("block")),
    )
    rows = rows.select("other", F.col("record_id").alias("refers_to"), "target_uri", "date", F.inline(made))
    rows = rows.withColumns({"record_id": _uuid(F.col("record_type"), F.col("refers_to")), "payload_digest": F.lit(None).cast("string"), "block_digest": _sha(F.col("block"))})
    return rows.select(*[F.col(f"other.`{c}`") for c in other], *[c for c in rows.columns if c != "other"])


def write(records: DataFrame, path: str, *, compression: str = "gzip") -> None:
    """Write records as WARC/1.1 files, null fields left out. Blocks are text, so binary payloads can't be written.

    A gzip file is one member, which any reader takes, though none can seek in it.
    """
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(c, r"[\r\n]+", " "), F.lit("\r\n"))).otherwise("") for c, name in FIELDS.items()]
    block = F.coalesce("block", F.lit(""))
    whole = F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)
    records.select(whole.alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


_version = re.compile(rb"WARC/\d\.\d\r?\n")
_field = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)[ \t]*\r?$", re.M).findall


def _inflated(content: bytes) -> bytes:
    """A file's bytes, from gzip members where it has them."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out) if out else content


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields, by name in lower case, and block of each record; blocks are cut by their Content-Length, whatever they hold."""
    at = 0
    while found := _version.search(content, at):
        end = re.compile(rb"\r?\n\r?\n").search(content, found.end() - 2)
        if not end:
            return
        fields = {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace") for k, v in _field(content[found.end() : end.start()])}
        size = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else 0
        yield fields, content[end.end() : end.end() + size]
        at = end.end() + size


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip of one or many members, by their Content-Length: the fields, the length, the block and its bytes.

    ``block`` is the bytes as UTF-8, invalid ones replaced. Missing fields are null, a record without a length has an empty
    block. A file is read by one task as a whole, so it must be under 2 GB.
    """
    names = [*FIELDS, "content_length", "block", "content"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for content in b.column(0).to_pylist():
                found = [([fields.get(name.lower()) for name in FIELDS.values()], block) for fields, block in _records(_inflated(content))]
                for i in range(0, len(found), 500):
                    out = [(*fields, len(block), block.decode("utf-8", "replace"), block) for fields, block in found[i : i + 500]]
                    yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("content")
    return arrow_map(files, rows, ", ".join(f"{c} string" for c in FIELDS) + ", content_length long, block string, content binary")
