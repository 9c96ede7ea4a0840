"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

Records are rows; ``write_warc`` turns them into files. Identifiers of derived records follow from the response's
identifier, so building them twice gives the same records.
"""

from __future__ import annotations

import html as markup
import re
from html.entities import html5, name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Elements whose content is not text, with what ends them, and tags that end a line; a name may begin with a slash.
HIDDEN = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "head", "nav")}
LINE_ENDS = {"br", "/p", "/div", "/li", *(f"/h{i}" for i in range(1, 7)), "/tr", "/ul", "/table", "/article", "/section"}
NAME = re.compile(r"/?[A-Za-z0-9_]+")
BLANKS = str.maketrans("\r\n\t", "   ")
#: Anything that may be a character reference, as the HTML standard cuts it.
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
#: References to white space become a plain space.
SPACES = "\xa0\t\n\f\r"


def _entities() -> list[tuple[str, str]]:
    """Names of HTML 4 with a printable character, and those that stand without a semicolon too; the ampersand last.

    Only for SQL, which replaces one after the other; ``decoded`` knows all names and all numbers.
    """
    full = [(f"&{name};", " " if name == "nbsp" else chr(code)) for name, code in sorted(name2codepoint.items()) if name != "amp"]
    bare = [(f"&{name}", " " if name == "nbsp" else char) for name, char in sorted(html5.items(), key=lambda x: (-len(x[0]), x[0])) if not name.endswith(";") and name != "amp"]
    return [(name, char) for name, char in [*full, ("&#39;", "'"), *bare, ("&amp;", "&"), ("&amp", "&")] if char.isprintable()]


ENTITIES = _entities()


def identifier(*parts: str | Column) -> Column:
    """A ``urn:uuid`` that depends on the parts alone."""
    hexes = F.sha2(F.concat_ws("\n", *parts), 256)
    cut = [F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def responses(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of crawled pages: ``record_id, target_uri, date, http_header, payload``."""
    payload = F.coalesce(html_col, F.lit(""))
    header = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF))
    uri = F.coalesce(url_col, F.lit(""))
    return pages.select(
        F.col(id_col).alias("source_id"),
        identifier(F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), uri, payload).alias("record_id"),
        uri.alias("target_uri"),
        F.lit(date).alias("date"),
        header.alias("http_header"),
        payload.alias("payload"),
    )


def _character(found: re.Match) -> str:
    plain = markup.unescape(found[0])
    return " " + plain[1:] if plain[:1] in SPACES else plain


def visible(html: str) -> str:
    """Text between tags, in one pass from left to right. What is opened and never closed ends with the text; a ``<``
    after the last ``>`` is a character."""
    out, at = [], 0
    while (opened := html.find("<", at)) >= 0:
        out.append(html[at:opened].translate(BLANKS))
        if html.startswith("<!--", opened):
            closed = html.find("-->", opened + 4)
            out.append(" ")
            if closed < 0:
                return "".join(out)
            at = closed + 3
            continue
        closed = html.find(">", opened)
        if closed < 0:
            at = opened
            break
        named = NAME.match(html, opened + 1)
        name = named[0].lower() if named else ""
        if name in HIDDEN:
            out.append(" ")
            if (end := HIDDEN[name].search(html, opened)) is None:
                return "".join(out)
            at = end.end()
        else:
            out.append("\n" if name in LINE_ENDS else " ")
            at = closed + 1
    out.append(html[at:].translate(BLANKS))
    return "".join(out)


def readable(html: str) -> str:
    """Visible text with references decoded once; blank lines and repeated spaces go."""
    text = visible(html)
    if "&" in text:
        text = REFERENCE.sub(_character, text)
    lines = (" ".join(filter(None, line.split(" "))) for line in text.split("\n"))
    return "\n".join(filter(None, lines))


def plain_text(html: Column) -> Column:
    """Visible text: one line per block, words parted by one space, no empty lines, references decoded."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([readable(x) if x else x for x in column.to_pylist()], pa.string())

    return run(html)


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for each response, a ``metadata`` and a ``conversion`` one.

    Columns: ``source_id, type, record_id, refers_to, target_uri, date, content_type, block, block_digest,
    source_digest``. ``refers_to`` is the response's identifier and ``source_digest`` the digest of its payload; the
    metadata block has the response's own headers, its digest and the conversion's identifier. A null payload, header
    or address counts as empty; an empty payload still has both records. Repeated responses give repeated records with
    equal identifiers. An empty table gives an empty result. Only the named columns of a response are read.
    """
    empty = lambda c: F.coalesce(c, F.lit(""))
    base = records.select("source_id", "record_id", empty("target_uri").alias("target_uri"), "date", empty("http_header").alias("http_header"), empty("payload").alias("payload"))
    text = base.withColumn("text", plain_text(F.col("payload"))).withColumn("source_digest", digest(F.col("payload")))
    ids = text.withColumn("conversion_id", identifier(F.lit("conversion"), "record_id")).withColumn("metadata_id", identifier(F.lit("metadata"), "record_id"))
    fields = F.concat(
        F.lit("source-payload-digest: "), F.col("source_digest"), F.lit(f"{CRLF}source-payload-length: "), F.octet_length("payload").cast("string"),
        F.lit(f"{CRLF}conversion-record: "), F.col("conversion_id"), F.lit(f"{CRLF}conversion-digest: "), digest(F.col("text")), F.lit(f"{CRLF}{CRLF}"), F.col("http_header"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("type"), F.col("metadata_id").alias("id"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.col("conversion_id").alias("id"), F.lit("text/plain").alias("content_type"), F.col("text").alias("block")),
    )
    rows = ids.select("source_id", "record_id", "target_uri", "date", "source_digest", F.inline(kinds))
    return rows.select(
        "source_id", "type", F.col("id").alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date", "content_type", "block", digest(F.col("block")).alias("block_digest"), "source_digest"
    )


def record_text() -> Column:
    """One record as it stands in a file, without the last line end."""
    head = [
        ("WARC-Type", "type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
        ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"),
    ]
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(column, F.lit("")), F.lit(CRLF)) for name, column in head]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *lines, F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(CRLF + CRLF), F.col("block"), F.lit(CRLF))


def write_warc(records: DataFrame, path: str) -> None:
    """Write derived records as gzip-compressed WARC files, one per partition; an existing folder is an error."""
    records.select(record_text().alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").text(path)
