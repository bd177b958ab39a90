"""WARC derivatives: metadata and plain-text conversion records from response records.

A *record* is the bytes of one WARC 1.1 record: a version line, named fields, an empty line,
the block, and two line ends. `responses` makes response records of a table of pages.
`derive` reads response records and makes of each, in one pass:

- a *conversion* record: the page's visible text, with the response's id as
  ``WARC-Refers-To``, and digests of its own;
- a *metadata* record: ``application/warc-fields`` with the response's HTTP status and
  headers, digests, link count and title, with the response's id as ``WARC-Refers-To`` and
  the conversion's as ``WARC-Concurrent-To``.

Both keep the target URI, the date and the response's payload digest. Ids are UUIDs made from
the response's id, so runs agree. `write` lays the records of a table out as WARC files.

The text is made of what a browser would show: chunks are joined, gzip and deflate are
undone, and bytes are read in the declared charset (of the header, else of a ``meta`` element or
an XML declaration, else UTF-8). Digests are of the bytes as they came.

Edge cases: a null url or html is empty. A record that is not a response, or is damaged (no
version line, fields that end early, a block shorter than its stated length, broken chunks or
compression), is in an encoding that is not read here, or holds something other than text (by
its type, or without one by its first bytes), is returned with ``error`` and no derivative.
Bytes that are not in the charset become replacement characters in the text. An unknown
charset is read as UTF-8. Rows that repeat, and null ids, are kept.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import map_batches, pick

DATE = "2026-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", re.S | re.I)
_BREAK = re.compile(r"<(?:br|/?(?:p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|"
                    r"footer|title|head|blockquote|pre))\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"<a\b[^>]*\bhref\s*=", re.I)
_BLANK = re.compile(r"[ \t\r\f\v]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def build(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record; its length field is added."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Fields and block of a record; ValueError if it is damaged."""
    head, empty, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not empty or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and fields:  # a folded line belongs to the field before
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("field without a name")
        fields.append((name.strip(), value.strip()))
    length = field(fields, "Content-Length")
    if length is None or not length.isdigit() or len(rest) < int(length):
        raise ValueError("block shorter than its length")
    return fields, rest[: int(length)]


def field(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def visible_text(markup: str) -> str:
    """Text of a page: a line per block element, single spaces, no empty lines."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", markup)))
    if "&" in text:
        text = html.unescape(text)
    lines = (line.strip() for line in _BLANK.sub(" ", text).split("\n"))
    return "\n".join(line for line in lines if line)


def joined_chunks(payload: bytes) -> bytes:
    """A body in chunks as one; ValueError if a chunk is cut off."""
    out, at = [], 0
    while True:
        end = payload.find(b"\r\n", at)
        size = payload[at: max(end, at)].split(b";")[0].strip()
        if end < 0 or not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("broken chunk")
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if len(payload) < end + 2 + n:
            raise ValueError("chunk shorter than its length")
        out.append(payload[end + 2: end + 2 + n])
        at = end + 2 + n + 2


def _inflated(data: bytes, wbits: int) -> bytes:
    """All members of a compressed body."""
    out = []
    while data:
        member = zlib.decompressobj(wbits)
        out.append(member.decompress(data))
        if not member.eof:
            raise ValueError("compressed body ends early")
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def decoded(payload: bytes, headers: list[tuple[str, str]]) -> bytes:
    """The body without its transfer and content encodings."""
    for name in ("Transfer-Encoding", "Content-Encoding"):
        steps = [s.strip().lower() for s in (field(headers, name) or "").split(",") if s.strip()]
        for step in reversed(steps):
            if step == "chunked":
                payload = joined_chunks(payload)
            elif step in ("gzip", "x-gzip", "deflate"):
                try:
                    if step == "deflate" and payload[:1] and payload[0] & 15 != 8:
                        payload = _inflated(payload, -15)  # without the zlib header, as some send it
                    else:
                        payload = _inflated(payload, 47)
                except zlib.error as error:
                    raise ValueError("broken compression") from error
            elif step != "identity":
                raise ValueError(f"encoding {step}")
    return payload


_CHARSET = re.compile(rb"""charset\s*=\s*["']?\s*([\w.:-]+)|^\s*<\?xml[^>]*encoding\s*=\s*["']([\w.:-]+)""", re.I)
_MARKUP = re.compile(r"^(text/html|application/(xhtml\+)?xml|text/xml)$")
_TEXTS = re.compile(r"^(text/.*|application/(.*\+)?(xml|json)|application/(x-)?javascript)$")


def text_of(body: bytes, kind: str) -> tuple[str, bool]:
    """The body as text, and whether it is markup, by its ``Content-Type``; ValueError if it
    is no text."""
    media, _, rest = kind.partition(";")
    media = media.strip().lower()
    if media and not _TEXTS.match(media):
        raise ValueError(f"no text: {media}")
    if not media and (b"\0" in body[:1024] or body[:5] in (b"%PDF-", b"\x89PNG\r") or body[:2] == b"\x1f\x8b"):
        raise ValueError("no text")
    found = _CHARSET.search(rest.encode()) or _CHARSET.search(body[:1024])
    name = next((g.decode() for g in found.groups() if g), "utf-8") if found else "utf-8"
    try:
        codec = codecs.lookup(name).name
    except LookupError:
        codec = "utf-8"
    return body.decode(codec, "replace"), not media or bool(_MARKUP.match(media))


def derivatives(record: bytes) -> dict:
    """The derived records of a response record, and what they hold."""
    fields, block = parse(record)
    if (field(fields, "WARC-Type") or "").lower() != "response":
        raise ValueError("no response")
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *headers = head.decode("iso-8859-1").split("\r\n")
    source = field(fields, "WARC-Record-ID") or ""
    uri, date = field(fields, "WARC-Target-URI") or "", field(fields, "WARC-Date") or ""
    payload_digest = field(fields, "WARC-Payload-Digest") or digest(payload)
    named = [(k.strip(), v.strip()) for k, _, v in (h.partition(":") for h in headers)]
    markup, tagged = text_of(decoded(payload, named), field(named, "Content-Type") or "")
    title = _TITLE.search(markup) if tagged else None
    text = visible_text(markup) if tagged else markup
    body = text.encode()
    conversion_id, metadata_id = urn(f"conversion {source}"), urn(f"metadata {source}")
    shared = [("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Refers-To", source)]
    conversion = build([
        ("WARC-Type", "conversion"), ("WARC-Record-ID", conversion_id), *shared,
        ("WARC-Block-Digest", digest(body)), ("WARC-Source-Payload-Digest", payload_digest),
        ("Content-Type", "text/plain; charset=utf-8")], body)
    lines = [("source-status", status), *(("source-header", h) for h in headers),
             ("source-payload-digest", payload_digest),
             ("source-block-digest", field(fields, "WARC-Block-Digest") or digest(block)),
             ("title", " ".join(html.unescape(title[1]).split()) if title else ""),
             ("links", str(len(_LINK.findall(markup)) if tagged else 0)),
             ("text-length", str(len(text))), ("text-digest", digest(body))]
    notes = "".join(f"{k}: {v}\r\n" for k, v in lines).encode()
    metadata = build([
        ("WARC-Type", "metadata"), ("WARC-Record-ID", metadata_id), *shared,
        ("WARC-Concurrent-To", conversion_id), ("WARC-Block-Digest", digest(notes)),
        ("Content-Type", "application/warc-fields")], notes)
    return {"refers_to": source, "target_uri": uri, "payload_digest": payload_digest,
            "conversion_id": conversion_id, "metadata_id": metadata_id, "text": text,
            "text_digest": digest(body), "conversion": conversion, "metadata": metadata}


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        records = []
        for page_id, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
            payload = (page or "").encode()
            block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                     + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload)
            uri = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url or "")
            records.append(build([
                ("WARC-Type", "response"), ("WARC-Record-ID", urn(f"response {page_id} {uri}")),
                ("WARC-Target-URI", uri), ("WARC-Date", DATE),
                ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)),
                ("Content-Type", "application/http; msgtype=response")], block))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(records, pa.binary())],
                                         ["page_id", "record"])


def responses(pages: DataFrame) -> DataFrame:
    """``page_id, record``: a response record of each row of ``pages (page_id, url, html)``."""
    return map_batches(pick(pages, "page_id", "url", "html"), _responses, "page_id long, record binary")


_KINDS = (("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()),
          ("conversion_id", pa.string()), ("metadata_id", pa.string()), ("text", pa.string()),
          ("text_digest", pa.string()), ("conversion", pa.binary()), ("metadata", pa.binary()))


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, errors = [], []
        for record in batch.column("record").to_pylist():
            try:
                found.append(derivatives(record or b""))
                errors.append(None)
            except ValueError as error:
                found.append({})
                errors.append(str(error))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), *(pa.array([d.get(k) for d in found], t) for k, t in _KINDS),
             pa.array(errors, pa.string())], ["page_id", *(k for k, _ in _KINDS), "error"])


def derive(records: DataFrame) -> DataFrame:
    """Of each row of ``records (page_id, record)``: ``page_id, refers_to, target_uri,
    payload_digest, conversion_id, metadata_id, text, text_digest``, the two records
    ``conversion`` and ``metadata``, and ``error``."""
    columns = ", ".join(f"{k} {'binary' if t == pa.binary() else 'string'}" for k, t in _KINDS)
    return map_batches(pick(records, "page_id", "record"), _derive,
                       f"page_id long, {columns}, error string")


def write(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write ``records (record)`` as WARC files, one for each partition, under ``path``.

    The writer puts a record's closing line ends back that are cut off here; bytes stay as
    they are.
    """
    body = F.expr("substring(record, 1, octet_length(record) - 4)").cast("string")
    (records.filter("record IS NOT NULL").select(body.alias("value")).write
     .option("lineSep", "\r\n\r\n").option("compression", compression).text(path))
