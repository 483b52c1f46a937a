"""WARC derivatives: response records -> linked metadata and plain-text conversion records.

Input, one row per response record: ``record_id``, ``target_uri``, ``date``,
``http_status`` (status line), ``http_headers`` (array of (name, value)),
``payload`` (binary) and ``payload_digest`` as the source wrote it.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("record_id", "target_uri", "date", "http_status", "http_headers", "payload", "payload_digest")
SCHEMA = (
    "refers_to string, warc_type string, record_id string, target_uri string, warc_date string, content_type string, "
    "content_length long, block_digest string, header string, block string"
)
_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|blockquote|pre|title|body|head|html|main|aside|form|dd|dt|dl|hr)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_ANCHOR = re.compile(r"<a\b([^>]*)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*", re.I)
_VALUE = re.compile(r"""(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_BLANKS = re.compile(r"[^\S\n]{2,}|[^\S\n ]")


def digest_of(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def fits(said: str, block: bytes) -> bool:
    """Whether a digest, SHA-1 in base 32 or hexadecimal or SHA-256 in hexadecimal, is that of a block."""
    name, _, value = said.lower().partition(":")
    if name == "sha256":
        return value == hashlib.sha256(block).hexdigest()
    raw = hashlib.sha1(block).digest()
    return name == "sha1" and value in (raw.hex(), base64.b32encode(raw).decode().lower())


def decode(payload: bytes, content_type: str) -> tuple[str, str]:
    """(text, charset): the declared charset, else the one in the first kilobyte, else UTF-8; bad bytes become U+FFFD."""
    named = _CHARSET.search(content_type) or _CHARSET.search(payload[:1024].decode("latin-1"))
    charset = named.group(1) if named else "utf-8"
    try:
        return payload.decode(charset, "replace"), charset.lower()
    except LookupError:
        return payload.decode("utf-8", "replace"), "utf-8"


def split_title(markup: str) -> tuple[str | None, str]:
    """The first title (None without one) and the markup without any; a title that is never closed is none.  One pass."""
    title, rest, at = None, [], 0
    while (start := _TITLE.search(markup, at)) and (end := _TITLE_END.search(markup, start.end())):
        if title is None:
            title = markup[start.end():end.start()]
        rest.append(markup[at:start.start()])
        at = end.end()
    return title, "".join(rest) + markup[at:]


def links_of(markup: str) -> list[str]:
    """Targets of the anchors, entities resolved; every character is looked at a bounded number of times."""
    found, last = [], {q: markup.rfind(q) for q in "\"'"}
    for anchor in _ANCHOR.finditer(markup):
        href = _HREF.search(markup, anchor.start(1), anchor.end(1) + 1)
        if not href:
            continue
        quote = markup[href.end():href.end() + 1]
        if quote in last and last[quote] <= href.end() and quote:  # never closed: as far as the white space
            value = re.compile(r"[^\s>]+").match(markup, href.end())
        else:
            value = _VALUE.match(markup, href.end())
        if value:
            found.append(html.unescape(next((g for g in value.groups() if g is not None), value.group(0))))
    return found


def plain_text(markup: str) -> str:
    """Visible text: scripts, styles and comments go, block tags end lines, entities are resolved."""
    body = split_title(_SKIP.sub("", markup))[1]
    whole = body.rfind(">") + 1  # beyond it no tag is closed
    tagless = _TAG.sub("", _BREAK.sub("\n", body[:whole])) + body[whole:]
    text = _BLANKS.sub(" ", html.unescape(tagless))
    return "\n".join(x for x in map(str.strip, text.split("\n")) if x)


def _flat(value: str) -> str:
    """A header or field value on one line."""
    return " ".join(value.split())


def _record(kind: str, source: dict, record_id: str, content_type: str, block: str, extra: list[tuple[str, str]]) -> dict:
    octets = block.encode("utf-8", "replace")
    digest = digest_of(octets)
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", source["date"]), ("WARC-Target-URI", source["target_uri"]),
        ("WARC-Refers-To", source["record_id"]), *extra, ("WARC-Block-Digest", digest), ("Content-Type", content_type), ("Content-Length", str(len(octets))),
    ]
    header = "WARC/1.1\r\n" + "".join(f"{k}: {_flat(v)}\r\n" for k, v in fields if v)
    return {"refers_to": source["record_id"], "warc_type": kind, "record_id": record_id, "target_uri": source["target_uri"], "warc_date": source["date"],
            "content_type": content_type, "content_length": len(octets), "block_digest": digest, "header": header, "block": octets.decode()}


def derive(source: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    payload = bytes(source["payload"] or b"")
    headers = [(h["name"] or "", h["value"] or "") for h in (source["http_headers"] if source["http_headers"] is not None else [])]
    source = {k: source[k] if isinstance(source[k], str) else "" for k in ("record_id", "target_uri", "date", "http_status", "payload_digest")}
    content_type = next((v for k, v in headers if k.lower() == "content-type"), "")
    markup, charset = decode(payload, content_type)
    is_html = "html" in content_type.lower() or not content_type
    text = plain_text(markup) if is_html else markup
    title = split_title(markup)[0] if is_html else None
    links = links_of(_SKIP.sub("", markup)) if is_html else []
    name = source["record_id"] or source["target_uri"] + "|" + hashlib.sha256(payload).hexdigest()
    ids = {kind: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name + '#' + kind)}>" for kind in ("metadata", "conversion")}
    conversion = _record("conversion", source, ids["conversion"], "text/plain; charset=utf-8", text, [("WARC-Source-Payload-Digest", source["payload_digest"])])
    said = source["payload_digest"]
    verified = "absent" if not said else "true" if fits(said, payload) else "false"
    fields = [
        ("conversion-record", ids["conversion"]), ("conversion-digest", conversion["block_digest"]), ("conversion-length", str(conversion["content_length"])),
        ("source-status", source["http_status"]), ("source-payload-digest", said), ("source-payload-digest-verified", verified),
        ("source-payload-length", str(len(payload))), ("charset", charset), ("title", html.unescape(title) if title else ""),
        *(("source-header", f"{k}: {v}") for k, v in headers), *(("outlink", x) for x in links),
    ]
    block = "".join(f"{k}: {_flat(v)}\r\n" for k, v in fields if v)
    metadata = _record("metadata", source, ids["metadata"], "application/warc-fields", block, [("WARC-Concurrent-To", ids["conversion"])])
    return [metadata, conversion]


def _derive_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = [r for source in batch.slice(at, 500).to_pylist() for r in derive(source)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def warc_derivatives(responses: DataFrame) -> DataFrame:
    """Two rows per response: its metadata and its conversion record, header and block.

    Record ids are made from the response's id, so a rerun gives the same ones;
    both records carry WARC-Refers-To, and the metadata record is concurrent to
    the conversion.  The metadata block keeps the status line, every source
    header, and the source digest with whether it fits the payload
    (true / false / absent).  Null fields are left out of headers; a null or
    empty payload gives an empty conversion; responses that repeat are each
    converted.  One narrow pass without a shuffle; an empty table gives an
    empty result; other columns are not read.
    """
    return responses.select(*COLUMNS).mapInArrow(_derive_all, SCHEMA)


def write_warc(derivatives: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records as WARC files (one per task): header, empty line, block, two line breaks."""
    record = F.concat("header", F.lit("\r\n"), "block")
    derivatives.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)
