"""WARC derivatives: of every response record, a metadata record and a
plain-text conversion record that refer to it.

``responses`` writes pages as WARC/1.0 response records; ``read`` takes the
records of WARC files, plain or gzip, as a stream of blocks; ``derive`` the two derivatives of each response, with no shuffle:

* metadata (JSON): the source's WARC headers and HTTP headers as they stand,
  its payload digest as given and as computed, title and links;
* conversion: the page's text (scripts, styles, comments and tags removed,
  block elements as line ends, character references resolved).

Both carry ``WARC-Refers-To`` with the source's record id, its target and
date, and digests of their own block.  Record ids are name-based UUIDs of the
source id and the derivative's kind, so reruns agree.  ``write`` stores records
as text files whose records end as WARC asks.

Nulls: a null page is an empty payload, a null url an empty target.  Records
that are no response give no derivative.  Bodies may be chunked or gzip; bytes
that the charset lacks become replacement characters.  Repeated rows are
records each, with equal ids."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.archive import file_blocks
from .common import n_parts, small_batches

CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
#: Elements that are no text, with all they hold.
HIDDEN = ("script", "style", "noscript", "template")
CLOSE = {x: re.compile(rf"</{x}\s*>", re.I) for x in (*HIDDEN, "title")}
BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|head|body|blockquote|pre|hr)\b[^>]*>", re.I)
TAG = re.compile(r"<[^>]*>")
TITLE = re.compile(r"<title\b", re.I)
ANCHOR = re.compile(r"<a\b", re.I)
HREF = re.compile(r"\bhref\s*=\s*", re.I)
VALUE = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>]+)")
#: Bytes among which a record's header ends.
HEADER = 1 << 20
_BLANK, _LENGTH = re.compile(rb"\r?\n\r?\n"), re.compile(rb"(?im)^content-length:\s*(\d+)")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(10).join(names))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it; header values lose
    their line ends."""
    lines = ["WARC/1.0", *[f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF * 2 + block


def headers_of(raw: bytes) -> tuple[str, list[tuple[str, str]]]:
    """First line and (name, value) pairs; folded lines are joined."""
    text = re.sub(r"\r?\n[ \t]+", " ", raw.decode("utf-8", "replace"))
    first, *rest = re.split(r"\r?\n", text)
    return first, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in rest if x)]


def value(headers: list[tuple[str, str]], name: str, other: str = "") -> str:
    return next((v for k, v in headers if k.lower() == name.lower()), other)


def split_at_blank(data: bytes) -> tuple[bytes, bytes]:
    m = re.search(rb"\r?\n\r?\n", data)
    return (data[:m.start()], data[m.end():]) if m else (data, b"")


def _unzipped(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a file, gzip members one after the other, or as they are;
    what follows the last member is dropped."""
    parts = iter(parts)
    data = b""
    while len(data) < 2 and (got := next(parts, None)) is not None:
        data += got
    if data[:2] != b"\x1f\x8b":
        yield data
        yield from parts
        return
    while True:
        member = zlib.decompressobj(31)
        while not member.eof:
            while data and not member.eof:
                out = member.decompress(data, HEADER)
                data = member.unused_data if member.eof else member.unconsumed_tail
                if out:
                    yield out
            if not member.eof and (data := next(parts, None)) is None:
                return
        while len(data) < 2 and (got := next(parts, None)) is not None:
            data += got
        if data[:2] != b"\x1f\x8b":
            return


def records_of(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a file's bytes, one after the other; memory holds one.
    It ends at a header that does not end within ``HEADER`` bytes."""
    held, parts = bytearray(), _unzipped(parts)

    def more() -> bool:
        got = next(parts, None)
        held.extend(got or b"")
        return got is not None

    while True:
        while (at := held.find(b"WARC/")) < 0:
            del held[:max(0, len(held) - 4)]
            if not more():
                return
        del held[:at]
        while not (m := _BLANK.search(held)):
            if len(held) > HEADER or not more():
                return
        n = _LENGTH.search(held, 0, m.start())
        end = m.end() + (int(n[1]) if n else 0)
        while len(held) < end and more():
            pass
        yield bytes(held[:end])
        del held[:end]


def body_of(block: bytes) -> tuple[str, list[tuple[str, str]], bytes, bytes]:
    """(status line, HTTP headers, payload as sent, payload decoded)."""
    head, raw = split_at_blank(block)
    status, headers = headers_of(head)
    body = raw
    if value(headers, "Transfer-Encoding").lower() == "chunked":
        out, at = [], 0
        while m := re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r?\n").match(body, at):
            n = int(m[1], 16)
            if not n:
                break
            out.append(body[m.end():m.end() + n])
            at = m.end() + n
            at += 2 if body[at:at + 2] == CRLF else 1
        body = b"".join(out)
    if value(headers, "Content-Encoding").lower() in ("gzip", "x-gzip"):
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError, zlib.error):
            pass  # as sent
    return status, headers, raw, body


@cache
def _openings(kinds: tuple[str, ...]) -> re.Pattern:
    """Where a comment ("") or an element of these names begins."""
    return re.compile("|".join("<!--" if not k else rf"<(?:{k})\b" for k in kinds), re.I)


def shown(page: str) -> str:
    """The page with a blank for each comment and hidden element that ends.  An
    end found ahead is kept, so that the page is read once."""
    out, at, ends = [], 0, {}

    def end_of(name: str, start: int, find) -> int:
        """Where the next end from start on is; -1 where there is none."""
        if name not in ends or -1 < ends[name][0] < start:
            ends[name] = find(start)
        return ends[name][1]

    def closing(name: str, start: int) -> tuple[int, int]:
        m = CLOSE[name].search(page, start)
        return m.span() if m else (-1, -1)

    def text(mark: str, start: int) -> tuple[int, int]:
        i = page.find(mark, start)
        return (i, i + len(mark)) if i >= 0 else (-1, -1)

    look, kinds = 0, ("", *HIDDEN)
    while kinds and (m := _openings(kinds).search(page, look)):
        name = m[0][1:].lower() if m[0] != "<!--" else ""
        if not name:
            end = end_of("-->", m.end(), lambda i: text("-->", i))
        else:
            end = end_of(">", m.end(), lambda i: text(">", i))
            if end >= 0:
                end = end_of(name, end, lambda i, name=name: closing(name, i))
        if end < 0:  # nor does any after it end
            look, kinds = m.end(), tuple(k for k in kinds if k != name)
            continue
        out += (page[at:m.start()], " ")
        at = look = end
    return "".join([*out, page[at:]])


def sub_tags(tag: re.Pattern, to: str, page: str) -> str:
    """All tags replaced; a tag needs a >, so the search ends at the last."""
    end = page.rfind(">") + 1
    return tag.sub(to, page[:end]) + page[end:]


def title_of(page: str) -> str:
    m = TITLE.search(page)
    begin = page.find(">", m.end()) + 1 if m else 0
    end = CLOSE["title"].search(page, begin) if begin else None
    return page[begin:end.start()] if end else ""


def links_of(page: str) -> list[str]:
    """The targets of anchors, each looked for up to the tag's end or the next
    anchor."""
    out, gt, done = [], -2, 0
    starts = [m.start() for m in ANCHOR.finditer(page)]
    for start, following in itertools.pairwise([*starts, len(page)]):
        if start < done:  # within the value before
            continue
        if gt != -1 and gt < start:
            gt = page.find(">", start)
        m = HREF.search(page, start + 2, min(following, gt) if gt >= 0 else following)
        m = VALUE.match(page, m.end()) if m else None
        if m:
            out.append(html.unescape(m[1] or m[2] or m[3] or ""))
            done = m.end()
    return out


def plain_text(page: str) -> str:
    text = sub_tags(TAG, "", sub_tags(BLOCK, "\n", shown(page)))
    lines = (re.sub(r"[ \t\f\v ]+", " ", x).strip() for x in re.split(r"[\r\n]+", html.unescape(text)))
    return "\n".join(x for x in lines if x)


def derivatives(source: bytes) -> tuple[dict, bytes, bytes] | None:
    """(figures, metadata record, conversion record) of a response record."""
    head, block = split_at_blank(source)
    _, headers = headers_of(head)
    if value(headers, "WARC-Type").lower() != "response":
        return None
    status, http, raw, body = body_of(block)
    charset = re.search(r"charset=[\"']?([\w.:-]+)", value(http, "Content-Type"))
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    source_id, target, date = value(headers, "WARC-Record-ID"), value(headers, "WARC-Target-URI"), value(headers, "WARC-Date", DATE)
    text = plain_text(page)
    about = {"warc-headers": headers, "http-status": status, "http-headers": http, "payload-digest": value(headers, "WARC-Payload-Digest"),
             "actual-digest": digest(raw), "payload-length": len(raw), "title": plain_text(title_of(page)), "links": links_of(shown(page))}
    out = []
    for kind, mime, data in (("metadata", "application/json", json.dumps(about, ensure_ascii=False).encode("utf-8", "replace")),
                             ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        out.append(record([("WARC-Type", kind), ("WARC-Record-ID", record_id(source_id, kind)), ("WARC-Refers-To", source_id), ("WARC-Target-URI", target),
                           ("WARC-Date", date), ("WARC-Block-Digest", digest(data)), ("Content-Type", mime)], data))
    return about | {"source_id": source_id, "target": target, "date": date, "text": text}, out[0], out[1]


def response(page_id: str, url: str, page: str, date: str = DATE) -> bytes:
    body = page.encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    return record([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url, digest(body))), ("WARC-Target-URI", url), ("WARC-Date", date),
                   ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")], block)


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, record) of a table of pages."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = zip(*[c.to_pylist() for c in b.columns], strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([response("" if k is None else str(k), u or "", h or "") for k, u, h in rows], pa.binary())],
                                             names=["_key", "record"])

    small_batches(pages.sparkSession, 500)
    return (pages.select(F.col(key).alias("_key"), F.col(url).alias("u"), F.col(page).alias("h"))
            .mapInArrow(run, f"_key {kind}, record binary").withColumnRenamed("_key", key))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, record) of WARC files; one file is one task's work, a record at a
    time."""
    def run(batches):
        flat = (r for b in batches for r in zip(b.column("file").to_pylist(), b.column("data").to_pylist(), strict=True))
        for file, group in itertools.groupby(flat, key=lambda r: r[0]):
            held, size = [], 0
            for r in records_of(d for _, d in group):
                held.append(r)
                size += len(r)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(held)), pa.array(held, pa.binary())], names=["path", "record"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(held)), pa.array(held, pa.binary())], names=["path", "record"])

    return (file_blocks(spark, [path]).repartition(n_parts(spark), "file").sortWithinPartitions("file", "place")
            .mapInArrow(run, "path string, record binary"))


SHAPE = ("source_id string, target string, date string, payload_digest string, digest_agrees boolean, title string, links array<string>, "
         "text string, metadata_id string, conversion_id string, metadata string, conversion string")


def derive(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``keep`` and, of each response in ``record``, its id,
    target, date and digest, title, links and text, and the two records."""
    names = [f"_k{i}" for i in range(len(keep))]

    def run(batches):
        for b in batches:
            out, at = [], []
            for i, r in enumerate(b.column(b.num_columns - 1).to_pylist()):
                got = derivatives(r) if r else None
                if got:
                    a, meta, conv = got
                    at.append(i)
                    out.append((a["source_id"], a["target"], a["date"], a["payload-digest"], a["payload-digest"] == a["actual-digest"], a["title"], a["links"], a["text"],
                                record_id(a["source_id"], "metadata"), record_id(a["source_id"], "conversion"), meta.decode(), conv.decode()))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(i).take(pa.array(at)) for i in range(len(keep))],
                     *[pa.array(c, pa.bool_() if i == 4 else pa.list_(pa.string()) if i == 6 else pa.string()) for i, c in enumerate(cols)]],
                    names=[*names, *[x.split()[0] for x in SHAPE.split(", ")]])

    small_batches(records.sparkSession, 500)
    rows = records.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], "record")
    kinds = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    return rows.mapInArrow(run, kinds + SHAPE).withColumnsRenamed(dict(zip(names, keep, strict=True)))


def write(derived: DataFrame, path: str) -> None:
    """Metadata and conversion records as gzip WARC text files."""
    (derived.select(F.explode(F.array("metadata", "conversion")).alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path))
