"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response gives up to two records, linked to it by ``WARC-Refers-To`` (with target URI
and date): a *metadata* record (``application/warc-fields``) that carries the source's
HTTP headers and digests, title and links, and a *conversion* record (``text/plain``)
with the visible text.  Record ids are name-based, so a rerun gives the same records.

The text of a payload is found as a browser would: chunks are joined, gzip and deflate
are undone, and the charset is that of the Content-Type header, else of a byte order
mark, else of a ``meta`` element near the start, else UTF-8.  Digests are of the bytes as
they came.

The media type decides what a payload is: markup loses its tags, other text (plain, JSON,
scripts, styles) is its own conversion, and what is neither (images, PDF, archives) has a
metadata record only.  A type that is missing or says only "bytes" is told from the first
bytes: a NUL or bytes outside the charset mean data, a tag at the start means markup.

Defined results: a null payload is empty and, unless its type is not text, gives an empty conversion; header lines
that are not fields are kept as ``http-line``; bytes that are not in the charset become
replacement characters, an unknown charset counts as UTF-8, and an encoding that is
unknown or broken leaves the bytes as they are (broken off: as far as they go); a null
record id stays null and its derivatives refer to nothing; repeated responses give
repeated records; extra columns are ignored.

Scale: row by row where the responses are read; no shuffle.  ``responses_from_paths``
streams files record by record, so a task holds one record, not a file; ``save`` writes a
file for each partition.
"""

from __future__ import annotations

import codecs
import gzip
import hashlib
import io
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Callable, Iterator
from html import unescape
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .htmlmain import blocks, parse
from .shared import column, output, quoted

VERSION = "WARC/1.1"
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PIECE = 1 << 20
BATCH_BYTES = 8 << 20

# Byte order marks and the names of their charsets.
_MARKS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
# Media types of text beside text/*.
TEXTS = frozenset("application/json application/javascript application/x-javascript application/ecmascript application/x-ndjson application/yaml application/x-yaml application/sql".split())
SNIFFED = 2048
_TAG_FIRST = re.compile(rb"(?:\xef\xbb\xbf)?\s*<[!?a-zA-Z]")
_CHARSET = re.compile(r"""charset\s*=\s*["']?([^\s;"']+)""", re.I)
_META = re.compile(rb"""<meta\b[^>]*?\bcharset\s*=\s*["']?\s*([^\s;"'/>]+)""", re.I)

_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: Columns of a response: id, target URI, date, HTTP header block, payload, digests as the source gave them.
RESPONSE = ["record_id", "target_uri", "date", "http_headers", "payload", "block_digest", "payload_digest"]
RECORD = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length bigint, block_digest string, source_block_digest string, source_payload_digest string, block binary"


def digest(data: bytes) -> str:
    """SHA-1 in base 32, labelled, as WARC files have it."""
    return "sha1:" + b32encode(hashlib.sha1(data).digest()).decode()


def name_id(kind: str, record_id: str) -> str:
    """The record id of a derivative: a UUID made from the source's id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{record_id}')}>"


def one_line(text: str) -> str:
    return " ".join(text.split())


def payload_kind(http_headers: str | None, payload: bytes | None) -> str | None:
    """``markup``, ``text``, or None for a payload that is neither."""
    kind = _fields(http_headers).get("content-type", "").split(";")[0].strip().lower()
    if kind in ("", "application/octet-stream", "binary/octet-stream", "unknown/unknown"):
        head = decoded(http_headers, payload)[:SNIFFED]
        if any(head.startswith(mark) for mark, _ in _MARKS[1:]):
            return "markup" if b"<" in head.lstrip()[:4] else "text"
        if _TAG_FIRST.match(head):
            return "markup"
        if b"\0" in head:
            return None
        try:
            codecs.getincrementaldecoder("utf-8")().decode(head, len(head) < SNIFFED)  # a character that the cut splits is no fault
        except UnicodeDecodeError:
            return None
        return "text"
    if kind in ("text/html", "application/xhtml+xml", "application/xml", "text/xml") or kind.endswith("+xml") and not kind.startswith("image/"):
        return "markup"
    return "text" if kind.startswith("text/") or kind.endswith("+json") or kind in TEXTS else None


def plain_text(html: str) -> str:
    """All visible text, one block a line."""

    return "\n".join(text for _, text in blocks(parse(html)[0], lambda k: k.tag == "head"))


def metadata_block(http_headers: str, html: str, block_digest: str | None, payload_digest: str | None) -> bytes:
    """Fields of a metadata record."""
    fields = []
    for k, line in enumerate((http_headers or "").split("\n")):
        line = line.strip("\r")
        if line:
            name, colon, value = line.partition(":")
            fields.append(("http-" + name.strip().lower(), value.strip()) if colon and k else ("http-status" if k == 0 else "http-line", line))
    if block_digest:
        fields.append(("source-block-digest", block_digest))
    if payload_digest:
        fields.append(("source-payload-digest", payload_digest))
    if title := _TITLE.search(html):
        fields.append(("title", one_line(unescape(title[1]))))
    fields += [("outlink", one_line(unescape("".join(m)))) for m in _LINK.findall(html)]
    return "".join(f"{n}: {v}{CRLF}" for n, v in fields).encode("utf-8", "replace")


def _fields(http_headers: str | None) -> dict[str, str]:
    return {n.strip().lower(): v.strip() for n, colon, v in (line.partition(":") for line in (http_headers or "").split("\n")[1:]) if colon}


def _unchunked(data: bytes) -> bytes:
    """The payload of a chunked body; data that is not chunked stays as it is."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return data if not out else b"".join(out)
        if not size:
            break
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out) if out or data[:1] == b"0" else data


def _inflated(data: bytes, how: str) -> bytes:
    """The data without its content encoding."""
    for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(how, ()):
        got, left = [], data
        try:
            while left:
                member = zlib.decompressobj(bits)
                got.append(member.decompress(left) + member.flush())
                left = member.unused_data if bits == 31 and member.unused_data[:2] == b"\x1f\x8b" else b""
            return b"".join(got)
        except zlib.error:
            if got:
                return b"".join(got)
    return data


def decoded(http_headers: str | None, payload: bytes | None) -> bytes:
    """The payload without chunks and content encodings."""
    fields, data = _fields(http_headers), payload or b""
    if fields.get("transfer-encoding", "").lower().endswith("chunked"):
        data = _unchunked(data)
    for how in reversed([x.strip().lower() for x in fields.get("content-encoding", "").split(",")]):
        data = _inflated(data, how)
    return data


def payload_text(http_headers: str | None, payload: bytes | None) -> str:
    """The payload as text."""
    fields, data = _fields(http_headers), decoded(http_headers, payload)
    charset = _CHARSET.search(fields.get("content-type", ""))
    name = charset[1] if charset else next((n for mark, n in _MARKS if data.startswith(mark)), None)
    if name is None:
        meta = _META.search(data[:2048])
        name = meta[1].decode("latin-1") if meta else "utf-8"
    try:
        codec = codecs.lookup("cp1252" if name.lower() in ("latin-1", "latin1", "iso-8859-1", "us-ascii", "ascii") else name)
        text = data.decode(codec.name, "replace") if codec._is_text_encoding else data.decode("utf-8", "replace")
    except (LookupError, ValueError):
        text = data.decode("utf-8", "replace")
    return text.removeprefix("\ufeff")


def derive(responses: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Two records for each response (one where it is not text); ``carry`` columns come along as struct ``row``."""
    row = [F.struct(*[column(c) for c in carry]).alias("_row")] if carry else []
    chosen = responses.select(*[F.col(c) for c in RESPONSE], *row)
    out = output(chosen, {}, RECORD)
    if carry:
        out = out.add("row", chosen.schema["_row"].dataType, True)

    def build(batches):
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(len(RESPONSE))]
            made: list[tuple] = []
            source: list[int] = []
            for i, (rid, uri, date, headers, payload, block, body) in enumerate(zip(*columns)):
                what = payload_kind(headers, payload)
                text = payload_text(headers, payload) if what else ""
                records = [("metadata", "application/warc-fields", metadata_block(headers, text if what == "markup" else "", block, body))]
                if what:
                    records.append(("conversion", "text/plain; charset=UTF-8", (plain_text(text) if what == "markup" else text).encode("utf-8", "replace")))
                for kind, content, data in records:
                    made.append((kind, None if rid is None else name_id(kind, rid), rid, uri, date, content, len(data), digest(data), block, body, data))
                    source.append(i)
            for k in range(0, len(made), 2000):  # texts and links of many pages stay in small batches
                part = list(zip(*made[k : k + 2000]))
                types = [pa.string()] * 6 + [pa.int64()] + [pa.string()] * 3 + [pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(part, types)]
                names = ["record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "source_block_digest", "source_payload_digest", "block"]
                if carry:
                    arrays.append(batch.column(len(RESPONSE)).take(pa.array(source[k : k + 2000], pa.int64())))
                    names.append("row")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return chosen.mapInArrow(build, out)


def record_bytes(row: dict, compress: bool = True) -> bytes:
    """A derivative as a WARC record (one gzip member)."""
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Refers-To-Target-URI", row["target_uri"]), ("WARC-Refers-To-Date", row["date"]), ("WARC-Target-URI", row["target_uri"]), ("WARC-Date", row["date"]), ("WARC-Block-Digest", row["block_digest"]), ("Content-Type", row["content_type"]), ("Content-Length", str(row["content_length"]))]
    head = VERSION + CRLF + "".join(f"{n}: {v}{CRLF}" for n, v in fields if v is not None) + CRLF
    data = head.encode() + bytes(row["block"]) + (CRLF * 2).encode()
    return gzip.compress(data, mtime=0) if compress else data


def _plain(stream: BinaryIO) -> Iterator[bytes]:
    """The bytes of a file a piece at a time, without compression (by record or as a whole)."""
    piece = stream.read(PIECE)
    if piece[:2] != b"\x1f\x8b":
        while piece:
            yield piece
            piece = stream.read(PIECE)
        return
    member = zlib.decompressobj(31)
    while piece:
        got = member.decompress(piece, PIECE)
        if got:
            yield got
        if member.eof:
            piece = member.unused_data.lstrip(b"\0") or stream.read(PIECE)
            member = zlib.decompressobj(31)
        else:
            piece = member.unconsumed_tail or stream.read(PIECE)
    if rest := member.flush():
        yield rest


class _Buffer:
    """Bytes that are read as they are needed."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def upto(self, mark: bytes) -> bytes | None:
        """What stands before the next mark, which is passed over; None if there is none."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, size: int) -> bytes:
        while len(self.held) < size and self.more():
            pass
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


def stream_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file, compressed by record, as a whole or not; one is held at a time."""
    buffer = _Buffer(_plain(stream))
    while buffer.upto(b"WARC/") is not None:
        lines = buffer.upto(b"\r\n\r\n")
        if lines is None:
            return
        head = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines.decode("utf-8", "replace").split(CRLF)[1:])}
        size = head.get("content-length", "0")
        yield head, buffer.take(int(size) if size.isdigit() else 0)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a file that is in memory."""
    return stream_records(io.BytesIO(data))


def open_path(path: str) -> BinaryIO:
    """A stream over a file that pyarrow can reach (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_stream(name, compression=None)


def _responses(stream: BinaryIO) -> Iterator[pa.RecordBatch]:
    """Response rows of a file, a few MB at a time."""
    rows, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "payload" else pa.string()) for n, c in zip(RESPONSE, zip(*rows))], names=RESPONSE)

    for head, block in stream_records(stream):
        if head.get("warc-type") == "response":
            http, _, payload = block.partition(b"\r\n\r\n")
            rows.append((head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), http.decode("latin-1"), payload, head.get("warc-block-digest"), head.get("warc-payload-digest")))
            size += len(block)
            if size > BATCH_BYTES:
                yield out()
                rows, size = [], 0
    if rows:
        yield out()


_RESPONSE = "record_id string, target_uri string, date string, http_headers string, payload binary, block_digest string, payload_digest string"


def responses_from_paths(paths: DataFrame, opener: Callable[[str], BinaryIO] = open_path) -> DataFrame:
    """Response rows of WARC files (a frame with column ``path``), streamed by the tasks that have the paths."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if path is not None:
                    with opener(path) as stream:
                        yield from _responses(stream)

    return paths.select("path").mapInArrow(read, _RESPONSE)


def responses_from_files(files: DataFrame) -> DataFrame:
    """Response rows of WARC files that only Spark can open (column ``content`` of the binaryFile source, 2 GB a file at most)."""

    def read(batches):
        for batch in batches:
            for data in batch.column(0):
                yield from _responses(pa.BufferReader(data.as_buffer()) if data.is_valid else io.BytesIO())

    return files.select("content").mapInArrow(read, _RESPONSE)


def save(made: DataFrame, folder: str) -> DataFrame:
    """Write derivatives as WARC files, one for each partition; (path, records) of each.

    A file is written under another name and then put in place, and its name is that of
    its partition, so a task that runs again writes the same file.  The folder is one
    that pyarrow can reach from the tasks.
    """
    names = ["record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "block"]

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        system, name = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(name, recursive=True)
        path = f"{name}/part-{context.partitionId():06d}.warc.gz"
        aside = f"{path}.{context.taskAttemptId()}"
        n = 0
        with system.open_output_stream(aside, compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    out.write(record_bytes(row))
                    n += 1
        if n:
            system.move(aside, path)
        else:
            system.delete_file(aside)
        yield pa.RecordBatch.from_arrays([pa.array([path] * bool(n), pa.string()), pa.array([n] * bool(n), pa.int64())], names=["path", "records"])

    return made.select(*names).mapInArrow(write, "path string, records bigint")


def responses_from_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response rows of crawled pages (page_id, url, html), with all of their columns."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    name = F.sha1(F.concat_ws("|", F.col("page_id").cast("string"), F.col("url").cast("string")))
    part = lambda a, n: F.substring(name, a, n)
    rid = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    block = F.concat(headers.cast("binary"), F.lit("\r\n\r\n").cast("binary"), payload)
    return pages.select(
        F.struct(*quoted(pages)).alias("source"), rid.alias("record_id"), F.col("url").cast("string").alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), payload.alias("payload"),
        F.concat(F.lit("sha256:"), F.sha2(block, 256)).alias("block_digest"), F.concat(F.lit("sha256:"), F.sha2(payload, 256)).alias("payload_digest"),
    )


def op6(spark, sf_dir: str) -> DataFrame:
    """``op6_warc_derivatives`` over all of ``pages``: two records for each page, blocks as digests."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    responses = responses_from_pages(pages).withColumn("page_id", F.col("source.page_id"))
    made = derive(responses, ["page_id"])
    return made.select(F.col("row.page_id").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "source_block_digest", "source_payload_digest")
