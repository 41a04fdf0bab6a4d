"""WARC derivatives: responses to linked metadata and plain-text conversion records.

A response gives two records. The conversion holds the page's visible text; the metadata record, in
``application/warc-fields``, holds title, language, character set, links and the
source's HTTP headers, all of them and in their order, repeated ones too. Both name the response in WARC-Refers-To, with its target
URI, date and payload digest; each carries its own block digest (SHA-1, base 32). Record ids are name-based UUIDs of what they
derive from, so a task that runs again writes the same records. Transfer and content encodings (chunked, gzip, deflate) are undone
for the text; the digest is of the payload as it was sent. A body that is not text by its Content-Type, or that has another encoding,
has a metadata record alone, as there is no text to convert.

``read_responses`` streams: a task reads one file record by record, gzip members or plain, so a file may be larger than memory;
``write_records`` is the sink, one gzip member for each record, one file for each task, visible once its task commits.

Defined results: a null or empty page gives an empty conversion and a metadata record without links; a null URL
gives no WARC-Target-URI; repeated rows give the same records again (same ids), which ``distinct_records`` reduces to one; an empty
table gives none; other columns are ignored. A page, however long, is held whole in memory, one at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import batches

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BREAK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|main|aside|blockquote|pre|title|head|body|html|form|dd|dt|dl)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!?][^>]*>")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n\s*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
_CHARSET = re.compile(r"<meta\b[^>]*?\bcharset\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HEADER = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)\r?$", re.M)

RESPONSE = "record_id string, target_uri string, warc_date string, http_headers string, payload binary"
DERIVED = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, "
    "block_digest string, source_payload_digest string, source_headers string, record_sha256 string, block binary"
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def visible_text(page: str) -> str:
    """The text of a page: hidden parts out, block elements to lines, entities resolved, blanks joined."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page)))
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(text))).strip()


def _one_line(value: str) -> str:
    return " ".join(value.split())


def metadata_fields(page: str, headers: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Name and value pairs of the metadata block, in a fixed order."""
    bare = _HIDDEN.sub(" ", page)
    out = [(name, _one_line(html.unescape(m[1]))) for name, rx in (("title", _TITLE), ("language", _LANG), ("charset", _CHARSET)) if (m := rx.search(bare))]
    out += [("http-header", _one_line(f"{k}: {v}")) for k, v in headers]
    links = list(dict.fromkeys(_one_line(html.unescape(a or b or c)) for a, b, c in _LINK.findall(bare)))
    return [*out, ("n-outlinks", str(len(links))), *(("outlink", x) for x in links if x)]


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def plain_body(headers: list[tuple[str, str]], payload: bytes) -> str | None:
    """The text of a body, its encodings undone; None if its headers name a type that is not text, or an encoding unknown here."""
    said = {}
    for name, value in headers:
        said.setdefault(name.strip().lower(), value.strip().lower())  # of repeated ones, the first
    kind = said.get("content-type", "text/html").split(";")[0].strip()
    if kind and not (kind.startswith("text/") or kind.endswith(("+xml", "+json")) or kind in ("application/xml", "application/json", "application/javascript")):
        return None
    try:
        for coding in reversed([c.strip() for c in f"{said.get('content-encoding', '')},{said.get('transfer-encoding', '')}".split(",") if c.strip()]):
            if coding == "chunked":
                payload = _unchunked(payload)
            elif coding in ("gzip", "x-gzip"):
                payload = zlib.decompressobj(31).decompress(payload)
            elif coding == "deflate":
                payload = zlib.decompressobj(15 if payload[:1] == b"\x78" else -15).decompress(payload)
            elif coding != "identity":
                return None
    except (zlib.error, ValueError):
        return None
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", said.get("content-type", "")) or re.search(rb"<meta\b[^>]*?\bcharset\s*=\s*[\"']?([\w-]+)", payload[:2048], re.I)
    charset = named[1] if named else "utf-8"
    try:
        return payload.decode(charset if isinstance(charset, str) else charset.decode(), "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _unchunked(data: bytes) -> bytes:
    """A chunked body's content. Data that is not chunked, as archives often keep it, stays as it is."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].split(b";")[0].strip() if 0 <= end <= at + 200 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            return data if not out else b"".join(out)
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        at = end + 4 + n


def derive(response_id: str, uri: str | None, date: str, headers: list[tuple[str, str]], page: str | None, payload: bytes) -> list[dict]:
    """The metadata and, if there is text (``page``), the conversion record of one response."""
    source = digest(payload)
    fields = "".join(f"{k}: {v}\r\n" for k, v in metadata_fields(page or "", headers)).encode("utf-8", "surrogatepass")
    out = []
    for kind, content_type, block in (("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", visible_text(page or "").encode("utf-8", "surrogatepass")))[: 1 if page is None else 2]:
        own, block_digest = record_id(response_id, kind), digest(block)
        named = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", response_id), ("WARC-Date", date), ("Content-Type", content_type), ("WARC-Block-Digest", block_digest), ("WARC-Refers-To-Payload-Digest", source)]
        if uri is not None:
            named.insert(3, ("WARC-Target-URI", uri))
        whole = record_bytes(named, block)
        out.append(
            {"record_type": kind, "record_id": own, "refers_to": response_id, "target_uri": uri, "warc_date": date, "content_type": content_type, "content_length": len(block), "block_digest": block_digest}
            | {"source_payload_digest": source, "source_headers": json.dumps([list(h) for h in headers], ensure_ascii=False), "record_sha256": hashlib.sha256(whole).hexdigest(), "block": block, "record": whole}
        )
    return out


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    types = {"page_id": pa.int64(), "content_length": pa.int64(), "block": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names)


def derivatives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", with_block: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", headers_col: str | None = None) -> DataFrame:
    """Two records for each page. ``headers_col`` may name a map of HTTP headers; else text/html is stated."""
    headers = F.to_json(F.col(headers_col)) if headers_col else F.lit('{"Content-Type":"text/html"}')
    schema = DERIVED if with_block else DERIVED.rpartition(", block")[0]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        for batch in batches(frames):
            rows = []
            for page_id, url, page, head in zip(*(batch.column(i).to_pylist() for i in range(4))):
                page = page or ""
                payload = page.encode("utf-8", "surrogatepass")
                source = record_id("response", str(page_id), url or "", hashlib.sha256(payload).hexdigest())
                rows += [{"page_id": page_id} | r for r in derive(source, url, date, list((json.loads(head) if head else {}).items()), page, payload)]
            yield _batch(rows, names)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), headers.alias("headers")).mapInArrow(run, schema)


def parse_records(source: bytes | BinaryIO) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record of a WARC file, gzip members or plain, one record in memory at a time."""
    stream = io.BufferedReader(io.BytesIO(source)) if isinstance(source, bytes) else io.BufferedReader(source)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        raw = b""
        while (line := stream.readline()).strip():
            raw += line
        headers = [(k.decode(), v.decode()) for k, v in _HEADER.findall(raw)]
        yield headers, stream.read(int(next((v for k, v in headers if k.lower() == "content-length"), 0)))


def _system(path: str):
    """The Arrow file system of a path as Spark writes it (not escaped), and the path there."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


class _Remote(io.RawIOBase):
    """A file of any file system that Arrow reaches, or of the executors' disk, as a stream."""

    def __init__(self, path: str):
        system, name = _system(path)
        self._stream = system.open_input_stream(name, compression=None)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self._stream.read(len(into))
        into[: len(data)] = data
        return len(data)


def read_responses(spark: SparkSession, path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """Response records of the WARC files under ``path``, HTTP headers (name and value pairs, in order) parted from the payload.

    Spark lists the files, without their content; each is one task's, which reads it as a stream and hands on
    batches of about ``batch_bytes``. The path must be one that Arrow's file systems reach too (file, hdfs, s3, gs)."""
    names = ["record_id", "target_uri", "warc_date", "http_headers", "payload"]

    def run(frames):
        for batch in frames:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                for pairs, block in parse_records(_Remote(name)):
                    head = {k.lower(): v for k, v in pairs}
                    if head.get("warc-type") != "response":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    sent = [[k.decode("latin-1"), v.decode("latin-1")] for k, v in _HEADER.findall(http)]
                    rows.append((head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), json.dumps(sent), payload))
                    size += len(block)
                    if size >= batch_bytes:
                        yield _responses(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _responses(rows, names)

    files = spark.read.format("binaryFile").load(path).select("path")  # the content column is not read
    tasks = max(1, min(files.count(), 10_000))
    return files.repartition(tasks).mapInArrow(run, RESPONSE)


def _responses(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 4 else pa.string()) for i, c in enumerate(zip(*rows))], names)


def derive_responses(responses: DataFrame) -> DataFrame:
    """Derivatives of parsed responses: record ids, dates and headers are the responses' own."""
    schema = DERIVED.replace("page_id long, ", "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        for batch in batches(frames):
            rows = []
            for rid, uri, date, head, payload in zip(*(batch.column(i).to_pylist() for i in range(5))):
                headers, payload = [tuple(h) for h in json.loads(head or "[]")], payload or b""
                rows += derive(rid, uri, date or "", headers, plain_body(headers, payload), payload)
            yield _batch(rows, names)

    return responses.select("record_id", "target_uri", "warc_date", "http_headers", "payload").mapInArrow(run, schema)


def distinct_records(derived: DataFrame) -> DataFrame:
    """One row for each record id; equal ids hold equal records."""
    return derived.dropDuplicates(["record_id"])


def write_records(derived: DataFrame, path: str, name: str = "derivatives") -> DataFrame:
    """Write derived records as gzipped WARC files under ``path``, one file a task; returns file, n_records, n_bytes.

    A task writes under a name of its own and renames it when it is whole, so of repeated or lost tasks one file stays. The
    path must be one that Arrow's file systems reach from every executor."""
    columns = ["record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "source_payload_digest", "block"]

    def run(frames):
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = _system(path)
        system.create_dir(folder, recursive=True)
        own = f"{name}-{task.partitionId():05d}.warc.gz"
        draft, n, size = f"{folder}/.{own}.{task.taskAttemptId()}", 0, 0
        with system.open_output_stream(draft, compression=None) as out:
            for batch in frames:
                for r in batch.to_pylist():
                    head = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Date", r["warc_date"]), ("Content-Type", r["content_type"])]
                    head += [("WARC-Target-URI", r["target_uri"])] if r["target_uri"] is not None else []
                    head += [("WARC-Block-Digest", r["block_digest"]), ("WARC-Refers-To-Payload-Digest", r["source_payload_digest"])]
                    size += out.write(gzip.compress(record_bytes(head, r["block"] or b""), 6, mtime=0))
                    n += 1
        system.move(draft, f"{folder}/{own}")
        yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "n_records", "n_bytes"])

    done = derived.select(*columns).mapInArrow(run, "file string, n_records long, n_bytes long")
    return derived.sparkSession.createDataFrame(done.collect(), done.schema)  # one row for each file
