"""WARC derivatives: from response records to linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean
from .html import SITE, lines

RESPONSE = "record_id string, target_uri string, date string, headers map<string,string>, http binary"
RECORD = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, payload_digest string, source_headers string, block string"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_TITLE, _LINK, _CHARSET = re.compile(r"(?is)<title[^>]*>(.*?)</title"), re.compile(r"""(?i)<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""), re.compile(r"(?i)charset=[\"']?([\w.:-]+)")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, of: str) -> str:
    """A name-based identifier: reruns give the same."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {of}')}>"


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id and RESPONSE of each page: an HTTP answer that holds its html. A null html is an empty body, a null url an empty one."""

    def run(batches):
        for b in batches:
            rows = []
            for page_id, url, page in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                body = (page or "").encode("utf-8", "replace")
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                name = record_id("response", f"{page_id} {url or ''} {date}")
                headers = {"WARC-Type": "response", "WARC-Record-ID": name, "WARC-Target-URI": url or "", "WARC-Date": date, "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(http)), "WARC-Block-Digest": digest(http), "WARC-Payload-Digest": digest(body)}
                rows.append((page_id, name, url or "", date, list(headers.items()), http))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["page_id", "record_id", "target_uri", "date", "headers", "http"])

    return pages.select("page_id", "url", "html").mapInArrow(lean(run), f"page_id long, {RESPONSE}")


def _split(http: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP answer; without a blank line all of it is head."""
    head, _, body = http.partition(b"\r\n\r\n")
    first, *rest = head.decode("latin-1").split("\r\n")
    headers: list[tuple[str, str]] = []
    for line in rest:
        if line[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            headers.append((k.strip(), v.strip()))
    return first, headers, body


def _text(headers: list[tuple[str, str]], body: bytes) -> str:
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    found = _CHARSET.search(kind) or _CHARSET.search(body[:1024].decode("latin-1"))
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derived(name: str, uri: str, date: str, source: dict[str, str], http: bytes) -> list[tuple]:
    """The metadata and the conversion record (RECORD) of one response."""
    status, headers, body = _split(http)
    page = _text(headers, body)
    payload = source.get("WARC-Payload-Digest") or digest(body)
    kept = json.dumps(source, sort_keys=True, ensure_ascii=False)
    title = _TITLE.search(page)
    text = "\n".join(t for z, t in lines(page) if z != SITE)
    ids = {k: record_id(k, name) for k in ("metadata", "conversion")}
    links = [a or b or c for a, b, c in _LINK.findall(page)]
    meta = {
        "Envelope": {"WARC-Header-Metadata": source, "Payload-Metadata": {"HTTP-Response-Metadata": {"Response-Message": status, "Headers": [list(x) for x in headers], "Entity-Length": len(body), "Entity-Digest": payload, "HTML-Metadata": {"Title": " ".join(title[1].split()) if title else "", "Links": links}}}},
        "Conversion": ids["conversion"],
    }
    out = []
    for kind, content, block in (("metadata", "application/json", json.dumps(meta, sort_keys=True, ensure_ascii=False)), ("conversion", "text/plain; charset=utf-8", text)):
        raw = block.encode("utf-8", "replace")
        out.append((kind, ids[kind], name, uri, date, content, len(raw), digest(raw), payload, kept, raw.decode()))
    return out


def derivatives(source: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """RECORD rows of response records (RESPONSE columns), and the columns named in keep: for each a metadata record, then a conversion record.

    refers_to is the response's identifier, payload_digest its payload digest as given (or computed, where its headers lack one), source_headers its
    WARC headers as JSON; the metadata names the conversion. A null http is an empty answer; other nulls are empty strings. Repeated rows give
    repeated records; an empty table gives no rows.
    """
    fields = [f for f in source.schema if f.name in keep]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches):
        for b in batches:
            rows, at = [], []
            cols = [b.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "headers", "http")]
            for i, (name, uri, date, headers, http) in enumerate(zip(*cols, strict=True)):
                got = derived(name or "", uri or "", date or "", {k: v or "" for k, v in headers or []}, http or b"")
                rows += got
                at += [i] * len(got)
            arrays = [pa.array([r[k] for r in rows], pa.int64() if n == "content_length" else pa.string()) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name).take(pa.array(at, pa.int32())) for f in fields), *arrays], [*(f.name for f in fields), *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), RECORD])
    return source.select(*[f.name for f in fields], "record_id", "target_uri", "date", "headers", "http").mapInArrow(lean(run), schema)


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """RECORD rows as WARC files, by Spark's own writer; a record ends with the two line ends that the format asks for. A null column is an empty value.

    A file is one gzip member: readers that jump to a record by its offset need compression="none".
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    line = lambda name, col: F.concat(F.lit(f"{name}: "), text(col), F.lit("\r\n"))
    # The format's field names.
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", "record_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"), line("WARC-Target-URI", "target_uri"),
        line("WARC-Date", "date"), line("Content-Type", "content_type"), F.concat(F.lit("Content-Length: "), F.octet_length(text("block")).cast("string"), F.lit("\r\n")), line("WARC-Block-Digest", "block_digest"), line("WARC-Payload-Digest", "payload_digest"), F.lit("\r\n"),
    )
    records.select(F.concat(head, text("block")).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def gunzip(data: bytes) -> bytes:
    """All gzip members of data; of one that is cut short or broken, what can be read of it."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file, gzipped or not. A record without a length that is a number, and one whose block is cut short, end
    with the next record or the file; bytes outside records are passed over."""
    if data[:2] == b"\x1f\x8b":
        data = gunzip(data)
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            headers[k.strip()] = v.strip()
        length = headers.get("Content-Length", "")
        if re.fullmatch(r"[0-9]+", length):
            stop = end + 4 + int(length)
        else:
            stop = data.find(b"WARC/1.", end + 4)
            stop = len(data) if stop < 0 else stop
        yield headers, data[end + 4 : stop]
        at = stop


def read(spark: SparkSession, path: str) -> DataFrame:
    """RESPONSE rows of the response records in WARC files below path, read by Spark: each file whole, so of less than 2 GB, zipped or not."""

    def run(batches):
        for b in batches:
            for data in b.column("content").to_pylist():
                rows = [(h.get("WARC-Record-ID", ""), h.get("WARC-Target-URI", ""), h.get("WARC-Date", ""), list(h.items()), block) for h, block in parse(data) if h.get("WARC-Type") == "response"]
                kinds = [pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["record_id", "target_uri", "date", "headers", "http"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(lean(run), RESPONSE)
