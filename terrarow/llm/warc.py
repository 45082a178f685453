"""WARC: a Python data source that writes and reads archives of gzip members, one record each.

Writing: spark.write.format("warc") puts one file per task into a folder by a name of its own, and beside it an index
with where each record starts; the commit writes a manifest with name, size and number of records of the files of
successful attempts, so files of lost or repeated tasks are never read. Reading: the reader
plans partitions of SPLIT_BYTES over the manifest's files, and a task takes the records that start in its part. It takes equality
and IN predicates on record_type and the headers it exposes, inflates the header block of each record first, and where
a predicate fails or payloads aren't asked for goes on to the start of the next record, without reading or inflating
the rest.

Any file system that pyarrow can open by URI holds the archives.

Edge cases: null html is an empty payload; null urls give an empty target; records with a null page_id are written
with an empty id, never referred to, and read back as null; an empty table gives an empty archive; equal payloads,
even empty ones, are revisits of the smallest page_id's record; rows that repeat a page_id are records each, and where
several with equal payloads have the smallest page_id, each of them is a response; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from array import array
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from .common import new_path, stored, table

SCHEMA = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"
MANIFEST, INDEX = "_manifest.json", ".index"
#: Bytes of an archive that one read task takes, at least; splits fall on member starts.
SPLIT_BYTES = 32 << 20
#: Bytes that are read at a time, and of a record to find its headers at first.
_READ_BYTES, _HEAD_BYTES = 1 << 20, 1024


def _open_fs(path: str):
    from pyarrow import fs

    if not urlsplit(path).scheme:
        path = f"file://{path}"
    return fs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line; what can't stand in a header is percent-encoded."""
    return "".join(c if c > "\x1f" and c != "%" else "%%%02X" % ord(c) for c in value)


def _unclean(value: str) -> str:
    from urllib.parse import unquote

    return unquote(value, errors="surrogatepass") if "%" in value else value


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member of two zlib streams' worth of text: headers, then the HTTP block."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
    ]
    if refers_to is not None:
        head.insert(4, f"WARC-Refers-To: <urn:page:{refers_to}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n") + z.flush()


@dataclass
class _Written(WriterCommitMessage):
    file: str = ""
    size: int = 0
    records: int = 0


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows):
        fs, root = _open_fs(self.path)
        fs.create_dir(root, recursive=True)
        name, size, starts = f"part-{uuid.uuid4().hex}.warc.gz", 0, array("q")
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for r in rows:
                starts.append(size)
                data = record_bytes(r["page_id"], r["url"], (r["html"] or "").encode(), r["refers_to"])
                out.write(data)
                size += len(data)
        starts.append(size)
        with fs.open_output_stream(f"{root}/{name}{INDEX}", compression=None) as out:
            out.write(np.array(starts, "<i8").tobytes())
        return _Written(name, size, len(starts) - 1)

    def commit(self, messages):
        fs, root = _open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files = [{"file": m.file, "size": m.size, "records": m.records} for m in messages if m is not None]
        with fs.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages):
        pass  # without a manifest no file of this write is read


@dataclass
class _Part(InputPartition):
    file: str
    start: int
    end: int


class _Stretch:
    """A file read forwards in pieces of _READ_BYTES; what lies between the pieces asked for isn't read."""

    def __init__(self, file):
        self.file, self.at, self.data = file, 0, b""
        self.read_bytes = 0

    def get(self, start: int, end: int) -> bytes:
        if start < self.at or end > self.at + len(self.data):
            kept = self.data[start - self.at :] if self.at <= start < self.at + len(self.data) else b""
            self.file.seek(start + len(kept))
            more = self.file.read(max(end - start - len(kept), min(_READ_BYTES, self.limit - start - len(kept))))
            self.read_bytes += len(more)
            self.at, self.data = start, kept + more
        return self.data[start - self.at : end - self.at]

    limit = 1 << 62


def _inflated(stretch: _Stretch, start: int, end: int, wanted) -> bytes | None:
    """The rest of the record of the bytes [start, end) if wanted(headers), else None; more than the headers is inflated only then."""
    z, text, at, size = zlib.decompressobj(31), bytearray(), start, _HEAD_BYTES
    while (head_end := text.find(b"\r\n\r\n")) < 0:
        if at >= end:
            raise EOFError("a record is cut off")
        to = min(end, at + size)
        text += z.decompress(stretch.get(at, to))
        at, size = to, 2 * size
    if not wanted(bytes(text[:head_end])):
        return None
    while at < end:
        to = min(end, at + _READ_BYTES)
        text += z.decompress(stretch.get(at, to))
        at = to
    if not z.eof:
        raise EOFError("a record is cut off")
    return bytes(text[head_end + 4 :])


def _headers(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])


def _page(urn: str | None) -> int | None:
    number = (urn or "")[len("<urn:page:") : -1]
    return int(number) if number else None


class WarcReader(DataSourceReader):
    #: Predicates on these columns are decided from a record's headers.
    PUSHED = ("record_type", "page_id", "refers_to", "payload_digest", "payload_bytes", "url")

    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.filters = path, payload, []

    def pushFilters(self, filters):
        self.filters = []
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in self.PUSHED:
                self.filters.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self):
        fs, root = _open_fs(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
            files = json.loads(f.read())
        parts = [_Part(x["file"], at, min(at + SPLIT_BYTES, x["size"])) for x in files if x["records"] for at in range(0, x["size"], SPLIT_BYTES)]
        return parts or [_Part("", 0, 0)]

    def read(self, part):
        if not part.file:
            return
        fs, root = _open_fs(self.path)
        with fs.open_input_stream(f"{root}/{part.file}{INDEX}", compression=None) as f:
            starts = np.frombuffer(f.read(), "<i8")
        own = starts[: np.searchsorted(starts[:-1], part.end) + 1]
        own = own[np.searchsorted(own, part.start) :]  # records that start in this part, and where the last one ends
        with fs.open_input_file(f"{root}/{part.file}") as f:
            stretch = _Stretch(f)
            stretch.limit = int(own[-1]) if len(own) else 0
            for start, end in zip(own[:-1].tolist(), own[1:].tolist()):
                row, kept = {}, False

                def wanted(head):
                    nonlocal row, kept
                    h = _headers(head)
                    row = {"page_id": _page(h["WARC-Record-ID"]), "url": _unclean(h["WARC-Target-URI"]), "record_type": h["WARC-Type"], "refers_to": _page(h.get("WARC-Refers-To")), "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": int(h["X-Payload-Length"])}
                    kept = all(row[c] in values for c, values in self.filters)
                    return kept and self.payload and row["record_type"] == "response"

                block = _inflated(stretch, start, end, wanted)
                if kept:
                    payload = None
                    if block is not None:
                        payload = block[:-4].split(b"\r\n\r\n", 1)[1]
                        if digest_of(payload) != row["payload_digest"] or len(payload) != row["payload_bytes"]:
                            raise ValueError(f"record of page {row['page_id']}: the payload doesn't match its header")
                    yield (*row.values(), payload)


class WarcSource(DataSource):
    """Options: path; payload ("true", the default, or "false": payloads are never decoded)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: of pages with equal payloads of least_bytes or more, all but the smallest page_id refer to it.

    Counts and smallest ids are aggregated per digest before anything is joined, so a payload that a third of all
    pages share costs one row per task; the join back keeps only digests that several pages have.
    """
    size = F.octet_length(F.coalesce("html", F.lit("")))
    rows = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    # stored before the join, so both of its sides are plain exchanges, and a frequent digest's can be split
    shared = stored(rows.where((size >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "shared-payloads")
    return rows.join(shared, "digest", "left").select("page_id", "url", "html", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = new_path(spark, "warc")
    with_revisits(table(spark, sf_dir, "pages")).write.format("warc").option("path", path).mode("append").save()
    back = lambda: spark.read.format("warc").option("path", path).load()  # noqa: E731  a scan of its own for each predicate
    read = [back().where(F.col("record_type") == kind).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") for kind in ("response", "revisit")]
    return read[0].unionByName(read[1])


OP8_SQL = """
WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY sha1(b)) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM s
"""
