"""WARC archives with revisit resolution: one response for each payload, later captures refer to it."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryscope.llm.common import octets, open_fs, putting, scratch, sendable, stored

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's namespace for URLs
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2020-01-01T00:00:00Z"  # pages carry no capture time


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", "", url or "") or "urn:x-no-uri"


def _member(raw: bytes) -> bytes:
    """A gzip member of its own, so that records can be read singly; no time stamp, so that reruns agree."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def response(page_id, url: str | None, payload: bytes, digest: str) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", _DATE), ("WARC-Target-URI", _uri(url)), ("X-Page-ID", str(page_id)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block) + len(payload)))]
    return _member(b"".join((_header(head), block, payload, b"\r\n\r\n")))


def revisit(page_id, url: str | None, digest: str, size: int, refers_to) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", _DATE), ("WARC-Target-URI", _uri(url)), ("X-Page-ID", str(page_id)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _member(_header(head) + block + b"\r\n\r\n")


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip archive; a cut record is an error."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    while first := f.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError("not a WARC record")
        head = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        block = f.read(int(head["Content-Length"]))
        if len(block) < int(head["Content-Length"]) or f.read(4) != b"\r\n\r\n":
            raise ValueError("cut WARC record")
        yield head, block


def write_archives(pages: DataFrame, least_bytes: int = 100, folder: str | None = None, archive_bytes: int = 1 << 30) -> DataFrame:
    """Write one record for each row of ``pages`` (page_id, url, html) and return the manifest (path string, n long).

    Revisits are resolved on headers alone: (page_id, digest) are shuffled by digest, as grouped minima combined
    beforehand, so that a payload that a third of all pages share costs one row. Pages with a payload of at least
    ``least_bytes`` that is not the smallest page_id of its digest become revisits with fresh headers and no body; what
    they refer to is joined to the pages where these lie, unless the revisits are too many to send. Records go to the
    archive as they are made; a task begins a new archive after ``archive_bytes``. Null html is an empty payload. Rows
    that repeat a page_id give a record each: those with the smallest id of a payload are all responses. Null ids are
    always responses. A missing url becomes a placeholder URI; further columns are left out.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    body = F.coalesce(F.col("html"), F.lit(""))
    digest = F.sha2(body.cast("binary"), 256)
    heads = pages.where((F.octet_length(body) >= least_bytes) & F.col("page_id").isNotNull()).select(F.col("page_id").alias("p"), digest.alias("d"))
    heads = stored(heads, "headers")
    originals = heads.groupBy("d").agg(F.min("p").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = sendable(stored(heads.join(originals, "d").where("p <> first_id").distinct(), "revisits"))
    decided = pages.select("page_id", "url", "html", digest.alias("digest"))
    decided = decided.join(again, (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "digest", "first_id")

    def records(batches) -> Iterator[bytes]:
        for b in batches:
            for s in range(0, b.num_rows, 200):
                part = b.slice(s, 200)
                ids, urls, bodies, digests, firsts = part.column(0).to_pylist(), part.column(1).to_pylist(), octets(part.column(2)), part.column(3).to_pylist(), part.column(4).to_pylist()
                for page_id, url, payload, hexed, first_id in zip(ids, urls, bodies, digests, firsts, strict=True):
                    yield response(page_id, url, payload, hexed) if first_id is None else revisit(page_id, url, hexed, len(payload), first_id)

    def write(batches):
        todo, k = records(batches), 0
        record = next(todo, None)
        while record is not None:
            path = f"{folder}/archive-{TaskContext.get().partitionId():06d}-{k:04d}.warc.gz"
            info = _member(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(path.rpartition("/")[2])), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", "0")]) + b"\r\n\r\n")
            n, size = 0, 0
            with putting(path) as out:
                out.write(info)
                while record is not None and size < archive_bytes:
                    out.write(record)
                    n, size = n + 1, size + len(record)
                    record = next(todo, None)
            yield pa.RecordBatch.from_pydict({"path": [path], "n": pa.array([n], pa.int64())})
            k += 1

    return stored(decided.mapInArrow(write, "path string, n long"), "archives")


def read_archives(manifest: DataFrame, page_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri) of all records but warcinfo.

    A response's digest and size are computed from the payload read; a revisit's are those of its header, which name the
    payload of the response that it refers to.
    """
    paths = manifest.select("path").repartition(max(1, manifest.count()), "path")

    def run(batches):
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())])
        number = lambda x: None if x in (None, "None") else int(x)
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = open_fs(path)
                with fs.open_input_stream(at, compression=None) as f:
                    out = []
                    for head, block in read_archive(f):
                        if len(out) == 5000:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out = []
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        fields, _, payload = block.partition(b"\r\n\r\n")
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        size = int(re.search(rb"Content-Length: (\d+)", fields)[1])
                        if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError("payload and digest differ")
                        out.append({"page_id": number(head["X-Page-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": number(head.get("X-Refers-To-Page")), "target_uri": head["WARC-Target-URI"]})
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return paths.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")
