"""WARC archives and the monolithic gzip normaliser.

`write_monolithic` writes one gzip stream per partition holding a WARC record
for every page.  `normalise` inflates each such stream once, rewrites every
record as a gzip member of its own, turns repeated payloads into revisit
records, and writes a sidecar index of member offsets.  `read_back` uses that
index alone: it seeks to each member and parses it.

Payload groups are found on digests without payloads; what a normaliser task
needs to know about its archive travels as one small row, so pages are never
shuffled.  Files lie in the shared folder; a retried task writes again under
the same name through a rename, so lost executors leave no half file behind.

Defined results: null html is an empty payload; of records with equal payloads
of at least `min_bytes` bytes those with the smallest id are responses (ids
that repeat tie; null ids order last); null urls are written as empty; other
columns are ignored; an empty table writes no record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .common import drop_scratch, materialize, scratch_path, texts

DATE = "1970-01-01T00:00:00Z"
_CHUNK = 1 << 20


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), unquote(urlparse(path).path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class _Published:
    """A file that appears under its name only when complete."""

    def __init__(self, path: str):
        self.fs, self.path = _filesystem(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.part, compression=None)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def _id_text(value) -> str:
    return "" if value is None else base64.urlsafe_b64encode(json.dumps(value).encode()).decode()


def _id_value(text: str):
    return json.loads(base64.urlsafe_b64decode(text)) if text else None


def record(fields: dict[str, str], payload: bytes) -> bytes:
    """One WARC/1.1 record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and content block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _clean(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one gzip stream (any number of members), inflated once in bounded pieces."""
    inflate, left, waiting = zlib.decompressobj(31), bytearray(), b""
    while True:
        at = left.find(b"\r\n\r\n")
        if at >= 0:
            head = bytes(left[:at])
            size = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
            end = at + 4 + size + 4
            if len(left) >= end:
                yield parse(bytes(left[:end]))
                del left[:end]
                continue
        if not waiting and not (waiting := stream.read(_CHUNK)):
            if left:
                raise ValueError(f"{len(left)} bytes after the last whole record")
            return
        left += inflate.decompress(waiting)
        waiting = b""
        if inflate.eof:
            waiting, inflate = inflate.unused_data, zlib.decompressobj(31)


def write_monolithic(pages: DataFrame, folder: str, *, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write every page as a response record of its partition's stream.

    Returns one row per page: archive, id, digest, size of the payload.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        with _Published(path) as out:
            squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
            batch = first
            while batch is not None:
                digests, sizes = [], []
                for page, at, body in zip(*(c.to_pylist() for c in batch.columns)):
                    sha = hashlib.sha256(body).hexdigest()
                    fields = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, _id_text(page))}>", "WARC-Date": DATE, "WARC-Target-URI": _clean(at), "WARC-Payload-Digest": f"sha256:{sha}", "X-Page": _id_text(page)}
                    out.write(squeeze.compress(record(fields, body)))
                    digests.append(sha)
                    sizes.append(len(body))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(sizes)), batch.column(0), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], ["archive", "page", "digest", "size"])
                batch = next(batches, None)
            out.write(squeeze.flush())

    return pages.select(F.col(id_col), F.col(url).cast("string"), texts(pages, payload)).mapInArrow(run, f"archive string, page {kind}, digest string, size long")


def revisits(written: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Archive, page and the page it repeats, for records whose payload has an earlier one."""
    big = written.where(F.col("size") >= min_bytes)
    order = F.struct(F.col("page").isNull().alias("n"), F.col("page").alias("v"))
    first = big.groupBy("digest").agg(F.min(order).alias("lo"), F.max(order).alias("hi")).where("lo < hi").select("digest", F.col("lo.v").alias("refers_to"))
    return big.join(first, "digest").where(~F.col("page").eqNullSafe(F.col("refers_to"))).select("archive", "page", "digest", "refers_to")


def normalise(written: DataFrame, repeats: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive record by record, one task an archive; returns archive, index and record count."""
    paths = written.select("archive").distinct()
    # Archives carry their partition's number, so each can have a task of its own; a key alone would leave
    # the number of tasks to the bytes of these small rows.
    number = F.regexp_extract("archive", r"part-(\d+)\.", 1).cast("int")
    archives = (paths.agg(F.max(number)).first()[0] or 0) + 1
    lists = repeats.groupBy("archive").agg(F.collect_list(F.struct("page", "digest", "refers_to")).alias("repeats"))
    work = paths.join(lists, "archive", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, lost in zip(*(c.to_pylist() for c in batch.columns)):
                refers = {(x["page"], x["digest"]): x["refers_to"] for x in lost or ()}
                name = os.path.basename(archive)
                fs, where = _filesystem(archive)
                target, count = f"{folder}/{name}", 0
                with fs.open_input_stream(where, compression=None) as source, _Published(target) as out, _Published(f"{folder}/{name}.idx") as index:
                    lines, offset = io.StringIO(), 0
                    for fields, body in records_of(source):
                        page = _id_value(fields["X-Page"])
                        del fields["Content-Length"]
                        key = (page, fields["WARC-Payload-Digest"].partition(":")[2])
                        if key in refers:
                            fields |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, _id_text(refers[key]))}>", "X-Refers-To-Page": _id_text(refers[key]), "X-Payload-Length": str(len(body))}
                            body = b""
                        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = squeeze.compress(record(fields, body)) + squeeze.flush()
                        out.write(member)
                        lines.write(json.dumps({"archive": target, "offset": offset, "length": len(member), "page": fields["X-Page"]}) + "\n")
                        offset, count = offset + len(member), count + 1
                    index.write(lines.getvalue().encode())
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([f"{target}.idx"]), pa.array([count], pa.int64())], ["archive", "index", "records"])

    return work.repartitionById(archives, number).mapInArrow(run, "archive string, index string, records long")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar indexes of a folder: archive, offset, length, page."""
    return spark.read.schema("archive string, offset long, length long, page string").json(f"{folder}/*.idx")


def read_back(index: DataFrame, kind: str, id_col: str = "page_id") -> DataFrame:
    """Read members by offset; one row per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            out = ([], [], [], [], [], [])
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != opened:
                    fs, where = _filesystem(archive)
                    source, opened = fs.open_input_file(where), archive
                source.seek(offset)
                fields, body = parse(zlib.decompress(source.read(length), 31))
                revisit = fields["WARC-Type"] == "revisit"
                sha = fields["WARC-Payload-Digest"].partition(":")[2]
                if not revisit and hashlib.sha256(body).hexdigest() != sha:
                    raise ValueError(f"{archive} at {offset}: the payload does not match its digest")
                row = (_id_value(fields["X-Page"]), int(fields["X-Payload-Length"]) if revisit else len(body), sha, fields["WARC-Type"], _id_value(fields["X-Refers-To-Page"]) if revisit else None, fields["WARC-Target-URI"])
                for c, v in zip(out, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], type=id_type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string()), pa.array(out[4], type=id_type), pa.array(out[5], pa.string())], [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    id_type = to_arrow_type(_parse_datatype_string(kind))
    return index.select("archive", "offset", "length").mapInArrow(run, f"`{id_col}` {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, url string")


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 100) -> tuple[str, DataFrame]:
    """Write, normalise and index the pages; returns the folder and its index."""
    spark = pages.sparkSession
    raw, folder = scratch_path(spark, "monolithic"), scratch_path(spark, "warc")
    written = materialize(write_monolithic(pages, raw, id_col=id_col, url=url, payload=payload), "written")
    done = normalise(written, revisits(written, min_bytes), folder).agg(F.sum("records")).first()[0]
    drop_scratch(spark, raw)
    if not done:
        return folder, spark.createDataFrame([], "archive string, offset long, length long, page string")
    return folder, read_index(spark, folder)


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 100) -> DataFrame:
    """Archive the pages, then one row per record as read back."""
    _, index = archive_pages(pages, id_col=id_col, url=url, payload=payload, min_bytes=min_bytes)
    return read_back(index, pages.schema[id_col].dataType.simpleString(), id_col)
