"""WARC archives and revisit resolution.

``write_archives`` streams each partition into gzip-per-record archives in the
shared folder and returns one header row per record (no payload).
``plan_revisits`` shuffles those headers by payload digest: the record with the
largest key of a digest is the response, the others are joined to it.
``rewrite`` streams every archive once more into a deduplicated one with fresh
headers, in which revisits carry no payload.  ``read_archives`` streams archives
back and checks digests; ``resolved`` joins revisits to their responses.
Payloads are never shuffled.

Archives are written under an attempt's own name and then renamed, so a task
that runs again puts the same archive in place; header tables are written too.

Defined cases: a null payload is empty and a null url has no target URI;
payloads shorter than ``min_bytes`` are all responses; of repeated rows with the
same key and payload one is the response and the others revisit it; a null key
sorts below all others and comes back as null; an empty table gives no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import fresh_path, map_arrow, table, written

#: Payload bytes and records after which a task starts its next archive.
ROLL_BYTES, ROLL_RECORDS = 64 << 20, 20_000
#: Most tasks that archives are dealt to; a task takes several beyond that.
MOST_TASKS = 100_000
DATE = "2024-01-01T00:00:00Z"
READ_BYTES = 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

HEADS = "path string, ordinal int, record_id string, key long, uri string, digest string, n_bytes long"
RECORDS = ("record_id string, record_type string, key long, uri string, payload_digest string, payload_bytes long, "
           "refers_to_id string, payload binary")


def filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, fields: list[tuple[str, object]], body: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    lines += [f"{k}: {str(v).translate({10: '%0A', 13: '%0D'})}" for k, v in fields if v is not None]
    head = "\r\n".join([*lines, f"Content-Length: {len(body)}"]) + "\r\n\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", 6, mtime=0)


def parse_stream(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record of a file of gzip members; one is in memory at a time."""
    raw = b""
    while True:
        out, d = bytearray(), zlib.decompressobj(31)
        while not d.eof:
            raw = raw or stream.read(READ_BYTES)
            if not raw:
                break
            out += d.decompress(raw)
            raw = d.unused_data
        if not out:
            return
        head, _, rest = bytes(out).partition(b"\r\n\r\n")
        fields = dict(line.partition(": ")[::2] for line in head.decode().split("\r\n")[1:])
        fields["WARC-Version"] = head[:8].decode()
        n = int(fields["Content-Length"])
        if len(rest) != n + 4:
            raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut off")
        yield fields, rest[:n]


class ArchiveWriter:
    """One archive, visible under its name only when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, at = filesystem(folder)
        self.fs.create_dir(at, recursive=True)
        self.final, self.tmp = f"{at}/{name}", f"{at}/_{uuid.uuid4().hex}.part"
        self.path = f"{folder}/{name}"
        self.out = self.fs.open_output_stream(self.tmp)
        self.n_records = self.n_bytes = 0

    def write(self, data: bytes, payload_bytes: int) -> None:
        self.out.write(data)
        self.n_records += 1
        self.n_bytes += payload_bytes

    def close(self) -> None:
        self.out.close()
        if self.fs.get_file_info(self.final).type.name != "NotFound":
            self.fs.delete_file(self.final)
        self.fs.move(self.tmp, self.final)


def _record_id(name: str, ordinal: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{ordinal}')}>"


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive every row as a response; the headers as a written table."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    roll_bytes, roll_records = ROLL_BYTES, ROLL_RECORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_files, writer, heads = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                for k, uri, text in zip(*(c.to_pylist() for c in piece.columns)):
                    payload = (text or "").encode()
                    if writer is None:
                        name = f"part-{part:06d}-{n_files:04d}.warc.gz"
                        writer, n_files = ArchiveWriter(folder, name), n_files + 1
                    rid, digest = _record_id(name, writer.n_records), digest_of(payload)
                    heads.append((writer.path, writer.n_records, rid, k, uri, digest, len(payload)))
                    writer.write(record_bytes("response", [
                        ("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("X-Page-ID", k),
                        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
                    ], HTTP + payload), len(payload))
                    if writer.n_bytes >= roll_bytes or writer.n_records >= roll_records:
                        writer.close()
                        writer = None
            if heads and writer is None or len(heads) >= 50_000:
                yield _table(heads, HEADS)
                heads = []
        if writer is not None:
            writer.close()
        if heads:
            yield _table(heads, HEADS)

    rows = pages.select(pages[key].cast("long").alias("key"), pages[url].alias("url"), pages[html].alias("html"))
    return written(map_arrow(rows, run, HEADS), "warc-heads")


TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _table(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in ddl.split(",")]
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def plan_revisits(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(path, ordinal, refers_to_id, refers_uri) of the records to become revisits."""
    able = heads.filter(F.col("n_bytes") >= min_bytes)
    best = (able.groupBy("digest").agg(F.max(F.struct("key", "record_id", "uri")).alias("top"), F.count(F.lit(1)).alias("copies"))
            .filter("copies > 1").select("digest", "top"))
    return (able.join(best, "digest").filter(F.col("record_id") != F.col("top.record_id"))
            .select("path", "ordinal", F.col("top.record_id").alias("refers_to_id"), F.col("top.uri").alias("refers_uri")))


def one_to_a_task(archives: DataFrame) -> DataFrame:
    """The rows of a written table of distinct paths, each to a task of its own.

    Ranges of the path cannot collide as hashes do, and AQE leaves a stated number
    of partitions alone, however few bytes the rows have."""
    return archives.repartitionByRange(min(max(1, archives.count()), MOST_TASKS), "path")


def rewrite(heads: DataFrame, revisits: DataFrame) -> DataFrame:
    """Write the deduplicated archives; (path, n_records) of each, as a written table.

    A task gets whole archives; the decisions of one archive are bounded by
    ROLL_RECORDS.
    """
    spark = heads.sparkSession
    folder = fresh_path(spark, "warc-dedup")
    todo = heads.select("path", F.lit(None).cast("struct<ordinal:int,id:string,uri:string>").alias("d")).distinct().unionByName(
        revisits.select("path", F.struct("ordinal", F.col("refers_to_id").alias("id"), F.col("refers_uri").alias("uri")).alias("d")))
    todo = written(todo.groupBy("path").agg(F.collect_list("d").alias("d")), "warc-decisions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, decisions in zip(batch.column(0).to_pylist(), batch.column(1)):
                refers = {d["ordinal"]: (d["id"], d["uri"]) for d in decisions.as_py()}
                fs, at = filesystem(path)
                writer = ArchiveWriter(folder, path.rpartition("/")[2])
                with fs.open_input_stream(at, compression=None) as stream:
                    for i, (h, body) in enumerate(parse_stream(stream)):
                        same = [(k, h.get(k)) for k in ("WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "X-Page-ID", "WARC-Payload-Digest", "Content-Type")]
                        if i in refers:
                            rid, uri = refers[i]
                            http, _, _ = body.partition(b"\r\n\r\n")
                            data = record_bytes("revisit", [
                                *same, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                                ("WARC-Refers-To", rid), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", DATE)], http + b"\r\n\r\n")
                        else:
                            data = record_bytes("response", same, body)
                        writer.write(data, len(body))
                writer.close()
                yield _table([(writer.path, writer.n_records)], "path string, n_records long")

    return written(map_arrow(one_to_a_task(todo), run, "path string, n_records long"), "warc-manifest")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """RECORDS of the archives named in the column path, by the tasks that hold the rows; digests of responses are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for h, body in parse_stream(stream):
                        payload = body.partition(b"\r\n\r\n")[2]
                        kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and digest_of(payload) != digest:
                            raise ValueError(f"payload digest of {h['WARC-Record-ID']} differs")
                        rows.append((h["WARC-Record-ID"], kind, int(h["X-Page-ID"]) if "X-Page-ID" in h else None, h.get("WARC-Target-URI"),
                                     digest, len(payload) if kind == "response" else None, h.get("WARC-Refers-To"), payload if payloads else None))
                        held += len(payload) if payloads else 200
                        if held > 4 << 20:
                            yield _table(rows, RECORDS)
                            rows, held = [], 0
                if rows:
                    yield _table(rows, RECORDS)

    return map_arrow(archives.select("path"), run, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the length and key of the response that revisits refer to."""
    responses = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("_rid"), F.col("payload_bytes").alias("_n"), F.col("key").alias("_key"), F.col("payload_digest").alias("_digest"))
    cols = ["record_id", "key", "uri", "payload_bytes", "payload_digest", "record_type"]
    own = records.filter("record_type = 'response'").select(*cols, F.lit(None).cast("long").alias("refers_to"))
    found = records.filter("record_type = 'revisit'").join(responses, F.col("refers_to_id") == F.col("_rid")).select(
        "record_id", "key", "uri", F.col("_n").alias("payload_bytes"), "payload_digest", "record_type", F.col("_key").alias("refers_to"))
    return own.unionByName(found)


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Archive pages, resolve revisits and return the path and size of each deduplicated archive."""
    heads = write_archives(pages, key, url, html)
    return rewrite(heads, plan_revisits(heads, min_bytes))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = archive_pages(table(spark, sf_dir, "pages"))
    records = written(read_archives(one_to_a_task(archives)).drop("payload"), "warc-records")
    return resolved(records).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "uri")
