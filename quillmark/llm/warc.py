"""WARC archives as a Spark data source: a writer of gzip members, and a reader that splits archives at any byte.

A record is a gzip member of its own. A reading task takes a range of bytes, looks for gzip's magic number in it, takes a place for a record
if the member there begins with a WARC header and decodes to its end with the lengths that it states, and owns the records that begin in its
range; from the first of them on, each record begins where the one before ends.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quillmark.llm.common import quoted, written

#: The first bytes of a gzip member that is deflated, versions, the profile of a revisit, and the header of a page's block.
MAGIC = b"\x1f\x8b\x08"
VERSIONS = (b"WARC/1.1", b"WARC/1.0")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Bytes of a range, of a file that the writer closes, of one read, and of the longest header that counts as one.
RANGE, FILE, CHUNK, HEADER = 64 << 20, 1 << 30, 1 << 18, 1 << 24
#: Rows and payload bytes of a batch that a reading task gives out.
ROWS, BYTES = 1000, 8 << 20

WRITTEN = "record_id string, uri string, record_type string, refers_to string, payload binary, payload_bytes long, payload_sha1 string"
READ = "path string, start long, length long, record_type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that tasks open a path in, and the path there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


# --- writing


def member(parts: list[bytes]) -> Iterator[bytes]:
    """A gzip member. The magic number never stands in it as it stood in a part: the stream is flushed inside each, for a block that is stored as it is would show it to readers."""
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    for part in parts:
        at = 0
        while (found := part.find(MAGIC, at)) >= 0:
            yield out.compress(part[at : found + 1])
            yield out.flush(zlib.Z_SYNC_FLUSH)
            at = found + 1
        yield out.compress(part[at:] if at else part)
    yield out.flush()


def header_value(text: str) -> str:
    """Without what would end a header's line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(row: dict, date: str) -> list[bytes]:
    """A row as a record: header, block, end."""
    digest = base64.b32encode(bytes.fromhex(row["payload_sha1"])).decode()
    http = PAGE % row["payload_bytes"]
    payload = (row["payload"] or b"") if row["record_type"] == "response" else b""
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{header_value(row['record_id'])}>"), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", header_value(row["uri"] or row["record_id"])), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if row["record_type"] == "revisit":
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{header_value(row['refers_to'])}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    return [VERSIONS[0] + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http, payload, b"\r\n\r\n"]


def info(name: str, date: str) -> list[bytes]:
    block = b"software: quillmark\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\n"
    return [f"{head}Content-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"]


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class Writer(DataSourceArrowWriter):
    """Each task writes files of its own; only those of tasks that succeeded are listed in the folder, so what a lost one leaves is never read."""

    def __init__(self, options: dict):
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")
        self.most = int(options.get("file_bytes", FILE))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size >= self.most:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                        for piece in member(info(names[-1], self.date)):
                            out.write(piece)
                    for piece in member(record(row, self.date)):
                        out.write(piece)
                        size += len(piece)
        finally:
            if out is not None:
                out.close()
        return Files(names)

    def commit(self, messages: list[Files | None]) -> None:
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        names = [n for m in messages if m for n in m.names]
        with system.open_output_stream(f"{folder}/_files-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[Files | None]) -> None:
        system, folder = located(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.delete_file(f"{folder}/{name}")


# --- reading


def member_chunks(f: pa.NativeFile, at: int, size: int) -> Iterator[tuple[bytes, int]]:
    """What the gzip member at a place decodes to, in bounded pieces, each with the place where the member ends once that is known, else -1. zlib.error if it is none."""
    d = zlib.decompressobj(31)
    f.seek(at)
    while not d.eof:
        data = f.read(min(CHUNK, size - at))
        if not data:
            raise zlib.error("cut off")
        at += len(data)
        while data and not d.eof:
            out = d.decompress(data, CHUNK)
            data = d.unconsumed_tail
            yield out, at - len(d.unused_data) if d.eof else -1


def fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; lines that go on are joined."""
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def record_at(f: pa.NativeFile, at: int, size: int, payload: bool) -> tuple[dict, int] | None:
    """(record, where it ends) if one begins there. No more of it is held than its headers, and the payload where asked for."""
    buffer, head, http, kept, end = b"", None, None, [], -1
    sha, n, left = hashlib.sha1(), 0, 0
    try:
        for out, end in member_chunks(f, at, size):
            buffer += out
            if head is None:
                if not buffer.startswith(VERSIONS) and len(buffer) >= len(VERSIONS[0]):
                    return None
                if (cut := buffer.find(b"\r\n\r\n")) < 0:
                    if len(buffer) > HEADER:
                        return None
                    continue
                head, buffer = fields(buffer[:cut]), buffer[cut + 4 :]
                if not head.get("content-length", "").isdecimal():
                    return None
                left = int(head["content-length"])
                http = None if head.get("content-type", "").startswith("application/http") else b""
            if http is None:
                cut = buffer.find(b"\r\n\r\n", 0, left)
                if cut < 0 and len(buffer) < min(left, HEADER):
                    continue
                cut = cut + 4 if cut >= 0 else 0  # a block that is no HTTP is all payload
                http, buffer, left = buffer[:cut], buffer[cut:], left - cut
            part, buffer = buffer[:left], buffer[left:]
            left -= len(part)
            n += len(part)
            sha.update(part)
            if payload:
                kept.append(part)
            if len(buffer) > 4:
                return None
    except zlib.error:
        return None
    if head is None or left or buffer != b"\r\n\r\n":
        return None
    return described(head, http or b"", sha.digest(), n, b"".join(kept) if payload else None), end


def described(head: dict[str, str], http: bytes, sha1: bytes, n: int, payload: bytes | None) -> dict:
    kind, stated = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    digest, error = base64.b32encode(sha1).decode(), None
    if kind == "revisit":  # what isn't there is told by the headers
        digest, told = stated, fields(http).get("content-length", "")
        n, payload = int(told) if told.isdecimal() else None, None
    elif stated and stated != digest and kind == "response":
        error = "digest_mismatch"
    bare = lambda k: head[k].removeprefix("<").removesuffix(">") if k in head else None
    return {
        "record_type": kind, "record_id": bare("warc-record-id"), "uri": bare("warc-target-uri"), "refers_to": bare("warc-refers-to"),
        "payload_digest": digest, "payload_bytes": n, "payload": payload, "error": error,
    }


def candidates(f: pa.NativeFile, start: int, end: int, size: int) -> Iterator[int]:
    """Places of the magic number from start on, before end."""
    at = start
    while at < end:
        f.seek(at)
        data = f.read(min(CHUNK + len(MAGIC) - 1, size - at))
        found = -1
        while (found := data.find(MAGIC, found + 1)) >= 0 and found < CHUNK and at + found < end:
            yield at + found
        at += CHUNK


def records(f: pa.NativeFile, size: int, start: int, end: int, payload: bool = False) -> Iterator[dict]:
    """Records that begin from start on, before end. Where one should begin and none does, there is a row with the error `damaged`, from the
    task that read the record before, and reading goes on with the next place that holds one."""
    end = min(end, size)
    at = start if start == 0 else None
    found = None
    if at is None:
        for at in candidates(f, start, end, size):
            if found := record_at(f, at, size, payload):
                break
        else:
            return
    while at < size:
        found = found or record_at(f, at, size, payload and at < end)
        if at >= end and found:
            return
        if found:
            yield {"start": at, "length": found[1] - at, **found[0]}
            at, found = found[1], None
            continue
        yield {"start": at, "error": "damaged"}
        for at in candidates(f, at + 1, end, size):
            if found := record_at(f, at, size, payload):
                break
        else:
            return


@dataclass
class Range(InputPartition):
    path: str
    size: int
    start: int
    end: int

    def __hash__(self) -> int:
        return hash((self.path, self.start))


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("range_bytes", RANGE))
        self.payload = options.get("payload", "true").lower() == "true"

    def partitions(self) -> list[Range]:
        system, folder = located(self.path)
        there = system.get_file_info(folder)
        if there.type == fs.FileType.File:
            files = [there]
        else:
            inside = system.get_file_info(fs.FileSelector(folder, recursive=True))
            lists = [i.path for i in inside if i.base_name.startswith("_files-")]
            listed = {n for p in lists for n in json.loads(system.open_input_file(p).read())}
            files = [i for i in inside if i.base_name.endswith(".warc.gz") and (not lists or i.base_name in listed)]
        out = [Range(i.path, i.size, at, at + self.step) for i in sorted(files, key=lambda i: i.path) for at in range(0, i.size, self.step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.size:
            return
        system = located(self.path)[0]
        rows, held = [], 0
        names = [c.split()[0] for c in READ.split(", ") if self.payload or not c.startswith("payload binary")]
        kinds = {"start": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names=names)
        with system.open_input_file(part.path) as f:
            for r in records(f, part.size, part.start, part.end, self.payload):
                rows.append({"path": part.path, **r})
                held += len(r.get("payload") or b"")
                if len(rows) >= ROWS or held >= BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class Archive(DataSource):
    """format("warc"): save(path) with options date and file_bytes; load(path), a file or folder, with options range_bytes and payload (false: without that column)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ if self.options.get("payload", "true").lower() == "true" else READ.replace("payload binary, ", "")

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("archives are only added to")
        return Writer(dict(self.options))


# --- pages as records


def records_of(pages: DataFrame, *, id: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """A record (columns of WRITTEN) for each page: of pages with one payload of at least `least` bytes, that of the largest id is the response and
    the others are revisits of it; pages with smaller ones are all responses.

    Null payloads are empty, null ids the smallest, and of equal ids that with the greatest address is the response; of wholly equal rows any one is.
    Each row has a record; record ids are `urn:page:<id>:<digest>`, and no two are the same. Other columns are ignored. Keys are
    shuffled, and each different payload once: equal ones become one before that.
    """
    body = F.coalesce(F.col(quoted(payload)).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(quoted(id)).cast("string").alias("name"), F.col(quoted(id)).alias("id"), F.col(quoted(uri)).cast("string").alias("uri"), body.alias("payload"))
    # rows that are wholly equal are told apart by where they are read and a number; keys are written, so that there is one answer to that
    rows = rows.withColumns({"sha": F.sha2("payload", 256), "sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    keys = ("sha", "sha1", "size", "id", "uri", "name", "spot")
    groups = written(rows.withColumn("spot", F.spark_partition_id()).groupBy(*keys).agg(F.count("*").cast("int").alias("n"))).withColumn("own", F.struct("id", "uri", "spot", "name"))
    best = groups.where(F.col("size") >= least).groupBy(F.col("sha").alias("of")).agg(F.max("own").alias("best"))
    each = groups.join(best, F.col("sha") == F.col("of"), "left").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    record_id = lambda w, k: F.concat(F.lit("urn:page:"), F.coalesce(w["name"], F.lit("")), F.lit(":"), F.md5(F.to_json(F.struct(w["uri"].alias("u"), w["spot"].alias("p"), k.alias("k"), "sha"))))
    again = F.col("best").isNotNull() & ~(F.col("own").eqNullSafe(F.col("best")) & (F.col("k") == 0))
    each = each.withColumns({"record_id": record_id(F.col("own"), F.col("k")), "refers_to": F.when(again, record_id(F.col("best"), F.lit(0)))})
    told = lambda df, kind, body: df.select("record_id", "uri", F.lit(kind).alias("record_type"), "refers_to", body.alias("payload"), F.col("size").alias("payload_bytes"), F.col("sha1").alias("payload_sha1"))
    bodies = rows.groupBy(F.col("sha").alias("of")).agg(F.any_value("payload").alias("payload"))
    responses = told(each.where("refers_to is null").drop("of").join(bodies, F.col("sha") == F.col("of")), "response", F.col("payload"))
    return responses.unionByName(told(each.where("refers_to is not null"), "revisit", F.lit(None).cast("binary")))


def write(records: DataFrame, path: str, **options: object) -> None:
    """Rows of WRITTEN as archives in a folder that all executors share."""
    records.sparkSession.dataSource.register(Archive)
    records.select(*(c.split()[0] for c in WRITTEN.split(", "))).write.format("warc").mode("append").options(**options).save(path)


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Records (columns of READ) of the archives at a path."""
    spark.dataSource.register(Archive)
    return spark.read.format("warc").options(**options).load(path)
