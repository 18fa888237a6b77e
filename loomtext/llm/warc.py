"""WARC archives: one gzip member per record, written with revisit records and read back sequentially."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import Hot, Workspace, materialize, merge_levels, salt_of, salts_for, scratch, tidy

ARCHIVE_BYTES = 32 << 20
READ_BYTES = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: object, is_revisit: bool, digest: str) -> str:
    """The same for the same page, kind and payload, so that a revisit can name its response without seeing it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{is_revisit}|{digest}')}>"


def record(page_id: object, url: str | None, payload: bytes, revisit_of: object, is_revisit: bool, date: str) -> bytes:
    """One record as one gzip member. A revisit keeps the HTTP head, and so the payload's length, but no body."""
    digest = base32_sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    name = record_id(page_id, is_revisit, digest)
    fields = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", name), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if page_id is not None:
        fields.append(("X-Page-Id", quote(str(page_id), safe="")))
    if is_revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(revisit_of, False, digest))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


class Broken(ValueError):
    """An archive that does not follow the format, or a digest that does not hold."""


def members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as pieces of its content; what a caller leaves unread is skipped."""
    left = b""

    def pieces() -> Iterator[bytes]:
        nonlocal left
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof:
            raw = unpacker.unconsumed_tail or left or stream.read(READ_BYTES)
            left = b""
            if not raw:
                raise Broken("the archive ends within a member")
            if out := unpacker.decompress(raw, READ_BYTES):
                yield out
        left = unpacker.unused_data

    while True:
        left = left or stream.read(READ_BYTES)
        if not left:
            return
        member = pieces()
        yield member
        for _ in member:
            pass


def parse(pieces: Iterator[bytes]) -> Record:
    """One record: head up to a blank line, Content-Length bytes of block, two line ends and nothing more."""
    held = b""
    while b"\r\n\r\n" not in held:
        if (more := next(pieces, None)) is None:
            raise Broken("the record ends within its head")
        held += more
    head, _, rest = held.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise Broken(f"not a record: {first[:40]}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    want, parts, have = int(fields["content-length"]) + 4, [rest], len(rest)
    for more in pieces:
        parts.append(more)
        have += len(more)
    if have != want:
        raise Broken(f"{have - 4} bytes of block where {want - 4} are declared")
    whole = b"".join(parts)
    if whole[-4:] != b"\r\n\r\n":
        raise Broken("the record does not end in two line ends")
    return Record(fields, whole[:-4])


def verified(found: Record) -> tuple[int, str]:
    """Length and digest of the full payload; of others than revisits both are computed and compared.

    A revisit declares both; :func:`read` compares them with those of the response that it refers to.
    """
    declared = found.fields["warc-payload-digest"].removeprefix("sha1:")
    if base32_sha1(found.block) != found.fields["warc-block-digest"].removeprefix("sha1:"):
        raise Broken("the block digest does not hold")
    http = found.block.partition(b"\r\n\r\n")[0].decode()
    length = int(re.search(r"(?im)^content-length:\s*(\d+)", http)[1])
    if found.fields["warc-type"] == "revisit":
        return length, declared
    if base32_sha1(found.payload) != declared or len(found.payload) != length:
        raise Broken("the payload digest or length does not hold")
    return length, declared


def mark_revisits(
    pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", html_col: str = "html", url_col: str = "url"
) -> DataFrame:
    """page_id, url, payload, is_revisit, refers_to: of equal payloads the largest id is the response."""
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.withColumn("_digest", F.concat_ws("/", F.sha2("payload", 256), F.length("payload").cast("string")))
    ids = materialize(rows.select("_digest", F.col("page_id").alias("response_id")), "payloads")
    salts = salts_for(ids.count())
    ids = ids.withColumn("_salt", salt_of("response_id", salts))
    first, last = merge_levels(ids, "_digest", lambda: [F.max("response_id").alias("response_id")], salts)
    known = rows.withColumn("_salt", salt_of("page_id", salts))
    known = known.join(first.select("_digest", "_salt").join(last, "_digest"), ["_digest", "_salt"])
    revisit = (F.length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return known.select("page_id", "url", "payload", revisit.alias("is_revisit"), F.when(revisit, F.col("response_id")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, **columns: str) -> DataFrame:
    """Write archives into ``folder`` (default: a new one in the shared folder); returns their manifest.

    Each task starts a new archive when one reaches ``archive_bytes``. Archive names hold the task attempt, and
    only the manifest, which Spark commits, says which archives count: an attempt that fails or loses a race
    leaves an unlisted file, never half of a listed one.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, sink, done, n, size = TaskContext.get(), None, [], 0, 0
        for batch in batches:
            for step in range(0, batch.num_rows, 64):
                for r in batch.slice(step, 64).to_pylist():
                    if sink is None:
                        path = f"{root}/part-{task.partitionId():05d}-{len(done):04d}-{task.taskAttemptId()}.warc.gz"
                        sink, n, size = store.open_output_stream(path, compression=None), 0, 0
                    raw = record(r["page_id"], r["url"], r["payload"], r["refers_to"], r["is_revisit"], date)
                    sink.write(raw)
                    n, size = n + 1, size + len(raw)
                    if size >= archive_bytes:
                        sink.close()
                        sink = done.append((path, n, size))
        if sink is not None:
            sink.close()
            done.append((path, n, size))
        names = [f"{folder}/{p.rsplit('/', 1)[1]}" for p, _, _ in done]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["archive", "n_records", "n_bytes"])

    marked = mark_revisits(pages, least_bytes, **columns)
    return materialize(marked.mapInArrow(run, "archive string, n_records long, n_bytes long"), "manifest", 500)


def read(
    spark: SparkSession, manifest: DataFrame, with_payload: bool = False, slices: int | None = None, id_type: str = "long"
) -> DataFrame:
    """The records of the listed archives: page_id, url, record_type, payload_bytes, payload_digest, refers_to.

    Archives are read front to back in pieces of 64 KB, one record in memory at a time. refers_to is the page of
    the record whose WARC-Record-ID a revisit's WARC-Refers-To names. A framing error, a digest that does not
    hold, a count that differs from the manifest, a revisit whose response is in none of the archives, or one
    whose payload digest or length differs from its response's fails the job.
    """
    names = ["page", "url", "record_type", "payload_bytes", "payload_digest", "record_id", "refers"] + ["payload"] * with_payload
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()][: len(names)]
    schema = "page string, url string, record_type string, payload_bytes long, payload_digest string, record_id string, refers string"
    schema += ", payload binary" * with_payload

    def rows(archive: str, n_records: int) -> Iterator[tuple]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(archive)
        seen = 0
        with store.open_input_stream(path, compression=None) as stream:
            for member in members(stream):
                found = parse(member)
                length, digest = verified(found)
                field, seen = found.fields.get, seen + 1
                page = field("x-page-id")
                out = (None if page is None else unquote(page), field("warc-target-uri"), field("warc-type"), length, digest)
                out = (*out, field("warc-record-id"), field("warc-refers-to"))
                yield (*out, found.payload) if with_payload else out
        if seen != n_records:
            raise Broken(f"{archive} holds {seen} records, not {n_records}")

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                held: list[tuple] = []
                for row in rows(r["archive"], r["n_records"]):
                    held.append(row)
                    if len(held) >= (64 if with_payload else 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    spread = manifest.repartition(slices or int(spark.conf.get("spark.sql.shuffle.partitions")), "archive")
    found = materialize(spread.select("archive", "n_records").mapInArrow(run, schema), "records")
    out = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * with_payload
    found = found.withColumn("page_id", F.col("page").cast(id_type))
    plain = found.filter("refers IS NULL").withColumn("refers_to", F.lit(None).cast(id_type)).select(*out)
    # pages that repeat an identifier and a payload are one record written twice
    known = found.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"),
        F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"),
    ).dropDuplicates(["refers"])
    again = found.filter("refers IS NOT NULL")
    hot = Hot(again.groupBy("refers").agg(F.count("*").alias("n")), ["refers"])
    met = hot.join(again, known, ["record_id"], "left")
    same = F.col("_digest").eqNullSafe(F.col("payload_digest")) & F.col("_bytes").eqNullSafe(F.col("payload_bytes"))
    said = F.concat(F.lit("no response with the payload of revisit "), F.col("record_id"))
    met = met.withColumn("refers_to", F.when(same, F.col("refers_to")).otherwise(F.raise_error(said).cast(id_type)))
    return plain.unionByName(met.select(*out))


def round_trip(pages: DataFrame, least_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Write a record per page, then read the archives back.

    A null page is an empty payload; null ids and urls are left out of the record and read back as null. A
    null id never is what others refer to, unless its group has only null ids, which then are all responses.
    Rows that repeat the largest id of a group are all responses. An empty table gives an empty one. Only the
    three named columns are read, so others cannot clash. Identifiers may be of any type that casts to a string
    and back. Pages of any length are written and read whole, one record in memory at a time. Ties do not occur:
    rows that repeat a page and a payload are one record written twice, under one record id.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    return read(pages.sparkSession, write(pages, least_bytes=least_bytes), with_payload, id_type=kind)
