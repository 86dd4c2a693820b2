"""WARC archives compressed record by record with a Zstandard dictionary of their own.

Each archive begins with a skippable frame that holds the dictionary, built from a bounded sample
of the archive's own first records; every record is a frame of its own, so one can be read without
the others. Tasks write archives under names of their attempt, and a manifest, a table that Spark
commits, names those of the attempts that counted. Readers go by the manifest: what a lost or doubled
attempt has left beside is never read, and may be deleted.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactuslab.llm.common import discard, saved, shared_dir

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 16 << 10
#: Bytes of records at an archive's start that its dictionary is built from.
SAMPLE_BYTES = 1 << 20
#: Bytes of records, uncompressed, after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Names and sizes of archives, and the folder beside them that holds them.
MANIFEST, MANIFEST_NAME = "archive string, bytes long", "manifest"
#: Tasks that archives are read in, at most.
READ_TASKS = 20_000
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    text = record_id[len("<urn:page:") : -1] if record_id else "null"
    return None if text == "null" else int(text)


def _one_line(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record of a payload of size bytes. A revisit has the headers of the response, with its length, and no body."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_one_line(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from sample records: a trained one, or where they are too few or too alike for that, the records themselves."""
    pieces = [r[k : k + 2048] for r in records for k in range(0, len(r), 2048)]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, pieces)) // 8), pieces, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:size]


def _archives(records: Iterator[bytes], archive_bytes: int, sample_bytes: int, level: int) -> Iterator[Iterator[bytes]]:
    """The bytes of one archive after the other; holds no more records than the sample."""
    records = iter(records)
    held = next(records, None)
    while held is not None:

        def archive(first: bytes) -> Iterator[bytes]:
            nonlocal held
            sample, size = [first], len(first)
            for r in records:
                if size + len(r) > sample_bytes:
                    held = r
                    break
                sample.append(r)
                size += len(r)
            else:
                held = None
            own = dictionary(sample)
            if own:
                yield struct.pack("<II", SKIPPABLE, len(own)) + own
            pack = zstandard.ZstdCompressor(level, dict_data=zstandard.ZstdCompressionDict(own) if own else None, write_content_size=True, write_checksum=True)
            for r in sample:
                yield pack.compress(r)
            while held is not None and size + len(held) <= archive_bytes:
                size += len(held)
                yield pack.compress(held)
                held = next(records, None)

        yield archive(held)


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, sample_bytes: int = SAMPLE_BYTES, level: int = 3) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) to archives under path; returns the manifest, their names and sizes.

    Of rows with equal payloads of min_bytes or more, those with the smallest page_id are responses
    and the others revisit it. A null html is an empty payload, a null page_id is never the smallest
    (where all are null, all are responses), a null url leaves its header out. Rows repeated with the
    smallest id are responses each. page_id is a whole number; other types are refused before anything is
    written. Equal payloads are counted and the counts written first, so that both sides of the join are plain
    exchanges and a payload that a third of the rows share can be split. Other columns aren't written.
    An empty table gives no archive and an empty manifest.
    """
    spark = pages.sparkSession
    kind = dict(pages.dtypes)["page_id"]
    if kind not in ("bigint", "int", "smallint", "tinyint", "void"):
        raise TypeError(f"page_id is {kind}, not a whole number")
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", body.alias("payload"), F.sha1(body).alias("digest"))
    keys = rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = saved(keys.where("n > 1").select("digest", "first"), "payloads")
    rows = rows.join(shared, "digest", "left")
    refers = F.when((F.length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), F.length("payload").alias("size"), "digest", refers.alias("refers_to"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for page_id, url, payload, size, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield record(page_id, url, payload, size, _base32(digest), refers_to)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        context = TaskContext.get()
        for k, chunks in enumerate(_archives(made(batches), archive_bytes, sample_bytes, level)):
            name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{k:04d}.warc.zst"
            size = 0
            with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                for chunk in chunks:
                    out.write(chunk)
                    size += len(chunk)
            yield pa.RecordBatch.from_pydict({"archive": [name], "bytes": [size]})

    rows.mapInArrow(write, MANIFEST).write.parquet(f"{path}/{MANIFEST_NAME}")
    discard(shared)
    return spark.read.schema(MANIFEST).parquet(f"{path}/{MANIFEST_NAME}")


def records(archive: bytes) -> Iterator[bytes]:
    """The records of one archive."""
    at, own = 0, None
    if len(archive) >= 8:
        magic, size = struct.unpack_from("<II", archive)
        if magic == SKIPPABLE:
            own, at = zstandard.ZstdCompressionDict(archive[8 : 8 + size]), 8 + size
    unpack = zstandard.ZstdDecompressor(dict_data=own)
    view = memoryview(archive)
    while at < len(archive):
        frame = unpack.decompressobj()
        parts = []
        while not frame.eof:
            step = view[at : at + 8192]
            if not step:
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(step))
            at += len(step)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> tuple:
    """The columns of READ from one record; a response's digest and length are computed from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) + 4 != len(rest):
        raise ValueError("a record's length is not that of its header")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response":
        stated, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    refers_to = _page_id(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return _page_id(fields["WARC-Record-ID"]), stated, digest, kind, refers_to, fields.get("WARC-Target-URI"), payload if kind == "response" else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives that path's manifest names, with the columns of READ; payload null for revisits, or for all.

    Archives are dealt out over the tasks one by one, and a task holds one archive at a time.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/{MANIFEST_NAME}")
    many = max(1, min(manifest.count(), READ_TASKS))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in READ.split(", ")]
    width = 7 if payloads else 6

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[:width], kinds, strict=False)], names=names[:width])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for b in batches:
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    archive = stream.read()
                if len(archive) != size:
                    raise ValueError(f"{name} has {len(archive)} bytes, not {size}")
                rows, held = [], 0
                for r in records(archive):
                    rows.append(parse(r))
                    held += len(r)
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return manifest.repartition(many).mapInArrow(read, ", ".join(READ.split(", ")[:width]))


def archive_and_read(pages: DataFrame, **options) -> DataFrame:
    """Write archives into a new place in the shared folder, then read them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **options)
    return read_archives(spark, path, payloads=False)
