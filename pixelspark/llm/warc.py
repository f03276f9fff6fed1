"""WARC archives through a chunked record table.

A record is a sequence of rows (record_id, digest, chunk_no, ...): no step after the page scan holds more than one chunk of a
payload. A payload longer than one chunk becomes a segmented record (WARC-Segment-Number, `continuation` records), so
that an archive file is a plain sequence of small WARC/1.1 records. Every chunk carries the SHA-256 of the payload up to
and including it; the reader updates one digest per record and compares it chunk by chunk.
The chunks of a record that runs on in another file are digested in a second pass, sorted. Digests and sizes of the result
are the reader's own, those of a revisit its response's; a record that is damaged or refers to none, a file that is cut short
and an archive with another number of records than were planned fail the reading.
Spark's own text writer and binary reader do the input and output, so the archives can be in any store Spark reaches; as
they compress a file as a whole, it is one gzip member and not one per record, which readers that only stream accept.

Defined results: a null payload is the empty payload; a null url is written as `urn:record:<id>`; a row without id has
no record and is left out; a record is named by id and payload, so rows that repeat an id with other payloads are records of
their own, and fully repeated rows (same id, same payload) give a record and a result row each; an empty table gives no rows.
Extra columns are ignored. Payloads under `min_revisit_bytes` are never revisits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelspark.session import shared_dir, written

CHUNK_BYTES = 32 << 10
# The head of a stored response, the profile of revisits and the zero date of records without one.
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"
RECORDS_PER_FILE = 2048
READ_SCHEMA = "record_id bigint, record_digest string, chunk_no bigint, payload_bytes bigint, running_digest string, last boolean, record_type string, refers_to bigint, intact boolean, payload binary"


def record_plan(pages: DataFrame, id_col: str, payload_col: str, min_revisit_bytes: int) -> DataFrame:
    """(record_id, payload_bytes, payload_digest, refers_to): of equal payloads the smallest id is the response, others refer to it."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    seen = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("record_id"), F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    seen = written(seen, "warc-digests")
    first = seen.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("payload_digest").agg(F.min("record_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    first = written(first.select("payload_digest", "first_id"), "warc-revisited")  # a written table: the planner knows its size
    return seen.join(first, "payload_digest", "left").select(
        "record_id", "payload_bytes", "payload_digest",
        F.when((F.col("payload_bytes") >= min_revisit_bytes) & (F.col("first_id") != F.col("record_id")), F.col("first_id")).alias("refers_to"),
    )


def _chunker(chunk_bytes: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(CHUNK_TYPES)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            held = 0
            ids, urls, payloads, refers, digests = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                refers_to = refers[i].as_py()
                data = b"" if refers_to is not None else memoryview(payloads[i].as_buffer() or b"") if payloads[i].is_valid else b""
                total, running = len(data), hashlib.sha256()
                for k, start in enumerate(range(0, max(total, 1), chunk_bytes)):
                    part = bytes(data[start : start + chunk_bytes])
                    running.update(part)
                    block = part if k or refers_to is not None else HTTP_HEAD.encode() + part
                    own = hashlib.sha256(block)
                    for out, value in zip(rows, (ids[i].as_py(), k, len(block), total, running.hexdigest(), own.hexdigest(), start + chunk_bytes >= total, urls[i].as_py(), refers_to, digests[i].as_py(), block)):
                        out.append(value)
                    held += len(part)
                    if held > 4 << 20:
                        yield _rows(names, rows)
                        rows, held = [[] for _ in names], 0
            if rows[0]:
                yield _rows(names, rows)

    return chunks


CHUNK_TYPES = dict(record_id=pa.int64(), chunk_no=pa.int64(), block_bytes=pa.int64(), payload_total=pa.int64(), running_digest=pa.string(), block_digest=pa.string(), last=pa.bool_(), url=pa.string(), refers_to=pa.int64(), payload_digest=pa.string(), block=pa.binary())
CHUNK_SCHEMA = "record_id bigint, chunk_no bigint, block_bytes bigint, payload_total bigint, running_digest string, block_digest string, last boolean, url string, refers_to bigint, payload_digest string, block binary"


def _rows(names: list[str], rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, CHUNK_TYPES[n]) for n, x in zip(names, rows)], names=names)


def record_chunks(pages: DataFrame, plan: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of pages under a record_plan: the blocks of WARC records. Revisits have one chunk without payload."""
    revisits = plan.where("refers_to is not null").select(F.col("record_id").alias("of_id"), F.col("payload_digest").alias("of_digest"), "refers_to").distinct()
    revisits = written(revisits, "warc-revisits")  # its size is known, so a small one is broadcast and a large one is not
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("record_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    rows = rows.join(revisits, (F.col("record_id") == F.col("of_id")) & (F.col("payload_digest") == F.col("of_digest")), "left").select("record_id", "url", "payload", "refers_to", "payload_digest")
    return rows.mapInArrow(_chunker(chunk_bytes), CHUNK_SCHEMA)


def write_archives(chunks: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, date: str = NO_DATE) -> None:
    """One WARC/1.1 record per chunk, in gzip files of at most records_per_file records. date is that of all records: the pages have none."""
    uid = lambda record, chunk: F.concat(F.lit("<urn:record:"), record.cast("string"), F.lit(":"), F.col("payload_digest"), F.lit(":"), chunk.cast("string"), F.lit(">"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    revisit, first, whole = F.col("refers_to").isNotNull(), F.col("chunk_no") == 0, (F.col("chunk_no") == 0) & F.col("last")
    url = F.regexp_replace(F.coalesce(F.col("url"), F.concat(F.lit("urn:record:"), F.col("record_id").cast("string"))), r"[\r\n\x00]", "")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).when(first, F.lit("response")).otherwise(F.lit("continuation"))),
        line("WARC-Record-ID", uid(F.col("record_id"), F.col("chunk_no"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Segment-Number", F.when(~whole, F.col("chunk_no") + 1)),
        line("WARC-Segment-Origin-ID", F.when(~first, uid(F.col("record_id"), F.lit(0)))),
        line("WARC-Segment-Total-Length", F.when(~whole & F.col("last"), F.col("payload_total") + len(HTTP_HEAD))),
        line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        line("WARC-Refers-To", F.when(revisit, uid(F.col("refers_to"), F.lit(0)))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.when(revisit, F.col("payload_digest")).when(F.col("last"), F.col("running_digest")))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.col("block_digest"))),
        line("X-Running-Digest", F.concat(F.lit("sha256:"), F.col("running_digest"))),
        line("Content-Type", F.when(first & ~revisit, F.lit("application/http; msgtype=response"))),
        line("Content-Length", F.col("block_bytes")),
        F.lit("\r\n"),
    )
    record = F.concat(header.cast("binary"), F.col("block"), F.lit("\r\n\r").cast("binary")).cast("string")
    chunks.select(record.alias("value")).write.option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def _record_name(value: bytes) -> tuple[int, str, int]:
    record, digest, chunk = value[len("<urn:record:") : -1].split(b":")
    return int(record), digest.decode(), int(chunk)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import io
    import zlib

    for batch in batches:
        for content in batch.column(0):
            buffer = content.as_buffer()
            stream = io.BufferedReader(_Gunzip(zlib.decompressobj(31), memoryview(buffer)), 1 << 18)
            rows: list[tuple] = []
            held = 0
            running, owner = hashlib.sha256(), None
            while line := stream.readline():
                if line == b"\r\n":
                    continue
                fields = {}
                while (line := stream.readline()) not in (b"\r\n", b""):
                    name, _, value = line.partition(b": ")
                    fields[name] = value.rstrip(b"\r\n")
                if not line or b"Content-Length" not in fields:
                    raise ValueError("an archive is cut short inside a record's head")
                block = stream.read(int(fields[b"Content-Length"]))
                stream.read(4)
                record, named, chunk = _record_name(fields[b"WARC-Record-ID"])
                kind = fields[b"WARC-Type"].decode()
                intact = hashlib.sha256(block).hexdigest() == fields[b"WARC-Block-Digest"][7:].decode()
                payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else block
                if chunk == 0:
                    running, owner = hashlib.sha256(), (record, named, 0)
                digest = None
                if owner == (record, named, chunk):  # the chunk before it stands in this file: one digest runs on
                    running.update(payload)
                    digest = running.hexdigest()
                    intact &= digest == fields[b"X-Running-Digest"][7:].decode()
                    owner = (record, named, chunk + 1)
                # else a file began inside the record: its own block's digest holds, the record's is left to digest_split
                refers = _record_name(fields[b"WARC-Refers-To"])[0] if kind == "revisit" else None
                if kind == "revisit":  # the digest of the payload it refers to, compared in read_pages
                    digest = fields.get(b"WARC-Payload-Digest", b"sha256:")[7:].decode()
                last = kind == "revisit" or b"WARC-Payload-Digest" in fields
                rows.append((record, named, chunk, len(payload), digest, last, kind, refers, intact, payload))
                held += len(payload)
                if held > 4 << 20:
                    yield _read_rows(rows)
                    rows, held = [], 0
            if not stream.raw.unpack.eof:
                raise ValueError("an archive is cut short")
            if rows:
                yield _read_rows(rows)


def _gunzip_class():
    import io

    class Gunzip(io.RawIOBase):
        """Reads a gzip buffer step by step; never holds the unpacked file."""

        def __init__(self, unpack, view):
            self.unpack, self.view, self.at = unpack, view, 0

        def readable(self):
            return True

        def readinto(self, into):
            while True:
                feed = self.unpack.unconsumed_tail or self.view[self.at : self.at + 65536]
                if not self.unpack.unconsumed_tail:
                    self.at += len(feed)
                if not len(feed):
                    return 0
                data = self.unpack.decompress(feed, len(into))
                if data:
                    into[: len(data)] = data
                    return len(data)

    return Gunzip


_Gunzip = _gunzip_class()


def _read_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table that write_archives wrote: one row per chunk, with its payload and whether its digest holds."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    return files.select("content").mapInArrow(_parse, READ_SCHEMA)


def _digest_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks -> the digest of each record, null where a chunk is missing or stands there in two versions."""
    owner, expected, running, ended = None, 0, hashlib.sha256(), False

    def row(owner: tuple, digest: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([owner[0]], pa.int64()), pa.array([owner[1]], pa.string()), pa.array([digest], pa.string())], names=["split_id", "split_name", "split_digest"])

    for batch in batches:
        for record, named, chunk, last, payload in zip(*(batch.column(i) for i in range(5))):
            now = (record.as_py(), named.as_py())
            if now != owner:
                if owner is not None:
                    yield row(owner, running.hexdigest() if expected >= 0 and ended else None)
                owner, expected, running, ended = now, 0, hashlib.sha256(), False
            expected = expected + 1 if chunk.as_py() == expected and not ended else -1
            running.update(payload.as_buffer())
            ended = last.as_py()
    if owner is not None:
        yield row(owner, running.hexdigest() if expected >= 0 and ended else None)


def digest_split(chunks: DataFrame, split: DataFrame) -> DataFrame:
    """(split_id, split_name, split_digest) of the records `split`, whose chunks stand in several files; one chunk at a time."""
    name = ["record_id", "record_digest"]
    parts = chunks.join(split, name, "left_semi").select(*name, "chunk_no", "last", "payload").distinct()
    return parts.repartition(*name).sortWithinPartitions(*name, "chunk_no").mapInArrow(_digest_sorted, "split_id bigint, split_name string, split_digest string")


def summarise(chunks: DataFrame) -> DataFrame:
    """One row per record from its chunks: no chunk needs another one in memory."""
    return chunks.groupBy("record_id", "record_digest").agg(
        F.count_if(F.col("chunk_no") == 0).alias("n_copies"),
        F.expr("sum(payload_bytes) div count_if(chunk_no = 0)").alias("stored_bytes"),
        F.max(F.when(F.col("last"), F.col("running_digest"))).alias("payload_digest"),
        F.max("refers_to").alias("refers_to"),
        F.when(F.max("refers_to").isNotNull(), F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.bool_and("intact").alias("intact"),
        F.bool_or(F.col("running_digest").isNull()).alias("split"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per page from the archives alone: size, digest, type and reference."""
    chunks = read_archives(spark, path)
    records = written(summarise(chunks.drop("payload")), "warc-records")
    split = records.where("split").select("record_id", "record_digest")
    if not split.isEmpty():
        digests = written(digest_split(chunks, split), "warc-split")
        records = records.join(digests, (F.col("record_id") == F.col("split_id")) & (F.col("record_digest") == F.col("split_name")), "left")
        records = records.withColumn("payload_digest", F.when(F.col("split"), F.col("split_digest")).otherwise(F.col("payload_digest")))
        records = written(records.drop("split_id", "split_name", "split_digest"), "warc-digested")
    wanted = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("record_id"), "record_digest")
    of = records.where("record_type = 'response'").join(wanted, ["record_id", "record_digest"], "left_semi")
    of = written(of.select(F.col("record_id").alias("of_id"), F.col("record_digest").alias("of_name"), F.col("stored_bytes").alias("of_bytes"), F.col("payload_digest").alias("of_digest")), "warc-referred")
    revisit = F.col("record_type") == "revisit"
    digest = F.when(revisit, F.col("of_digest")).otherwise(F.col("payload_digest"))
    whole = F.col("intact") & (digest == F.col("record_digest")) & (F.col("payload_digest") == F.col("record_digest"))
    damaged = F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id").cast("string")))
    pages = records.join(of, (F.col("refers_to") == F.col("of_id")) & (F.col("record_digest") == F.col("of_name")), "left")
    return pages.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("n_copies", F.lit(1))))).select(
        F.col("record_id").alias("page_id"),
        F.when(revisit, F.col("of_bytes")).otherwise(F.col("stored_bytes")).alias("payload_bytes"),
        F.when(F.coalesce(whole, F.lit(False)), digest).otherwise(damaged).alias("payload_digest"),
        "record_type", "refers_to",
    )


def archive_round_trip(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 100, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives and read them back: one row per page with size, digest, type and reference."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}-warc"
    plan = written(record_plan(pages, "page_id", "html", min_revisit_bytes), "warc-plan")
    write_archives(record_chunks(pages, plan, chunk_bytes=chunk_bytes), path)
    found, planned = written(read_pages(spark, path), "warc-pages"), plan.count()
    if (read := found.count()) != planned:
        raise ValueError(f"{planned} records were planned, {read} are in the archives")
    return found
