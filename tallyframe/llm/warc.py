"""Dictionary-compressed web archives: one Zstandard frame a record, the dictionary in front.

A ``.warc.zst`` archive starts with a skippable frame that holds the dictionary; each WARC record
follows as a frame of its own, so a record can be read alone. The dictionary is trained on windows of a bounded sample
of the records and shared by all archives; where they are too few to train one, it is their plain content. Of records with equal payloads one is a response and the
others are revisits that refer to it.

Tasks write the archives straight to the folder (any file system that Arrow can open), under names of their
own, and report them in a manifest; what a failed attempt leaves behind is in no manifest and is never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.sampling import thinned
from tallyframe.operators.joins import keyed_join
from tallyframe.session import remember, shared_dir, written

DICTIONARY_BYTES = 64 * 1024
SAMPLE_RECORDS = 1024
# Of a sampled payload a window of this size, from a place by the hash of its page, is used for training; archives hold whole records.
SAMPLE_BYTES = 16 * 1024
ARCHIVE_BYTES = 64 * 1024 * 1024
LEVEL = 3
# Rows that repeat a page are put back so many at a time.
COPIES_A_TASK = 10_000
# Pages that may have a copy are told from most others by so many values of their digest's hash.
COPY_BUCKETS = 1 << 18
DATE = "2025-01-01T00:00:00Z"
# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, url: str | None, kind: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}|{url}|{kind}|{digest}')}>"


def _line(text: str) -> str:
    """A header value: line breaks and other control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers: tuple[int | None, str | None] | None) -> bytes:
    """One WARC record. A revisit has the headers of the response and its payload's digest and length."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, url, kind, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(*refers, 'response', digest)}"]
        if refers[0] is not None:
            head.append(f"X-Refers-To-Page-ID: {refers[0]}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _warcinfo() -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\n"
    return (head + f"Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in small letters) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {name.lower(): value for name, value in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for the samples: trained, or the end of their content where they are too few or too small for that."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _open(folder: str):
    return pyarrow.fs.FileSystem.from_uri(folder)


class ArchiveWriter:
    """Writes records to archives of bounded size and notes each archive's name, records and bytes."""

    def __init__(self, folder: str, dictionary: bytes):
        self.fs, self.folder = _open(folder)
        self.dictionary = dictionary
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
        self.out, self.done = None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name, self.records, self.size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            if self.dictionary:
                self._put(struct.pack("<II", SKIPPABLE_MAGIC, len(self.dictionary)) + self.dictionary)
            self._put(self.compressor.compress(_warcinfo()))
        self._put(self.compressor.compress(data))
        self.records += 1
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.records, self.size))
            self.out = None


def read_records(folder: str, name: str) -> Iterator[bytes]:
    """The records of an archive, frame by frame; only one record is in memory at a time."""
    fs, path = _open(folder)
    with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
        buffer, known = stream.read(8), None
        if len(buffer) == 8 and struct.unpack("<II", buffer)[0] == SKIPPABLE_MAGIC:
            known = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", buffer)[1]))
            buffer = b""
        decompressor = zstandard.ZstdDecompressor(dict_data=known)
        while buffer or (buffer := stream.read(1 << 16)):
            frame, parts = decompressor.decompressobj(), []
            while not frame.eof:
                if not buffer and not (buffer := stream.read(1 << 16)):
                    raise ValueError(f"{name} ends within a record")
                parts.append(frame.decompress(buffer))
                buffer = frame.unused_data if frame.eof else b""
            yield b"".join(parts)


def _with_roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, kind, to_id, to_url): which record each page becomes.

    Of pages with the same digest the one with the largest id (then url) is the response. Digests are counted without
    payloads, in two steps; only pages that may have a copy are joined back by their digest, where hot ones are split.
    Pages that repeat the response's id and url are one row with a count until they are put back in chunks.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    same = rows.groupBy("sha", "page_id", "url").agg(F.count("*").alias("n"))
    copied = same.groupBy("sha").agg(F.sum("n").alias("c"), F.max(F.struct("page_id", "url", "n")).alias("to"))
    copied = written(copied.where("c > 1").select("sha", "to"), "copied_payloads")
    bucket = F.pmod(F.xxhash64("sha"), F.lit(COPY_BUCKETS)).alias("bucket")
    buckets = F.broadcast(copied.select(bucket).distinct())
    marked = rows.select("*", bucket)
    alone = marked.join(buckets, "bucket", "left_anti").select("page_id", "url", "payload", F.lit("response").alias("kind"), *_nobody())
    maybe = keyed_join(marked.join(buckets, "bucket", "left_semi").drop("bucket"), copied, "sha", "left", ["page_id", "url"])
    is_it = F.col("to").isNull() | (F.col("page_id").eqNullSafe(F.col("to.page_id")) & F.col("url").eqNullSafe(F.col("to.url")))
    repeated = F.coalesce(is_it & (F.col("to.n") > 1), F.lit(False))
    refers = [F.col("to.page_id").alias("to_id"), F.col("to.url").alias("to_url")]
    once = maybe.where(~repeated).select("page_id", "url", "payload", F.when(is_it, "response").otherwise("revisit").alias("kind"), *refers)
    groups = maybe.where(repeated).groupBy("sha", "page_id", "url").agg(F.first("payload").alias("payload"), F.first("to").alias("to"), F.count("*").alias("n"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES_A_TASK).cast("long")))
    chunks = groups.withColumn("begin", chunk).repartition("sha", "page_id", "begin")
    place = F.explode(F.sequence("begin", F.least(F.col("begin") + COPIES_A_TASK, F.col("n")) - 1))
    back = chunks.withColumn("place", place).select("page_id", "url", "payload", F.when(F.col("place") == 0, "response").otherwise("revisit").alias("kind"), *refers)
    return alone.unionByName(once).unionByName(back)


def _nobody() -> list:
    return [F.lit(None).cast("long").alias("to_id"), F.lit(None).cast("string").alias("to_url")]


def _id(value) -> int | None:
    return None if pd.isna(value) else int(value)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of all pages (page_id, url, html) in a folder; gives their manifest (archive, records, bytes).

    A null html is an empty payload, a null url or id leaves its field out. Repeated rows each get a record;
    one of them is the response. Other columns do not matter; an empty table writes no archive. Payloads of any length
    are written whole.
    """
    whole = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    begin = F.pmod(F.xxhash64(F.lit("window"), "page_id", "url"), F.greatest(F.octet_length(whole) - SAMPLE_BYTES, F.lit(0)) + 1)
    window = F.substring(whole, (begin + 1).cast("int"), F.lit(SAMPLE_BYTES)).alias("payload")
    few = thinned(pages.select("page_id", "url", window), SAMPLE_RECORDS, pages.count(), "page_id", "url")
    few = few.groupBy("page_id", "url").agg(F.min("payload").alias("payload"))
    sample = few.orderBy(F.xxhash64("page_id", "url"), "page_id", "url").limit(SAMPLE_RECORDS)
    dictionary = train_dictionary([record("response", r["page_id"], r["url"], bytes(r["payload"]), None) for r in sample.collect()])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = ArchiveWriter(folder, dictionary)
        for batch in batches:
            for page_id, url, payload, kind, to_id, to_url in batch.itertuples(index=False):
                writer.add(record(kind, _id(page_id), url, bytes(payload), (_id(to_id), to_url)))
        writer.close()
        yield pd.DataFrame(writer.done, columns=["archive", "records", "bytes"])

    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    remember(folder)
    rows = _with_roles(pages).select("page_id", "url", "payload", "kind", "to_id", "to_url")
    return written(rows.mapInPandas(write, "archive string, records long, bytes long"), "warc_manifest")


def read_archives(folder: str, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record.

    Digest and length are those of the full payload; a response whose payload does not have its digest
    raises. A revisit's payload is null, and so is every payload without ``with_payload``.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["archive"]:
                rows, size = [], 0
                for data in read_records(folder, name):
                    fields, block = parse(data)
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(next(v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")) if k == "Content-Length"))
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
                        raise ValueError(f"{name}: the payload of {fields['warc-record-id']} is damaged")
                    ids = [int(fields[x]) if x in fields else None for x in ("x-page-id", "x-refers-to-page-id")]
                    kept = payload if with_payload and kind == "response" else None
                    rows.append((ids[0], fields.get("warc-target-uri"), kind, length, digest, ids[1], kept))
                    size += len(kept or b"")
                    if len(rows) >= 5000 or size > ARCHIVE_BYTES:
                        yield _frame(rows)
                        rows, size = [], 0
                yield _frame(rows)

    # The manifest is a few rows in few files; each archive shall be read by a task of its own.
    return manifest.repartition(max(1, manifest.count())).mapInPandas(read, _SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = [part.split()[0] for part in _SCHEMA.split(", ")]
    return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def archive_and_read(pages: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of all pages, written to archives in the shared folder and read back from there."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(folder, write_archives(pages, folder), with_payload)
