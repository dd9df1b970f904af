"""WARC archives in Zstandard: writer with revisit records, and reader.

An archive is a file of Zstandard frames. The first is a skippable frame
(magic 0x184D2A5D) that holds the dictionary; then comes one frame per record.
The reader loads the dictionary, decodes frame by frame, and checks of every
record the version line, the needed headers, the block length, the closing
line breaks and the payload digest. It streams: neither side holds more than a
record and a read buffer.

Of records with equal payloads of at least ``min_bytes`` bytes, that with the
largest page_id is a response (every row with that id, where rows repeat); the
others are revisits of it. Roles are found on digests, not payloads; only
digests that occur more than once are joined back to the pages.

Each task writes under a name of its own and renames the file when it is
complete; the manifest names the files of the attempts that succeeded, so that
a lost executor leaves at most an unread file.

Defined cases: null html counts as an empty payload; a null url as an empty
one; a null page_id sorts below all others and is kept as null; an empty table
gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectra.llm.common import bytes_of, fresh_path, stored

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 32 * 1024
SAMPLE_BYTES = 1 << 20
READ_BYTES = 1 << 20
BROADCAST_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def one_line(text: str) -> str:
    """A header value: control characters and spaces are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record_bytes(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = base32_sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record; ValueError if unsound."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not headers.get(name):
            raise ValueError(f"header {name} is missing")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, Content-Length says {n}")
    return headers, rest[:n]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def make_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or raw content where there is too little to train."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def as_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    """A dictionary may itself be compressed; one of no bytes is none."""
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def compressor(raw: bytes) -> zstandard.ZstdCompressor:
    known = as_dictionary(raw)
    return zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True) if known else zstandard.ZstdCompressor(level=3, write_checksum=True)


def read_frames(stream) -> Iterator[bytes]:
    """The content of each frame after the dictionary frame."""
    head = stream.read(8)
    if not head:
        return
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame at the start")
    raw = stream.read(size)
    if len(raw) != size:
        raise ValueError("the dictionary frame is cut off")
    known = as_dictionary(raw)
    plain = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    waiting = b""
    while True:
        frame, out = plain.decompressobj(), []
        chunk = waiting or stream.read(READ_BYTES)
        if not chunk:
            return
        while True:
            out.append(frame.decompress(chunk))
            if frame.eof:
                waiting = frame.unused_data
                break
            chunk = stream.read(READ_BYTES)
            if not chunk:
                raise ValueError("the last frame is cut off")
        yield b"".join(out)


def roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload, refers_to, revisit; payloads aren't shuffled
    unless the repeated digests are too many to broadcast."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    repeated = stored(
        named.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "refers_to"),
        "repeated-payloads",
    )
    small = bytes_of(repeated, F.lit(32)) <= BROADCAST_BYTES
    joined = named.join(F.broadcast(repeated) if small else repeated, "digest", "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes one archive per task; returns the manifest (path, records)."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = fs.FileSystem.from_uri(folder)
        name = f"{top}/part-{uuid.uuid4().hex}.warc.zst"
        count, held, size, sink, pack = 0, [], 0, None, None

        def begin() -> None:
            nonlocal sink, pack
            store.create_dir(top, recursive=True)
            sink = store.open_output_stream(name + ".open", compression=None)
            raw = make_dictionary(held)
            sink.write(dictionary_frame(raw))
            pack = compressor(raw)
            for record in held:
                sink.write(pack.compress(record))

        for batch in batches:
            for page, url, payload, refers, revisit in batch.itertuples(index=False, name=None):
                record = record_bytes(None if pd.isna(page) else int(page), url, bytes(payload), None if pd.isna(refers) else int(refers), bool(revisit))
                count += 1
                if pack:
                    sink.write(pack.compress(record))
                    continue
                held.append(record)
                size += len(record)
                if size >= SAMPLE_BYTES:
                    begin()
                    held = []
        if count:
            if not pack:
                begin()
            sink.close()
            store.move(name + ".open", name)
            yield pd.DataFrame({"path": [name], "records": [count]})

    return stored(roles(pages, min_bytes).mapInPandas(write, "path string, records long"), "warc-manifest").withColumn("folder", F.lit(folder))


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives that a manifest names."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, path, records in batch[["folder", "path", "records"]].itertuples(index=False, name=None):
                store, _ = fs.FileSystem.from_uri(folder)
                rows, seen = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for raw in read_frames(stream):
                        rows.append(row_of(*parse_record(raw)))
                        seen += 1
                        if len(rows) == 1000:
                            yield frame(rows)
                            rows = []
                if seen != records:
                    raise ValueError(f"{path} has {seen} records, the manifest says {records}")
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = manifest.select("folder", "path", "records")
    return files.repartition(max(1, manifest.count()), "path").mapInPandas(read, READ)


def row_of(headers: dict[str, str], block: bytes) -> tuple:
    """The row of a record, whose payload is checked against its digest."""
    kind, size, digest = headers["warc-type"], int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {headers['warc-record-id']} doesn't fit its digest")
    whole = lambda name: int(headers[name]) if headers.get(name) else None
    return (whole("x-page-id"), size, digest, kind, whole("x-refers-to-page-id"), headers.get("warc-target-uri", ""))
