"""WARC archives with a Zstandard dictionary of their own.

Each file begins with a skippable frame that holds a dictionary built from the
file's own records; every record follows as a frame of its own, compressed with
it. A payload that was archived before is a revisit: it names the record with
the same payload and the smallest id, which is found by digest with one
aggregate before anything is written.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import files
from marlstone.storage import scratch, stash

#: The skippable frame's magic number, and the revisit profile.
FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A dictionary's size, and how much of a file's records it is built from at most.
DICTIONARY, SAMPLE = 64 << 10, 4 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit's block ends with its HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on records spread over the file; plain content where they are too few to train on."""
    step = max(1, sum(map(len, records)) // SAMPLE)
    some = records[::step]
    try:
        if len(some) >= 16:
            return zstandard.train_dictionary(DICTIONARY, some)
    except zstandard.ZstdError:
        pass
    return zstandard.ZstdCompressionDict(b"".join(some)[-DICTIONARY:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = 3) -> bytes:
    known = dictionary(records)
    content = known.as_bytes()
    compressor = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True)
    return struct.pack("<II", FRAME, len(content)) + content + b"".join(map(compressor.compress, records))


def parse(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, one at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != FRAME:
        raise ValueError("no dictionary frame")
    known = zstandard.ZstdCompressionDict(stream.read(size))
    plain = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=known).stream_reader(stream, read_across_frames=True), 1 << 20)
    while line := plain.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := plain.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        block = plain.read(int(headers["Content-Length"]))
        if plain.read(4) != b"\r\n\r\n":
            raise ValueError("a record's end is missing")
        yield headers, block


def originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``(digest, original)`` of payloads of at least ``least_bytes`` that come more than once."""
    body = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("bytes")).where(F.col("bytes") >= least_bytes)
    return keyed.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("digest", "original")


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, file_bytes: int = 32 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archive ``pages(page_id, url, html)``; returns the manifest ``(part, file, path, n_records)``.

    Null payloads are empty ones. Rows that repeat the smallest id of a payload
    are all responses; a row without an id is a response only if no row with
    its payload has one. A task holds one file's records, ``file_bytes`` at most
    (or one record): a very long payload is one record, and may be a file of its own.
    Rows that are equal in all columns are records each; no rows give no files and an empty manifest.
    Other columns are left out.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    pages = pages.select("page_id", "url", "html")
    first = stash(originals(pages, least_bytes), "originals")
    named = pages.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).join(first, "digest", "left")
    named = named.select("page_id", "url", "html", "original", (F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, held = TaskContext.get().partitionId(), 0, 0
        records: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal file, held
            path = files.write(folder, f"pages-{part:06}-{file:06}.warc.zst", archive(records))
            row = pa.RecordBatch.from_pylist([{"part": part, "file": file, "path": path, "n_records": len(records)}])
            records.clear()
            file, held = file + 1, 0
            return row

        for batch in batches:
            for r in batch.to_pylist():
                made = record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "replace"), r["original"], r["revisit"], date)
                if records and held + len(made) > file_bytes:
                    yield close()
                records.append(made)
                held += len(made)
        if records:
            yield close()

    return stash(named.mapInArrow(run, "part long, file long, path string, n_records long"), "archives")


def read_archives(manifest: DataFrame) -> DataFrame:
    """``(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to)`` of every record; a revisit's payload is null.

    Very long payloads are read whole; an empty manifest gives no rows; of the manifest only ``path`` is read, so
    other columns do no harm. A payload that does not match its digest raises an error.
    """
    spread = manifest.select("path").repartition(max(1, min(10_000, manifest.count())))

    def number(uri: str) -> int | None:
        return int(x) if (x := uri.removeprefix("<urn:page:").rstrip(">")) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[dict] = []
                held = 0
                with files.stream(path) as f:
                    for headers, block in parse(f):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        whole = headers["WARC-Type"] == "response"
                        if whole and (len(payload) != size or digest(payload) != said):
                            raise ValueError(f"a payload of {path} is damaged")
                        rows.append(
                            {
                                "page_id": number(headers["WARC-Record-ID"]),
                                "url": headers["WARC-Target-URI"],
                                "record_type": headers["WARC-Type"],
                                "payload": payload if whole else None,
                                "payload_bytes": size,
                                "payload_digest": said,
                                "refers_to": None if whole else number(headers["WARC-Refers-To"]),
                            }
                        )
                        held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spread.mapInArrow(run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")
