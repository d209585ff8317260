"""Token-id files in word-aligned Simple-8b, written and read as whole columns.

A 64-bit word holds a selector (its upper four bits) and as many ids of the
selector's width as fit in the other sixty. Ids that are wider than the largest
width are written as that width's largest code, and their true values follow
in a list of escapes. Ids are coded in blocks of fixed size with the offsets of
each block's words and escapes, so a block can be decoded by itself, and a
selector's words are all unpacked by one shift of a matrix.

A file (little-endian throughout): magic, counts, the documents' ids, validity
and lengths, the blocks' word and escape offsets, words, escapes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import files, tokens
from marlstone.storage import scratch, stash

#: Ids a word and bits an id, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
MAGIC = b"MS8BIDS1"
#: Ids from this one on are escapes: the largest code of 30 bits stands for them.
ESCAPE = (1 << 30) - 1
BLOCK = 65_536
_HEAD = struct.Struct("<8s6Q")


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escapes of up to ``BLOCK`` ids."""
    n = len(ids)
    escapes = ids[ids >= ESCAPE]
    codes = np.minimum(ids, ESCAPE).astype(np.uint64)
    padded = np.concatenate((codes, np.zeros(int(COUNTS[0]), np.uint64)))
    chosen = np.full(n, len(COUNTS) - 1, np.int8)
    for s in range(len(COUNTS) - 1, -1, -1):  # the densest selector that fits wins
        count, limit = int(COUNTS[s]), np.uint64(1) << np.uint64(WIDTHS[s])
        narrow = np.flatnonzero(padded < limit)
        first = narrow[: max(0, len(narrow) - count + 1)]
        hits = first[narrow[count - 1 :] - first == count - 1]  # `count` of them in a row
        chosen[hits[: np.searchsorted(hits, n)]] = s
    taken = COUNTS[chosen].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += taken[at]
    first = np.array(starts, np.int64)
    selector = chosen[first]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        places = np.arange(COUNTS[s])
        values = padded[first[own, None] + places] << (places * WIDTHS[s]).astype(np.uint64)
        words[own] |= np.bitwise_or.reduce(values, axis=1)
    return words, escapes


def decode_block(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        places = np.arange(COUNTS[s])
        values = (words[own, None] >> (places * WIDTHS[s]).astype(np.uint64)) & np.uint64((1 << int(WIDTHS[s])) - 1)
        out[(ends - counts)[own, None] + places] = values
    out = out[:n]
    if len(escapes):
        out[out == ESCAPE] = escapes
    return out


def to_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file's content: documents in order, their ids one after the other."""
    coded = [encode_block(ids[a : a + BLOCK]) for a in range(0, len(ids), BLOCK)]
    word_ends = np.cumsum([0, *(len(w) for w, _ in coded)], dtype="<u8")
    escape_ends = np.cumsum([0, *(len(e) for _, e in coded)], dtype="<u8")
    parts = [
        _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(coded), int(word_ends[-1]), int(escape_ends[-1]), BLOCK),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is not None for x in doc_ids], "u1").tobytes(),
        np.array(lengths, "<i8").tobytes(),
        word_ends.tobytes(),
        escape_ends.tobytes(),
        *(w.astype("<u8").tobytes() for w, _ in coded),
        *(e.astype("<u8").tobytes() for _, e in coded),
    ]
    return b"".join(parts)


class Reader:
    """A file's documents and, block by block, its ids."""

    def __init__(self, content: bytes):
        magic, docs, self.n_ids, blocks, words, escapes, self.block = _HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        at = _HEAD.size

        def array(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        keys, valid = array("<i8", docs), array("u1", docs)
        self.doc_ids = [k if v else None for k, v in zip(keys.tolist(), valid.tolist(), strict=True)]
        self.lengths = array("<i8", docs)
        self.word_ends, self.escape_ends = array("<u8", blocks + 1), array("<u8", blocks + 1)
        self.words, self.escapes = array("<u8", words), array("<u8", escapes)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n``, from the blocks that hold them."""
        first, last = start // self.block, -(-(start + n) // self.block)
        got = [self._block(b) for b in range(first, last)]
        whole = np.concatenate(got) if got else np.empty(0, np.uint64)
        return whole[start - first * self.block :][:n]

    def _block(self, b: int) -> np.ndarray:
        words = self.words[int(self.word_ends[b]) : int(self.word_ends[b + 1])]
        escapes = self.escapes[int(self.escape_ends[b]) : int(self.escape_ends[b + 1])]
        return decode_block(words, escapes, min(self.block, self.n_ids - b * self.block))


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id: str = "doc_id", text: str = "text", ids_per_file: int = 1 << 22) -> DataFrame:
    """Encode ``docs`` into files in ascending order of ``id``; returns their manifest ``(part, file, path, n_docs, n_ids)``.

    The rows are dealt by ranges of ``id`` and sorted within, so ``(part, file)``
    orders the files. Null ids come first; repeated ids stay neighbours, in no
    particular order; null texts count as empty; ids must be integers. A file
    closes when it holds ``ids_per_file`` ids; a document is never cut: a very long
    text may make a file larger. Other columns are left out, those with the names used here too. No rows give no files
    and an empty manifest.
    """
    folder = folder or scratch(docs.sparkSession, "token-ids")
    ordered = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).repartitionByRange("id").sortWithinPartitions("id")
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        part, file = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        coded: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal file, held
            lengths = [len(x) // 4 for x in coded]
            content = to_bytes(keys, lengths, np.frombuffer(b"".join(coded), "<u4").astype(np.uint64))
            path = files.write(folder, f"ids-{part:06}-{file:06}.s8b", content)
            row = pa.RecordBatch.from_pylist([{"part": part, "file": file, "path": path, "n_docs": len(keys), "n_ids": sum(lengths)}])
            keys.clear()
            coded.clear()
            file, held = file + 1, 0
            return row

        for batch in batches:
            for key, value in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                ids = encoder.ids(value.as_py()) + last
                keys.append(key)
                coded.append(ids)
                held += len(ids) // 4
                if held >= ids_per_file:
                    yield close()
        if keys:
            yield close()

    return stash(ordered.mapInArrow(run, "part long, file long, path string, n_docs long, n_ids long"), "token-files")


def read_ids(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files: ``start`` counts the ids of all documents before.

    The running sum is over files, one small row each. Null ids come back null, repeated ones as often as they were written; an empty
    manifest gives no rows; other columns of the manifest are left out. Blocks are decoded a few at a time, but a very long document is one row.
    """
    before = F.sum("n_ids").over(Window.orderBy("part", "file")) - F.col("n_ids")
    placed = manifest.select("path", before.alias("before")).repartition(max(1, min(10_000, manifest.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                reader = Reader(files.read(path))
                starts = np.cumsum(reader.lengths) - reader.lengths
                i = 0
                while i < len(starts):  # some blocks' worth of documents at a time
                    j = max(i + 1, int(np.searchsorted(starts, starts[i] + 16 * reader.block)))
                    n = int(reader.lengths[i:j].sum())
                    ids = reader.ids(int(starts[i]), n).astype("<u4").tobytes()
                    cuts = (starts[i:j] - starts[i]).tolist() + [n]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reader.doc_ids[i:j], pa.int64()),
                            pa.array(first + starts[i:j], pa.int64()),
                            pa.array(reader.lengths[i:j], pa.int64()),
                            pa.array([ids[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                    i = j

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
