"""Packing examples into sequences: vector bin packing by the dot-product heuristic.

A sequence has three limits at once: tokens, segments and loss-bearing tokens.
It is filled from a bounded buffer of waiting examples: of those that fit in
every dimension, the one whose demand vector has the largest dot product with
what is left of the limits is placed next. Where none fits, an example that may
be cut fills the rest exactly; one that may not waits for the next sequence.

Every task packs its own partition, with a buffer of fixed size, so there is
no shuffle; a task leaves one sequence at most that is not full because it ran
out of examples. The documents' limit on segments is that on tokens, so that short texts fill
sequences too. Sequence ids hold the partition number, so a task that
runs again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import tokens
from marlstone.llm.text import apart


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


@dataclass
class Piece:
    """An example, or what is left of it: ``start`` counts the tokens of it that were placed before."""

    row: int
    start: int
    tokens: int
    loss: int
    payload: object = None


@dataclass
class Packer:
    """Fill sequences from a buffer; yields ``(piece, sequence, offset)``.

    ``cut``: examples may be cut anywhere. Every token but a piece's first then
    bears loss. An example over a limit that may not be cut has a sequence of its own.

    One sequence is open at a time. It takes a piece whenever the buffer is full, so that each choice
    is among ``most`` pieces, and it stays open while more examples come: also short
    examples fill it, however many it takes.
    """

    limits: Limits = field(default_factory=Limits)
    cut: bool = False
    most: int = 512
    waiting: list[Piece | None] = field(default_factory=list)
    used: int = 0  # sequence numbers given out

    def __post_init__(self) -> None:
        self.room = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        self.demand = np.zeros((self.most + 1, 3))
        self.alive = np.zeros(self.most + 1, bool)
        self.waiting = [None] * (self.most + 1)
        self.free = list(range(self.most + 1))
        self._open()

    def _open(self) -> None:
        self.left, self.offset, self.sequence = self.room.copy(), 0, -1

    def _number(self) -> int:
        self.used += 1
        return self.used - 1

    def add(self, piece: Piece) -> Iterator[tuple[Piece, int, int]]:
        if self.cut:  # whole sequences need no search
            while piece.tokens >= self.limits.tokens:
                head, piece = self._cut(piece, min(self.limits.tokens, self.limits.loss + 1))
                yield head, self._number(), 0
        elif not self._fits_alone(piece):
            yield piece, self._number(), 0
            return
        if piece.tokens == 0 and (self.cut or piece.start):
            return
        self._keep(piece)
        while not self.free:
            yield from self._place()

    def finish(self) -> Iterator[tuple[Piece, int, int]]:
        while self.alive.any():
            yield from self._place()

    def _fits_alone(self, p: Piece) -> bool:
        return p.tokens <= self.limits.tokens and p.loss <= self.limits.loss and self.limits.segments >= 1

    def _keep(self, piece: Piece) -> None:
        at = self.free.pop()
        self.waiting[at], self.alive[at] = piece, True
        self.demand[at] = (piece.tokens, 1, piece.loss)

    def _take(self, at: int) -> Piece:
        piece, self.waiting[at], self.alive[at] = self.waiting[at], None, False
        self.free.append(at)
        return piece

    def _cut(self, p: Piece, n: int) -> tuple[Piece, Piece]:
        head = Piece(p.row, p.start, n, max(0, n - 1), p.payload)
        rest = Piece(p.row, p.start + n, p.tokens - n, max(0, p.tokens - n - 1), p.payload)
        return head, rest

    def _place(self) -> Iterator[tuple[Piece, int, int]]:
        """One piece into the open sequence; where none goes, the sequence is closed."""
        left = self.left
        fits = self.alive & (self.demand <= left).all(axis=1)
        if fits.any():
            # both vectors in shares of the limits
            piece = self._take(int(np.argmax(np.where(fits, self.demand @ (left / self.room**2), -1))))
        elif self.cut and left[0] >= 1 and left[1] >= 1 and left[2] >= 0:
            # the largest leaves the largest rest, which fits badly anyway
            at = int(np.argmax(np.where(self.alive, self.demand[:, 0], -1)))
            piece, rest = self._cut(self._take(at), int(min(left[0], left[2] + 1)))
            if rest.tokens:
                self._keep(rest)
        else:
            self._open()
            return
        if self.sequence < 0:
            self.sequence = self._number()
        yield piece, self.sequence, self.offset
        self.offset += piece.tokens
        self.left = left - (piece.tokens, 1, piece.loss)


def pack_examples(examples: DataFrame, n_tokens: str, n_loss: str, limits: Limits = Limits()) -> DataFrame:
    """``examples`` with ``sequence_id`` and ``offset``: uncut examples of instruction data under the three limits.

    Null counts are zero; an example that is over a limit by itself has a
    sequence of its own; repeated rows are packed one by one; of equal demands
    the one that waited in the lowest place goes first; no rows give no rows.
    Other columns stay; those with the new names are replaced.
    """
    columns = [c for c in examples.columns if c not in ("sequence_id", "offset")]
    schema = examples.select(columns).schema.add("sequence_id", "long").add("offset", "long")
    counts = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(x) for c, x in ((n_tokens, "__tokens"), (n_loss, "__loss"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        packer = Packer(limits)

        def rows(placed: list[tuple[Piece, int, int]]) -> Iterator[pa.RecordBatch]:
            if placed:
                arrays = [pa.concat_arrays([p.payload.column(i) for p, _, _ in placed]) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([base + s for _, s, _ in placed], pa.int64()), pa.array([o for _, _, o in placed], pa.int64())], [*columns, "sequence_id", "offset"])

        for batch in batches:
            placed: list[tuple[Piece, int, int]] = []
            n, loss = (batch.column(len(columns) + k).to_pylist() for k in range(2))
            for i in range(batch.num_rows):
                placed += packer.add(Piece(i, 0, n[i], loss[i], batch.slice(i, 1)))
            yield from rows(placed)
        yield from rows([*packer.finish()])

    return examples.select(*columns, *counts).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Pieces of whole texts: ``(id, start, length, ids, doc_tokens, sequence_id, offset)``.

    A document is its token ids and ``end_id`` (alone, for a null or empty
    text); ``ids`` are a piece's ids as little-endian unsigned 32-bit integers.
    Each id lies in exactly one piece; pieces lie in a sequence without gaps.
    Very long texts are packed whole; repeated rows are documents of their own;
    no rows give no rows. Other columns are left out; an id column with the name
    of another of the result's is returned as ``doc_id``.
    """
    name = apart(id, ("start", "length", "ids", "doc_tokens", "sequence_id", "offset"))
    part = docs.select(F.col(id).alias(name), F.col(text).alias("__text"))
    schema = part.select(name).schema
    for c, t in (("start", "long"), ("length", "long"), ("ids", "binary"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")):
        schema = schema.add(c, t)
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        encoder = tokens.encoder(tokenizer)
        packer = Packer(limits, cut=True)
        key_type: list[pa.DataType] = []
        placed: list[tuple] = []

        def rows() -> pa.RecordBatch:
            columns = list(zip(*placed, strict=True))
            types = [key_type[0], pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            placed.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.fieldNames())

        def place(found: Iterator[tuple[Piece, int, int]]) -> None:
            for p, sequence, offset in found:
                doc, ids = p.payload
                placed.append((doc, p.start, p.tokens, ids[4 * p.start : 4 * (p.start + p.tokens)], len(ids) // 4, base + sequence, offset))

        for batch in batches:
            key_type[:] = [batch.column(0).type]
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(value.as_py()) + last
                place(packer.add(Piece(0, 0, len(ids) // 4, len(ids) // 4 - 1, (doc, ids))))
                if len(placed) >= 4096:
                    yield rows()
        place(packer.finish())
        if placed:
            yield rows()

    return part.mapInArrow(run, schema)


def conversation_tokens(turns: DataFrame, tokenizer: str, end_id: int, id: str = "conv_id", role: str = "role", text: str = "text", taught: str = "assistant") -> DataFrame:
    """``(conv_id, n_tokens, n_loss)``: the ids of each conversation, ``end_id`` after every turn, and how many of them bear loss.

    Loss lies on the turns of ``taught`` alone. Null texts are empty; rows with a
    null id are one conversation; repeated turns count each. Sums are built map-side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            n = [len(encoder.ids(x.as_py())) // 4 + 1 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2)], fields)

    part = turns.select(F.col(id).alias("conv_id"), F.col(text).alias("text"), F.coalesce(F.col(role) == taught, F.lit(False)).alias("taught"))
    schema = part.select("conv_id").schema.add("n", "long").add("taught", "boolean")
    fields = schema.fieldNames()
    counted = part.mapInArrow(run, schema)
    return counted.groupBy("conv_id").agg(F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("taught"), F.col("n")).otherwise(0)).alias("n_loss"))
