"""Benchmark passages in documents, found by pigeonhole edit matching.

Texts and items are folded to lower-case words. An item of ``m`` folded
characters may be met with up to ``e = rate * m`` edits; cut in ``e + 1``
pieces, at least one piece survives any such edits unchanged. All pieces go
into one Aho-Corasick automaton, which finds the exact piece hits in one pass
over a text; the stretches that a passage around a hit may cover are merged, and
Myers' bit-parallel algorithm finds the passages within budget there.
An item so short that its budget is zero is a single piece of the same automaton, and is met
only from word boundary to word boundary.

The items are dealt to blocks of about ``block_bytes`` by a hash and written to
the shared folder; a worker reads a block, builds its automaton once and keeps
it for the tasks that follow. The documents are read once for each block and
never shuffled. The driver holds no items.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.dataset
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.text import apart
from marlstone.storage import discard, scratch, stash

_WORD = re.compile(r"[^\W_]+")


def _lower(text: str) -> str:
    """Lower case, code point for code point: one letter grows otherwise, one depends on its neighbours."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c.lower()[0] for c in text)
    return lower.replace("ς", "σ")


def fold(text: str | None) -> str:
    """Lower-case words joined by single blanks."""
    return " ".join(_WORD.findall(_lower(text))) if text else ""


def fold_with_places(text: str) -> tuple[str, list[int], list[int]]:
    """The folded text with, for each of its words, the folded and the original start."""
    parts, here, there, at = [], [], [], 0
    for m in _WORD.finditer(_lower(text)):
        parts.append(m.group())
        here.append(at)
        there.append(m.start())
        at += m.end() - m.start() + 1
    return " ".join(parts), here, there


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` consecutive pieces of nearly equal length, with their offsets."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(m: int, masks: dict[str, int], text: str, errors: int) -> tuple[int, int] | None:
    """``(distance, end)`` of the first passage of ``text`` within ``errors`` edits of an item of ``m`` letters.

    Ends of one passage lie within twice the budget of each other: of those, the
    first with the least distance counts. None where there is no such passage.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end, stop = errors + 1, 0, len(text)
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1  # the first row is zero: a match may start anywhere
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            if best > errors:
                stop = j + 2 * errors
            best, end = score, j
        if j >= stop:
            break
    return (best, end) if best <= errors else None


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


#: Scripts written without blanks: any code point may begin a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3038-\u303b\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U000323af]")


def _boundary(folded: str, at: int) -> bool:
    """Whether a word may begin or end between ``folded[at - 1]`` and ``folded[at]``."""
    if at <= 0 or at >= len(folded):
        return True
    pair = folded[at - 1 : at + 1]
    return " " in pair or _UNSPACED.search(pair) is not None


class Matcher:
    """The items of one block, ready for a pass over texts; those without a budget are matched as whole words."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items: list[tuple[int, str, int, dict[str, int] | None]] = []  # items without a budget have no masks
        self.automaton = ahocorasick.Automaton()
        for item_id, folded in items:
            errors = int(rate * len(folded))
            k = len(self.items)
            self.items.append((item_id, folded, errors, letter_masks(folded) if errors else None))
            for offset, piece in pieces(folded, errors):
                found = self.automaton.get(piece, None)
                if found is None:
                    self.automaton.add_word(piece, (len(piece), [(k, offset)]))
                else:
                    found[1].append((k, offset))
        if self.items:
            self.automaton.make_automaton()

    def search(self, folded: str) -> list[tuple[int, int, int, int]]:
        """``(item_id, start, end, distance)`` in folded characters: one row for each separate passage."""
        bands: dict[int, list[int]] = {}
        for end, (size, places) in self.automaton.iter(folded) if self.items and folded else ():
            for k, offset in places:
                bands.setdefault(k, []).append(end + 1 - size - offset)
        out = []
        for k, starts in bands.items():
            item_id, item, errors, masks = self.items[k]
            starts.sort()
            i, done = 0, -1
            if masks is None:
                for start in starts:
                    end = start + len(item)
                    if start >= done and _boundary(folded, start) and _boundary(folded, end):
                        out.append((item_id, start, end, 0))
                        done = end
                continue
            while i < len(starts):
                a, b = starts[i] - errors, 0
                while i < len(starts) and (not b or starts[i] - errors <= b):
                    b = starts[i] + len(item) + errors
                    i += 1
                for start, end, distance in _passages(item, errors, masks, folded, max(a, done, 0), min(b, len(folded))):
                    out.append((item_id, start, end, distance))
                    done = end
        return out


def _passages(item: str, errors: int, masks: dict[str, int], folded: str, a: int, b: int) -> Iterator[tuple[int, int, int]]:
    """The passages within ``folded[a:b]`` from left to right; each begins behind the one before it, and is the shortest with its end and distance."""
    while found := myers(len(item), masks, folded[a:b], errors):
        distance, end = found
        end += a
        head = folded[max(a, end - len(item) - distance) : end]
        _, length = myers(len(item), letter_masks(item[::-1]), head[::-1], distance)
        yield end - length, end, distance
        a = end


#: Names of the result's columns beside the id.
FOUND = ("item_id", "start", "end", "distance")


def matches(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = 0.08, block_bytes: int = 8 << 20) -> DataFrame:
    """``(id, item_id, start, end, distance)`` for every passage of ``docs`` within an item's edit budget.

    ``start`` and ``end`` are code points of the original text (of the first
    word and of the first word after the passage, or the text's end). Passages of
    an item do not overlap: they are taken from left to right, each the best of
    the ends within twice the budget behind the first that is within it (the
    first of equally good ones, and the shortest with that end).

    An item's budget is ``rate`` times its folded characters, rounded down, at any
    length. Where that is zero the item is met only from word boundary to word boundary (at any code point in
    scripts without blanks). Items without words and null items are left out;
    null and empty texts match nothing; very long texts are searched whole;
    repeated rows, and items with equal texts, are each reported; null ids stay
    null; no documents or no items give no rows. Other columns are left out. An
    id column that is called like one of the result's others is returned as ``doc_id``.
    """
    name = apart(id, FOUND)
    part = docs.select(F.col(id).alias(name), F.col(text).alias("__text"))
    schema = part.select(name).schema.add("item_id", "long").add("start", "long").add("end", "long").add("distance", "integer")
    found = docs.sparkSession.createDataFrame([], schema)
    for n, block in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        own = part.mapInArrow(_searcher(block, rate, schema.fieldNames()), schema)
        found = found.unionByName(own) if n else own
    return found


def without_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = 0.08, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no passage that :func:`matches` would report, with all their columns.

    Each row is judged by its own text, so ids do not matter; null and empty
    texts stay. Past the first block of the benchmark, what is left is written
    before the next block is tried.
    """
    left, written = docs, None
    for n, block in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        if n:
            before, written = written, stash(left, "clean")
            left = written
            if before is not None:
                discard(before)
        left = left.mapInArrow(_keeper(block, rate, docs.columns.index(text)), docs.schema)
    return left


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int) -> list[str]:
    """The folders of the blocks of items."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).where("text <> ''")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(total / block_bytes)
    if not blocks:
        return []
    path = scratch(spark, "benchmark")
    dealt = items.distinct().withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    dealt.repartition(blocks, "block").write.partitionBy("block").parquet(path)
    return [f"{path}/block={i}" for i in range(blocks)]


_KEPT: dict[tuple[str, float], Matcher] = {}


def _matcher(block: str, rate: float) -> Matcher:
    """This worker's matcher of a block; it keeps one."""
    key = (block, rate)
    if key not in _KEPT:
        _KEPT.clear()
        system, path = fs.FileSystem.from_uri(block)
        rows: list[tuple[int, str]] = []
        if system.get_file_info(path).type == fs.FileType.Directory:
            found = pyarrow.dataset.dataset(path, filesystem=system, format="parquet").to_table(["item", "text"])
            rows = [(i, x) for i, t in zip(*(found.column(c).to_pylist() for c in ("item", "text")), strict=True) if (x := fold(t))]
        _KEPT[key] = Matcher(rows, rate)
    return _KEPT[key]


def _keeper(block: str, rate: float, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(block, rate)
        for batch in batches:
            clean = [not value or not matcher.search(fold(value)) for value in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def _searcher(block: str, rate: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(block, rate)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i, value in enumerate(batch.column(1).to_pylist()):
                if not value:
                    continue
                hits = matcher.search(fold(value))
                if not hits:
                    continue
                _, here, there = fold_with_places(value)
                for item, start, end, distance in hits:
                    first = max(0, _right(here, start) - 1)
                    after = _right(here, end - 1)
                    for column, x in zip(rows, (i, item, there[first], there[after] if after < len(there) else len(value), distance), strict=True):
                        column.append(x)
            ids = batch.column(0).take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in rows[1:4]), pa.array(rows[4], pa.int32())], names)

    return run


def _right(starts: list[int], at: int) -> int:
    from bisect import bisect_right

    return bisect_right(starts, at)
