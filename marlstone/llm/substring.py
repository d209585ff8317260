"""Removal of repeated passages with prefix-partitioned sparse suffix trees.

A passage counts as repeated if ``width`` consecutive words of a document also
start anywhere else. The suffix tree over all word positions would be far larger
than the corpus, so it is never held as a whole:

* Of the suffixes, only those at anchors enter. In every window of ``width``
  words the ``PREFIX``-word gram with the least hash is its anchor, so equal
  windows have equal anchors at equal places, and consecutive windows mostly
  share theirs (about one position in ten is an anchor).
* Suffixes are split by prefixes of variable length until a group is at most
  ``group`` suffixes, which is a few hundred kilobytes. An anchor's gram is its
  suffix's first prefix; one that comes once in the corpus is a leaf and is
  dropped before any text moves. Where a prefix has more suffixes than a group
  may hold, the suffixes of the windows themselves take its place, split by
  the shortest of ``LONGER`` prefixes that is rare enough. Equal windows of one
  slice are counted first, so a passage that every document holds moves once
  a slice; what even the longest prefix does not split is grouped by
  the whole window's words, with map-side counts.
* A group's subtree is a suffix array with the lengths of common prefixes of
  neighbours, both by words: its internal nodes are the runs of neighbours with
  a common prefix, and the leaves below a node of depth ``width`` or more
  are the places of maximal repeats.
* Texts that are copies of one another are told apart first by digest: all but
  one stay out of the subtrees, and every window of theirs is repeated.

Texts are shuffled twice (to meet their anchors, to meet their repeats), those
with frequent anchors a third time; prefixes and places otherwise move as
fixed-size rows. A task holds one slice of texts or a few subtrees. Lists
gathered by key are sets of one document's places. Places are linked to windows
by 128-bit digests; windows are compared by words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.text import hashable, slices, words
from marlstone.storage import discard, stash

WIDTH = 35
PREFIX = 16
#: Lengths in words of the prefixes of windows under frequent anchors.
LONGER = (20, 25, 30)
#: Odd multipliers of the two rolling hashes, and their inverses modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SLICE = 1 << 20
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


class Scan:
    """Word hashes of some texts end to end, their anchors and their windows."""

    def __init__(self, texts: list[list[bytes]], width: int):
        self.width = width
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        total = int(self.sizes.sum())
        digest = xxhash.xxh64_intdigest
        self.hashes = np.fromiter((digest(w) for t in texts for w in t), np.uint64, total)
        self.total = total

    def rolling(self, length: int, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each run of ``length`` words (runs over a text's end included, to be left out later)."""
        n = self.total - length + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        base = _BASES[which]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hashes * _powers(base, self.total), dtype=np.uint64)))
        x = (sums[length:] - sums[:n]) * _powers(pow(base, -1, 1 << 64), n)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return x

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window starts, each one's anchor, and the grams' hashes."""
        grams = self.rolling(PREFIX)
        span = self.width - PREFIX + 1  # grams in a window
        n = self.total - self.width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64), grams
        best, reach = np.arange(len(grams)), 1
        while reach < span:  # leftmost least gram among `reach`, then among more
            step = min(reach, span - reach)
            a, b = best[: len(best) - step], best[step:]
            best = np.where(grams[b] < grams[a], b, a)
            reach += step
        inside = np.zeros(n, bool)
        for s, k in zip(self.starts.tolist(), self.sizes.tolist(), strict=True):
            if k >= self.width:
                inside[s : s + k - self.width + 1] = True
        at = np.flatnonzero(inside)
        return at, best[at], grams


def _keyed(docs: DataFrame, text: str, rest: list[str]) -> DataFrame:
    """``(k1, k2, text, rest)``: the other columns in one struct, out of the way of every name used here.

    The 128-bit key tells texts apart and spreads copies; repeated rows share it.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    seen = [F.col(f"`{c}`") for c in rest if hashable(docs.schema[c].dataType)]
    key = [F.xxhash64(F.lit(salt), body, *seen).alias(k) for salt, k in (("one", "k1"), ("two", "k2"))]
    return docs.select(*key, F.col(text).alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias("__none")).alias("rest"))


def _prefix_counts(texts: DataFrame, width: int) -> DataFrame:
    """``(h, n)`` of the anchors' prefixes, counted within each slice first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                scan = Scan([words(x.as_py()) for x in part.column("text")], width)
                _, anchor, grams = scan.anchors()
                h, n = np.unique(grams[np.unique(anchor)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _anchor_rows(texts: DataFrame, width: int) -> DataFrame:
    """``(h, k1, pos)`` for every anchor; half a key will do, for a stranger's position only costs a needless look."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                scan = Scan([words(x.as_py()) for x in part.column("text")], width)
                _, anchor, grams = scan.anchors()
                own = np.unique(anchor)
                row = np.searchsorted(scan.starts, own, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(grams[own].view(np.int64)), part.column("k1").take(pa.array(row)), pa.array((own - scan.starts[row]).astype(np.int32))], ["h", "k1", "pos"])

    return texts.select("k1", "text").mapInArrow(run, "h long, k1 long, pos int")


_SUFFIXES = "part long, k1 long, k2 long, pos int, n int, words binary"
_WINDOWS = "k1 long, k2 long, pos int, w1 long, w2 long, n int, words binary, " + ", ".join(f"q{i} long" for i in range(len(LONGER)))


def _parts(met: DataFrame, schema: str, width: int, live: str, rows) -> DataFrame:
    """``rows`` for each slice of the texts, copies that stay out excepted; ``met`` has their ``live`` anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(batch.column("k2").to_pylist(), batch.column("asides").to_pylist(), strict=True)
            used = batch.filter(pa.array([not aside or k2 not in aside for k2, aside in own], pa.bool_()))
            for part in slices(used, "text", _SLICE):
                texts = [words(x.as_py()) for x in part.column("text")]
                scan = Scan(texts, width)
                at, anchor, grams = scan.anchors()
                marked = _marked(part, live, scan)
                if len(at) and len(marked):
                    k1, k2 = (np.asarray(part.column(c)) for c in ("k1", "k2"))
                    yield rows(scan, texts, at, anchor, grams, marked, k1, k2)

    return met.select("k1", "k2", "text", live, "asides").mapInArrow(run, schema)


def _marked(part: pa.RecordBatch, column: str, scan: Scan) -> np.ndarray:
    """The listed positions of all rows, counted from the slice's first word."""
    rows = zip(part.column(column).to_pylist(), scan.starts.tolist(), scan.sizes.tolist(), strict=True)
    lists = [s + a[a < n] for x, s, n in rows if x and len(a := np.asarray(x, np.int64))]
    return np.unique(np.concatenate(lists)) if lists else np.empty(0, np.int64)


def _runs(scan, texts, at, anchor, grams, live, k1, k2) -> pa.RecordBatch:
    """The words around each anchor whose prefix is rare enough."""
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1  # a run of windows shares its anchor
    own = np.isin(anchor[first], live)
    p0, p1, a = at[first[own]], at[last[own]], anchor[first[own]]
    row = np.searchsorted(scan.starts, a, side="right") - 1
    start = p0 - scan.starts[row]
    n = p1 - p0 + 1
    held = [b" ".join(texts[r][s : s + k + scan.width - 1]) for r, s, k in zip(row.tolist(), start.tolist(), n.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(grams[a].view(np.int64)), pa.array(k1[row]), pa.array(k2[row]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(held, pa.binary())],
        ["part", "k1", "k2", "pos", "n", "words"],
    )


def _windows(scan, texts, at, anchor, grams, live, k1, k2) -> pa.RecordBatch:
    """The windows of frequent anchors: a row for each place, the words (and how many places) with the first of equal ones."""
    own = at[np.isin(anchor, live)]
    row = np.searchsorted(scan.starts, own, side="right") - 1
    start = own - scan.starts[row]
    lengths = [n for n in LONGER if n < scan.width]
    first: dict[bytes, int] = {}
    node = np.array([first.setdefault(b" ".join(texts[r][s : s + scan.width]), i) for i, (r, s) in enumerate(zip(row.tolist(), start.tolist(), strict=True))], np.int64)
    held: list[bytes | None] = [None] * len(own)
    for w, i in first.items():
        held[i] = w
    digests = {i: xxhash.xxh3_128_digest(w) for w, i in first.items()}
    links = np.frombuffer(b"".join([digests[i] for i in node.tolist()]), np.int64).reshape(-1, 2)
    counts = np.bincount(node, minlength=len(own))
    prefixes = [scan.rolling(n)[own].view(np.int64) for n in lengths]
    prefixes += [links[:, 0]] * (len(LONGER) - len(lengths))
    return pa.RecordBatch.from_arrays(
        [pa.array(k1[row]), pa.array(k2[row]), pa.array(start.astype(np.int32)), pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy()), pa.array(counts.astype(np.int32)), pa.array(held, pa.binary()), *(pa.array(q.copy()) for q in prefixes)],
        ["k1", "k2", "pos", "w1", "w2", "n", "words", *(f"q{i}" for i in range(len(LONGER)))],
    )


class Subtree:
    """The suffix tree of some word sequences, as suffix array (``order``) and lengths of common prefixes (``common``).

    ``common[i]`` is that of the suffixes ``order[i]`` and ``order[i + 1]``; an internal
    node of depth ``d`` is a longest run of neighbours with ``d`` words in common.
    """

    def __init__(self, tokens: np.ndarray, most: int):
        """``tokens`` ends each sequence with a number of its own; no sequence is longer than ``most``."""
        # names of the runs of 1, 2, 4, ... words, numbered in their order
        self.names = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
        reach = 1
        while reach <= most:
            name = self.names[-1]
            after = np.concatenate((name[reach:] + 1, np.zeros(min(reach, len(name)), np.int64)))
            self.names.append(np.unique(name * (int(after.max(initial=0)) + 1) + after, return_inverse=True)[1].astype(np.int64))
            reach *= 2
        self.order = np.argsort(self.names[-1])  # by now all suffixes differ
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        self.common = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names) - 1)):
            name = np.append(self.names[k], [-1, -2])  # suffixes that end here have nothing in common
            same = name[np.minimum(a, len(tokens))] == name[np.minimum(b, len(tokens) + 1)]
            step = same.astype(np.int64) << k
            a += step
            b += step
            self.common += step

    def deep(self, depth: int) -> np.ndarray:
        """The suffixes below the internal nodes of at least this depth."""
        near = np.concatenate(([False], self.common >= depth, [False]))
        return self.order[near[1:] | near[:-1]] if len(self.order) else self.order


def subtree_repeats(held: list[bytes], n: np.ndarray, width: int) -> np.ndarray:
    """For each sequence's first ``n`` places, the bits of those below an internal node of depth ``width``."""
    known: dict[bytes, int] = {}
    sizes = n + width - 1
    ends = np.cumsum(sizes + 1) - 1  # each sequence has an end of its own
    tokens = np.empty(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(tokens), bool)
    inside[ends] = False
    tokens[inside] = [known.setdefault(w, len(known)) for w in b" ".join(held).split()]
    tokens[ends] = len(known) + np.arange(len(ends))
    place = Subtree(tokens, int(sizes.max())).deep(width)
    row = np.searchsorted(ends, place)
    bit = place - (ends[row] - sizes[row])
    bits = np.zeros(len(n), np.int64)
    np.bitwise_or.at(bits, row, np.int64(1) << bit)  # a place of depth `width` is one of the first n
    return bits


def _subtrees(rows: DataFrame, width: int) -> DataFrame:
    """The groups' suffixes with repeats, as ``(k1, k2, pos, bits)``."""
    dealt = rows.repartition("part").sortWithinPartitions("part")
    columns = ["k1", "k2", "pos", "bits"]

    def answer(group: pa.Table) -> pa.RecordBatch | None:
        bits = subtree_repeats(group.column("words").to_pylist(), np.asarray(group.column("n")).astype(np.int64), width)
        some = np.flatnonzero(bits)
        if not len(some):
            return None
        found = group.take(pa.array(some))
        return pa.RecordBatch.from_arrays([*(found.column(c).combine_chunks() for c in columns[:3]), pa.array(bits[some])], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                waiting.append(batch.slice(at, min(4096, batch.num_rows - at)))
                if sum(x.num_rows for x in waiting) >= 8192:
                    # whole subtrees only: the last one may go on
                    whole = pa.Table.from_batches(waiting)
                    keys = np.asarray(whole.column("part"))
                    end = int(np.searchsorted(keys, keys[-1]))
                    if end:
                        if (out := answer(whole.slice(0, end))) is not None:
                            yield out
                        waiting = whole.slice(end).combine_chunks().to_batches()
        if waiting and (out := answer(pa.Table.from_batches(waiting))) is not None:
            yield out

    return dealt.mapInArrow(run, "k1 long, k2 long, pos int, bits long")


def _nodes(windows: DataFrame, width: int, group: int) -> DataFrame:
    """``(w1, w2)`` of the windows that come more than once; ``windows`` has a row a slice for each, with ``n`` places there."""
    rest = windows
    for i in range(len(LONGER)):
        rest = rest.join(rest.groupBy(f"q{i}").agg(F.count("*").alias("size")).where(F.col("size") > group).select(f"q{i}", F.lit(True).alias(f"over{i}")), f"q{i}", "left")
    part = F.lit(None).cast("long")
    for i in reversed(range(len(LONGER))):
        part = F.when(F.col(f"over{i}").isNull(), F.col(f"q{i}")).otherwise(part)
    rest = rest.withColumn("part", part)
    grouped = rest.where("part IS NOT NULL").select("part", F.col("w1").alias("k1"), F.col("w2").alias("k2"), F.lit(0).alias("pos"), F.lit(1).alias("n"), "words")
    deep = _subtrees(grouped, width).select(F.col("k1").alias("w1"), F.col("k2").alias("w2"))
    saturated = rest.where("part IS NULL").groupBy("w1", "w2", "words").agg(F.sum("n").alias("n")).where("n > 1")
    return deep.unionByName(saturated.select("w1", "w2")).unionByName(windows.where("n > 1").select("w1", "w2")).distinct()


def repeats(texts: DataFrame, width: int, group: int) -> DataFrame:
    """``(k1, k2, whole, starts)`` of texts with repeats: runs of window starts as ``(pos, bits)``."""
    live = stash(_prefix_counts(texts, width).where("n > 1"), "prefixes")
    # copies: one of each class stands for all
    told = texts.select("k1", "k2", F.xxhash64(F.lit("one"), "text").alias("t1"), F.xxhash64(F.lit("two"), "text").alias("t2"))
    classes = told.groupBy("t1", "t2").agg(F.min(F.struct("k1", "k2")).alias("least"), F.count("*").alias("n")).where("n > 1").select("t1", "t2", "least")
    classes = stash(classes, "classes")
    copies = told.join(classes, ["t1", "t2"]).select("k1", "k2", F.lit(True).alias("whole"), (F.struct("k1", "k2") != F.col("least")).alias("aside"))
    copies = stash(copies.distinct(), "copies")
    # live anchors of each text; sets, for repeated rows share their key
    anchors = _anchor_rows(texts, width).join(live, "h").select("k1", "pos", (F.col("n") > group).alias("frequent"))
    lists = anchors.groupBy("k1").agg(F.collect_set(F.when(~F.col("frequent"), F.col("pos"))).alias("rare"), F.collect_set(F.when(F.col("frequent"), F.col("pos"))).alias("often"))
    asides = copies.where("aside").groupBy("k1").agg(F.collect_set("k2").alias("asides"))  # one, but for strangers
    lists = stash(lists.join(asides, "k1", "left"), "anchors")
    discard(live)
    discard(classes)
    met = texts.join(lists.where(F.size("rare") > 0).drop("often"), "k1")
    found = stash(_subtrees(_parts(met, _SUFFIXES, width, "rare", _runs), width), "repeats")
    met = texts.join(lists.where(F.size("often") > 0).drop("rare"), "k1")
    places = stash(_parts(met, _WINDOWS, width, "often", _windows), "windows")
    discard(lists)
    nodes = stash(_nodes(places.where("words IS NOT NULL"), width, group), "nodes")
    deep = places.join(nodes, ["w1", "w2"], "left_semi").select("k1", "k2", "pos", F.lit(1).cast("long").alias("bits"))
    every = found.unionByName(deep).groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "bits")).alias("starts"))
    return every.join(copies.groupBy("k1", "k2").agg(F.max("whole").alias("whole")), ["k1", "k2"], "full_outer")


def remaining(tokens: list[bytes], starts: list[dict] | None, whole: bool, width: int) -> list[bytes]:
    """The words that no repeated window covers."""
    if len(tokens) < width or not (whole or starts):
        return tokens
    if whole:
        return []
    edge = np.zeros(len(tokens) + 1, np.int32)
    pos = np.array([s["pos"] for s in starts], np.int64)
    bits = np.array([s["bits"] for s in starts], np.int64)
    for k in range(int(bits.max()).bit_length()):
        at = pos[bits >> k & 1 == 1] + k
        np.add.at(edge, at, 1)
        np.add.at(edge, at + width, -1)
    keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return [tokens[i] for i in keep.tolist()]


def remove_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, group: int = 500) -> DataFrame:
    """``docs`` with ``kept`` (the remaining words, joined by one blank), ``n_words`` and ``n_removed`` instead of the text.

    Words are ``[^\\x20\\x09-\\x0D]+``. Windows are judged on the input, in the
    same document too; a text under ``width`` words keeps all of them; null and
    empty texts have none; a very long text is worked on whole. Repeated rows are
    copies of each other and have equal results, so ties need no choice. Other
    columns of any type and name stay, but those with the names of the new
    ones, which are replaced; no rows give no rows. ``width`` is at least
    ``PREFIX``. ``group`` bounds a subtree's suffixes and has no effect on the result.
    """
    if not PREFIX <= width <= PREFIX + 62:
        raise ValueError(f"width must lie between {PREFIX} and {PREFIX + 62}")
    rest = [c for c in docs.columns if c not in (text, "kept", "n_words", "n_removed")]
    texts = _keyed(docs, text, rest)
    found = repeats(texts.select("k1", "k2", "text"), width, group)
    joined = texts.join(found, ["k1", "k2"], "left").select("rest", "text", "starts", F.coalesce("whole", F.lit(False)).alias("whole"))
    schema = joined.select("rest").schema.add("kept", "string").add("n_words", "long").add("n_removed", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                kept, counts, removed = [], [], []
                for value, starts, whole in zip(part.column("text"), part.column("starts"), part.column("whole").to_pylist(), strict=True):
                    tokens = words(value.as_py())
                    left = remaining(tokens, starts.as_py(), whole, width)
                    kept.append(b" ".join(left).decode("utf-8", "replace"))
                    counts.append(len(tokens))
                    removed.append(len(tokens) - len(left))
                yield pa.RecordBatch.from_arrays([part.column("rest"), pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], schema.fieldNames())

    return joined.mapInArrow(run, schema).select(*(F.col("rest").getField(c).alias(c) for c in rest), "kept", "n_words", "n_removed")
