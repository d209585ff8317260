"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit set where over half of its 4-word shingles'
hashes have it. All distinct fingerprints are compared: they are dealt to
groups, each pair of groups is one cell of a triangle, and a cell's task
holds two groups of fingerprints, sorted by population count and cut in tiles.
A tile pair whose counts differ by more than the radius holds no link and is
skipped; any other is compared by exclusive-or and bit counts. A cell returns
a spanning forest of its links, never the pairs, and components join the forests.

Work: rows are linear up to the distinct fingerprints; their comparison is
quadratic with a small constant, which is the price of exactness at this radius.
A group holds at most ``distinct / groups`` eight-byte values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.llm.text import apart, words
from marlstone.storage import stash

SHINGLE = 4
SEED = 42
_ROWS, _COLS = 256, 2048


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text; 0 for a text without words."""
    tokens = words(text)  # cut first: lower-casing ASCII letters moves no blank
    if not tokens:
        return 0
    line = b" ".join(tokens).lower()
    if len(tokens) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = np.concatenate(([0], ends[:-width])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``fp`` (the fingerprint as a signed long)."""
    rest = [c for c in docs.columns if c not in (text, "fp")]
    schema = docs.select(*rest).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in batch.column("__text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(fp.view(np.int64))], [*rest, "fp"])

    return docs.select(*rest, F.col(text).alias("__text")).mapInArrow(run, schema)


def _forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of both sides (or of one, against itself) and, for each, the smallest position it is linked to in this cell."""
    alone = right is None
    right = left if alone else right
    values = left if alone else np.concatenate((left, right))
    label = np.arange(len(values))
    sides = []
    for base, side in ((0, left), (0 if alone else len(left), right)):
        count = np.bitwise_count(side)
        order = np.argsort(count, kind="stable")
        sides.append((side[order], count[order].astype(np.int64), order + base))
    (a, ca, ia), (b, cb, ib) = sides
    for i in range(0, len(a), _ROWS):
        low, high = ca[i], ca[min(i + _ROWS, len(a)) - 1]
        # only tiles of the other side within the radius of these counts
        first, last = np.searchsorted(cb, low - radius), np.searchsorted(cb, high + radius, side="right")
        first = max(first, i) if alone else first  # the pairs before were met from the other side
        for j in range(first, last, _COLS):
            to = min(j + _COLS, last)
            x, y = np.nonzero(np.bitwise_count(a[i : i + _ROWS, None] ^ b[None, j:to]) <= radius)
            if len(x):
                label = _join(label, ia[i + x], ib[j + y])
    return values, label, np.flatnonzero(label != np.arange(len(values)))


def _join(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Merge the trees of linked positions; labels stay flat."""
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return label
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def links(distinct: DataFrame, radius: int, groups: int) -> DataFrame:
    """Edges ``(a, b)`` that connect ``distinct(fp)`` exactly as all links within the radius do."""
    dealt = distinct.select("fp", F.pmod(F.xxhash64("fp"), F.lit(groups)).cast("int").alias("g"))
    cells = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("h")
    placed = dealt.select("fp", "g", cells).select("fp", "g", F.least("g", "h").alias("i"), F.greatest("g", "h").alias("j"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        fp, g = pdf["fp"].to_numpy().view(np.uint64), pdf["g"].to_numpy()
        left = fp[g == i]
        values, label, moved = _forest(left, fp[g == j] if i != j else None, radius)
        signed = values.view(np.int64)
        return pd.DataFrame({"a": signed[moved], "b": signed[label[moved]]})

    return placed.groupBy("i", "j").applyInPandas(run, "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 4, per_group: int = 24_576, least_groups: int = 6, most_groups: int = 512) -> DataFrame:
    """``(id, fp, component_id)``: one row per input row, with the smallest id reachable by links.

    Texts without words (null, empty, blank) have fingerprint zero and are
    linked like any other. Repeated rows stay and share a component; a null id
    is kept and counts as a member, and where a component has no other id its
    component_id is null. Very long texts are read whole. No rows give no rows.
    Other columns are left out; an id column with the name of one of the columns
    used here is returned as ``doc_id``.

    ``groups`` follows from the number of distinct fingerprints, between the two
    bounds; past ``most_groups * per_group`` values the groups grow instead.
    """
    name = apart(id, ("fp", "component_id", "least_id", "root", "node"))
    docs = docs.select(F.col(id).alias(name), F.col(text).alias("__text"))
    id = name
    rows = stash(fingerprints(docs, "__text"), "fingerprints")
    classes = stash(rows.groupBy("fp").agg(F.min(id).alias("least_id")), "classes")
    n = classes.count()
    groups = max(least_groups, min(most_groups, -(-n // per_group)))
    found = components(links(classes.select("fp"), radius, groups))
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = stash(rooted, "rooted")
    least = stash(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    members = stash(rooted.join(least, "root").select("fp", "component_id"), "members")
    return rows.join(members, "fp").select(id, "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
