"""Patterns of several edges over vertex and edge tables.

A graph is two tables: ``vertices(id, label, props)`` and ``edges(src, dst, label, props)``, where ``props``
is a map of strings. A pattern is a tree of named vertices joined by edges, each with a label
and conditions on its properties.

Before anything is joined, every step's candidates are reduced by semi-joins, first from the leaves to the
root and then back. After that each candidate is part of some match, so no join
makes a row that a later one drops: what is between the joins is never larger than
what the result needs, also where a hub has edges that lead nowhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.storage import stash


@dataclass(frozen=True)
class Vertex:
    """A vertex of the pattern: its name, label (any if None) and condition on ``props``."""

    name: str
    label: str | None = None
    where: str | None = None


@dataclass(frozen=True)
class Edge:
    """An edge between two named vertices, ``source`` to ``target``; ``name`` None keeps it out of the result."""

    source: str
    target: str
    label: str | None = None
    where: str | None = None
    name: str | None = None


@dataclass(frozen=True)
class Pattern:
    vertices: tuple[Vertex, ...]
    edges: tuple[Edge, ...] = field(default=())

    def order(self) -> list[tuple[Edge, str, str]]:
        """``(edge, known, new)``: the edges from the first vertex outwards; an error where they form no tree."""
        names = [v.name for v in self.vertices]
        if not names or len({*names}) < len(names) or any(x not in names for e in self.edges for x in (e.source, e.target)):
            raise ValueError("vertices must have names of their own, and edges must join them")
        met, left, out = {names[0]}, list(self.edges), []
        while left:
            for e in left:
                if (e.source in met) != (e.target in met):
                    known, new = (e.source, e.target) if e.source in met else (e.target, e.source)
                    break
            else:
                raise ValueError("the edges must form a tree that joins all vertices")
            out.append((e, known, new))
            met.add(new)
            left.remove(e)
        if len(met) < len(names):
            raise ValueError("the edges must form a tree that joins all vertices")
        return out


def _matching(rows: DataFrame, label: str | None, where: str | None) -> DataFrame:
    rows = rows.where(F.col("label") == label) if label is not None else rows
    return rows.where(where) if where else rows


def match(vertices: DataFrame, edges: DataFrame, pattern: Pattern) -> DataFrame:
    """All matches of ``pattern``: for each vertex its id under its name and its properties under ``<name>_props``; for each named edge its properties.

    Different names may meet one vertex. Repeated edges give a match each. Vertices with null ids and edges with null
    ends match nothing; a null label is no label. No matches give no rows. Every candidate table is
    written once for each direction, so lost executors cost a re-read.
    """
    steps = pattern.order()
    kept = {v.name: _matching(vertices, v.label, v.where).where("id IS NOT NULL").select("id", "props") for v in pattern.vertices}
    ways = {}
    for e, known, new in steps:
        near, far = ("src", "dst") if known == e.source else ("dst", "src")
        ways[new] = _matching(edges, e.label, e.where).select(F.col(near).alias("near"), F.col(far).alias("far"), "props").where("near IS NOT NULL AND far IS NOT NULL")
    # from the leaves to the first vertex: edges that lead to a candidate, and candidates that have such edges
    for _, known, new in reversed(steps):
        ways[new] = stash(ways[new].join(kept[new].select(F.col("id").alias("far")), "far", "left_semi"), "edges")
        kept[known] = kept[known].join(ways[new].select(F.col("near").alias("id")), "id", "left_semi")
    first = pattern.vertices[0].name
    kept[first] = stash(kept[first], "vertices")
    # and back
    for _, known, new in steps:
        ways[new] = stash(ways[new].join(kept[known].select(F.col("id").alias("near")), "near", "left_semi"), "edges")
        kept[new] = stash(kept[new].join(ways[new].select(F.col("far").alias("id")), "id", "left_semi"), "vertices")

    def named(name: str) -> list[Column]:
        return [F.col("id").alias(name), F.col("props").alias(f"{name}_props")]

    found = kept[first].select(*named(first))
    for e, known, new in steps:
        props = [F.col("props").alias(f"{e.name}_props")] if e.name else []
        found = found.join(ways[new].select(F.col("near").alias(known), F.col("far").alias(new), *props), known)
        found = found.join(kept[new].select(*named(new)), new)
    return found


def properties(*columns: str) -> Column:
    """Columns as a map of strings; null values are left out."""
    pairs = F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in columns))
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("props")
