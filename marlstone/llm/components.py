"""Connected components of an edge table, as joins and aggregates.

Each round hooks every node to the smallest label next to it and then
follows labels once more (pointer jumping), so a chain of length n takes about
log n rounds. Rounds are written to the shared folder; nothing but one counter
reaches the driver. A hub's edges meet in partial aggregates and in plain
sort-merge joins, which Spark can split, never in one group's list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.storage import discard, stash


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the component's smallest node.

    No edges give no rows; loops and repeated edges are harmless; null ends are left out.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live = stash(edges.distinct(), "edges")
    spent = [live]
    hooks: list[DataFrame] = []
    # Contract the graph: every node points at its smallest neighbour or itself,
    # pointers are flattened, and edges between different trees go on.
    while not live.isEmpty():
        pointer = live.select(F.col("b").alias("node"), F.col("a").alias("to")).union(live.select("a", "a")).groupBy("node").agg(F.min("to").alias("root"))
        pointer = stash(pointer, "pointers")
        while True:
            up = pointer.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
            step = stash(pointer.join(up, F.col("root") == F.col("n2")).select("node", F.col("r2").alias("root"), (F.col("r2") != F.col("root")).alias("moved")), "pointers")
            moved = not step.where("moved").isEmpty()
            discard(pointer)
            pointer = step.select("node", "root")
            if not moved:
                break
        hooks.append(pointer)
        left, right = (pointer.select(F.col("node").alias(x), F.col("root").alias("r" + x)) for x in "ab")
        following = live.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        live = stash(following.distinct(), "edges")
        spent.append(live)
    # Later hooks move the roots of earlier ones.
    found = None
    for pointer in reversed(hooks):
        if found is None:
            found = pointer
            continue
        later = found.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        found = stash(pointer.join(later, F.col("root") == F.col("n2"), "left").select("node", F.coalesce("r2", "root").alias("root")), "roots")
    for used in spent[:-1]:
        discard(used)
    return found if found is not None else live.select(F.col("a").alias("node"), F.col("b").alias("root"))
