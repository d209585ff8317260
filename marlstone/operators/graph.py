"""Graphs and hierarchies on edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.storage import discard, stash


def _single(edges: DataFrame) -> DataFrame | None:
    """The distinct ``(child, parent)``, written, if no child has a second parent."""
    held = stash(edges.where("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct(), "parents")
    if held.groupBy("child").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return held
    discard(held)
    return None


def _doubled(step: DataFrame) -> DataFrame:
    """From ``(child, up)``, one parent a child, who is twice as far up."""
    return step.select("child", F.col("up").alias("m")).join(step.select(F.col("child").alias("m"), "up"), "m").select("child", "up")


def _jumps(edges: DataFrame) -> list[DataFrame] | None:
    """``(child, up)`` at 1, 2, 4, ... steps up a forest; None if a child has several parents or is above itself."""
    first = _single(edges)
    if first is None:
        return None
    steps = [first.select("child", F.col("parent").alias("up"))]
    ends = steps[0].select("up").distinct().count()
    while True:
        last = stash(_doubled(steps[-1]), "jumps")
        reached = last.select("up").distinct().count()
        if reached == 0:
            discard(last)
            return steps
        steps.append(last)
        if reached == ends:  # from there a step leads to all of them and nowhere else: rings
            for step in steps:
                discard(step)
            return None
        ends = reached


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node")).union(edges.select("parent")).where("node IS NOT NULL").distinct()


def reachable(edges: DataFrame) -> DataFrame:
    """HIE-03: every ``(ancestor, node, distance)`` of ``edges(child, parent)``, each node at distance 0 of itself.

    In a forest each path is made once: all paths under a length are carried that length
    further up. Elsewhere paths double in each round, distances are the least, and it
    ends when a round adds no pair, with cycles too. Both take log n joins for a chain of length n.
    Rounds are written to the shared folder.
    """
    jumps = _jumps(edges)
    if jumps is None:
        return _closure(edges)
    paths = stash(_nodes(edges).select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("distance")), "paths")
    rounds = [paths]
    for k, step in enumerate(jumps):
        # a node's ancestors from 2^k steps on are those of who is 2^k steps up
        every = reduce(DataFrame.union, rounds)
        further = every.select("ancestor", F.col("node").alias("up"), "distance").join(step, "up")
        rounds.append(stash(further.select("ancestor", F.col("child").alias("node"), (F.col("distance") + 2**k).alias("distance")), "paths"))
    for step in jumps:
        discard(step)
    return reduce(DataFrame.union, rounds)


def ancestors(edges: DataFrame, start: DataFrame) -> DataFrame:
    """HIE-03 for the nodes of ``start(node)`` alone: ``(ancestor, node, distance)``; nodes without an edge are left out."""
    jumps = _jumps(edges)
    known = start.select("node").distinct().join(_nodes(edges), "node", "left_semi")
    if jumps is None:
        return _closure(edges).join(known, "node", "left_semi").select("ancestor", "node", "distance")
    paths = stash(known.select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("distance")), "paths")
    for k, step in enumerate(jumps):
        further = paths.join(step, F.col("ancestor") == F.col("child")).select(F.col("up").alias("ancestor"), "node", (F.col("distance") + 2**k).alias("distance"))
        used, paths = paths, stash(paths.union(further), "paths")
        discard(used)
    for step in jumps:
        discard(step)
    return paths


def climbed(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """HIE-05/07: ``(node, top, distance, total)``: each node's farthest ancestor, how far, and the sum of ``weight`` (of ``node``) over itself and its ancestors.

    In a forest a row a node climbs twice as far in each round; no path is listed.
    """
    weight = F.lit(0) if weight is None else weight
    jumps = _jumps(edges)
    if jumps is None:
        paths = _closure(edges).withColumnRenamed("node", "low").withColumnRenamed("ancestor", "node")
        paths = paths.select(F.col("low"), "node", "distance", weight.cast("long").alias("w"))
        return paths.groupBy(F.col("low").alias("node")).agg(F.max_by("node", F.struct("distance", "node")).alias("top"), F.max("distance").alias("distance"), F.sum("w").alias("total"))
    at = stash(_nodes(edges).select("node", F.col("node").alias("top"), F.lit(0).alias("distance"), weight.cast("long").alias("total")), "climbed")
    for k, step in enumerate(jumps):
        above = step.join(at.select(F.col("node").alias("up"), F.col("top").alias("t"), (F.col("distance") + 2**k).alias("d"), F.col("total").alias("s")), "up").select(F.col("child").alias("node"), "t", "d", "s")
        used = at
        at = stash(at.join(above, "node", "left").select("node", F.coalesce("t", "top").alias("top"), F.coalesce("d", "distance").alias("distance"), (F.col("total") + F.coalesce("s", F.lit(0))).alias("total")), "climbed")
        discard(used)
        discard(step)
    return at


def _closure(edges: DataFrame) -> DataFrame:
    """:func:`reachable` for any graph."""
    base = edges.where("child IS NOT NULL AND parent IS NOT NULL").select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("distance")).distinct()
    paths = stash(_nodes(edges).select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("distance")).union(base), "paths")
    before = paths.count()
    while True:
        up, down = (paths.select(F.col("ancestor").alias(a), F.col("node").alias(b), F.col("distance").alias(n)) for a, b, n in (("x", "m", "n1"), ("m", "y", "n2")))
        longer = up.join(down, "m").select(F.col("x").alias("ancestor"), F.col("y").alias("node"), (F.col("n1") + F.col("n2")).alias("distance"))
        used, paths = paths, stash(longer.groupBy("ancestor", "node").agg(F.min("distance").alias("distance")), "paths")
        discard(used)
        now = paths.count()
        if now == before:
            return paths
        before = now


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """GRF-22: nodes that reach themselves.

    Where no child has two parents, no path is listed: who is 1, 2, 4, ... steps up is looked up, a row a node, until as
    many nodes are reached as in the round before; these are the rings.
    """
    first = _single(edges)
    if first is not None:
        step, ends = first.select("child", F.col("parent").alias("up")), None
        while True:
            reached = step.select(F.col("up").alias("node")).distinct()
            now = reached.count()
            if now == ends:
                return reached
            used, step, ends = step, stash(_doubled(step), "jumps"), now
            discard(used)
    paths = _closure(edges)
    back = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"))
    # parent -> ... -> child is a path and child -> parent an edge
    closing = back.join(paths.select(F.col("ancestor").alias("top"), F.col("node").alias("low")), (F.col("top") == F.col("node")) & (F.col("low") == F.col("ancestor")))
    return closing.select("node").union(closing.select("ancestor")).distinct()


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """GRF-16: ``(node, component)``, the component's smallest node.

    In each round a node hooks on its smallest neighbour, and edges go on between what was hooked on, so the graph shrinks
    (to half its nodes in two rounds at most); then labels come back through the rounds. From the second
    round on chains of hooks are followed to their ends.
    """
    left = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    rounds: list[DataFrame] = []
    while True:
        near = left.union(left.select("y", "x")).groupBy("x").agg(F.min("y").alias("y"))
        hook = stash(near.select(F.col("x").alias("node"), F.least("x", "y").alias("component")), "hooks")
        if rounds:
            hook = _followed(hook)
        rounds.append(hook)
        on = left.join(hook.select(F.col("node").alias("x"), F.col("component").alias("p")), "x").select("p", "y")
        on = on.join(hook.select(F.col("node").alias("y"), F.col("component").alias("q")), "y").where("p <> q")
        used = left
        left = stash(on.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct(), "edges")
        if len(rounds) > 1:
            discard(used)
        if left.isEmpty():
            break
    discard(left)
    label = rounds.pop()
    while rounds:
        hook = rounds.pop()
        above = label.where("node <> component").select(F.col("node").alias("component"), F.col("component").alias("final"))
        used, label = label, stash(hook.join(above, "component", "left").select("node", F.coalesce("final", "component").alias("component")), "labels")
        discard(used)
        discard(hook)
    return label


def _followed(hook: DataFrame) -> DataFrame:
    """Hooks ``(node, component)`` to the ends of their chains; chains descend, so there are no rings."""
    while True:
        further = hook.where("node <> component").select(F.col("node").alias("component"), F.col("component").alias("next"))
        used, met = hook, stash(hook.join(further, "component", "left").select("node", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("moved")), "hooks")
        hook = met.select("node", "component")
        discard(used)
        if met.where("moved").isEmpty():
            return hook


def pruned_hubs(edges: DataFrame, most: int, floor: float) -> DataFrame:
    """GRF-17: edges between nodes of at most ``most`` neighbours whose other neighbours overlap by ``floor`` (Jaccard).

    An edge points to its end with more neighbours, and each triangle is met once, at the end with fewest: lists of
    out-neighbours (``most`` at most) move along edges, not pairs of neighbours.
    """
    both = lambda e: e.select("a", "b").union(e.select("b", "a"))
    one = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    kept = both(one).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("a")
    live = stash(one.join(kept, "a").join(kept.select(F.col("a").alias("b")), "b").select("a", "b"), "live")
    discard(one)
    n = both(live).groupBy("a").agg(F.count("*").cast("int").alias("n"))
    sized = stash(live.join(n.select("a", F.col("n").alias("na")), "a").join(n.select(F.col("a").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", "na", "nb"), "sized")
    discard(live)
    ends = [F.struct(F.col(f"n{x}").alias("n"), F.col(x).alias("id")) for x in "ab"]
    out = sized.select(F.least(*ends).alias("u"), F.greatest(*ends).alias("v")).groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("out"))  # most at most
    out = stash(out.select(F.col("u.id").alias("u"), F.transform("out", lambda v: v["id"]).alias("out")), "out")
    sent = out.where(F.size("out") > 1).select("u", F.posexplode("out").alias("i", "v"), "out").select("u", "v", F.slice("out", F.col("i") + 2, F.lit(most)).alias("later")).where(F.size("later") > 0)
    met = sent.join(out.select(F.col("u").alias("v"), F.col("out").alias("theirs")), "v").select("u", "v", F.explode(F.array_intersect("later", "theirs")).alias("w"))
    sides = met.select(F.explode(F.array(*(F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")) for x, y in (("u", "v"), ("u", "w"), ("v", "w"))))).alias("e"))
    common = sides.groupBy("e.a", "e.b").agg(F.count("*").alias("k"))
    k = F.coalesce("k", F.lit(0))
    union = F.col("na") - 1 + F.col("nb") - 1 - k
    return sized.join(common, ["a", "b"], "left").where(F.when(union > 0, k / union).otherwise(0.0) >= floor).select("a", "b")


def expand(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """GRF-07: nodes within ``depth`` steps of ``start(node)`` either way, with their least distance; a depth that is not 1 to 5 is an error."""
    if not 1 <= depth <= 5:
        raise ValueError(f"depth {depth} is not between 1 and 5")
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    seen = start.select("node", F.lit(0).alias("distance"))
    for _ in range(depth):
        step = seen.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node"), (F.col("distance") + 1).alias("distance"))
        seen = stash(seen.union(step).groupBy("node").agg(F.min("distance").alias("distance")), "seen")
    return seen


def ego(edges: DataFrame, node, most: int = 40) -> DataFrame:
    """GRF-08: the neighbours of a node with direction, ``most`` at most, and whether more were cut."""
    out = edges.where(F.col("a") == node).select(F.col("b").alias("other"), F.lit("out").alias("direction"))
    back = edges.where(F.col("b") == node).select(F.col("a").alias("other"), F.lit("in").alias("direction"))
    few = out.union(back).distinct().orderBy("direction", "other").limit(most + 1)
    w = Window.partitionBy()  # most + 1 rows
    return few.withColumns({"truncated": F.count("*").over(w) > most, "r": F.row_number().over(w.orderBy("direction", "other"))}).where(F.col("r") <= most).drop("r")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """GRF-01: the newest row of each key."""
    every = old.unionByName(new)
    rest = [c for c in every.columns if c != key]
    return every.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def markov_clusters(edges: DataFrame, inflation: float = 2.0, rounds: int = 20, prune: float = 1e-4, still: float = 1e-5) -> DataFrame:
    """SIM-22: Markov clustering of ``edges(i, j, v)`` as sparse products; ``(node, cluster)`` by smallest attractor.

    The matrix is a table; a round is one join, two aggregates and a pruning.
    """
    nodes = edges.select("i").union(edges.select("j")).distinct()
    m = edges.select("i", "j", "v").union(edges.select("j", "i", "v")).union(nodes.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))).groupBy("i", "j").agg(F.max("v").alias("v"))
    column = Window.partitionBy("j")
    m = stash(m.select("i", "j", (F.col("v") / F.sum("v").over(column)).alias("v")), "markov")
    for _ in range(rounds):
        left, right = m.select("i", F.col("j").alias("k"), F.col("v").alias("x")), m.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
        grown = left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v")).withColumn("v", F.pow("v", inflation))
        grown = grown.withColumn("v", F.col("v") / F.sum("v").over(column)).where(F.col("v") > prune)
        nxt = stash(grown.select("i", "j", (F.col("v") / F.sum("v").over(column)).alias("v")), "markov")
        gap = nxt.alias("n").join(m.alias("o"), ["i", "j"], "full_outer").agg(F.max(F.abs(F.coalesce("n.v", F.lit(0.0)) - F.coalesce("o.v", F.lit(0.0)))).alias("g")).first().g
        m = nxt
        if gap is None or gap < still:
            break
    return m.groupBy(F.col("j").alias("node")).agg(F.min("i").alias("cluster"))
