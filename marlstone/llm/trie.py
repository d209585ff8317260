"""A z-fast trie of turn sequences as tables, filled in batches.

A sequence is known by the digests of its prefixes: 16 bytes of BLAKE2b chained over the
turns, so equal digests mean equal prefixes. The trie is compacted: a node
is kept where a sequence ends or where sequences part, and holds the digests along the
edge above it. Nodes are hashed at the two-fattest depth of their edge, their
handle. A sequence finds where it leaves the trie by fat binary search, one join with the
handles for each halving of its length; a join with the first digests of edges
then gives the edge on which it leaves.

A batch is located whole and inserted at once: edges are split where sequences
leave them, and among the sequences of the batch nodes arise where prefixes are continued
in two ways. These groupings hold one row for each prefix and task, so a prefix that a third of all rows
share is no hot group. Equal sequences are one row before anything else.

Sums over subtrees follow parent pointers of doubled reach. Only at the end
are edges expanded to a row for every prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from marlstone.storage import discard, stash

ROOT = b""
_PREFIX = StructType().add("digest", "binary").add("chars", "long")


def prefixes(sequences: DataFrame) -> DataFrame:
    """``(id, path)`` of ``sequences(id, turns)``: for every prefix its digest and the code points of all its texts.

    ``turns`` is an array of (digest of role and text, code points); an empty or null one has an empty path.
    """
    schema = StructType(sequences.select("id").schema.fields).add("path", ArrayType(_PREFIX))
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("chars", pa.int64())]))

    def path(turns: list[dict] | None) -> list[dict]:
        found, digest, chars = [], ROOT, 0
        for t in turns or ():
            digest, chars = hashlib.blake2b(digest + t["digest"], digest_size=16).digest(), chars + t["chars"]
            found.append({"digest": digest, "chars": chars})
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array((path(x.as_py()) for x in batch.column("turns")), kind)], ["id", "path"])

    return sequences.select("id", "turns").mapInArrow(run, schema)


def turn_digest(role: Column, text: Column) -> Column:
    """Digest of a turn; the role's length keeps it apart from the text."""
    return F.unhex(F.sha2(F.concat_ws(":", F.char_length(role).cast("string"), role, text).cast("binary"), 256))


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] with the most trailing zero bits; ``high`` where the interval is empty."""
    bits = F.char_length(F.bin(low.bitwiseXOR(high))) - 1
    return F.when(low >= high, high).otherwise(F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits).cast("int"))


@dataclass
class Trie:
    """``nodes(node, parent, up, len, first, handle, edge, chars, base)``.

    ``node`` is the digest of the prefix of length ``len``; ``up`` the length of the parent's;
    ``edge`` and ``chars`` are the digests and code points of the prefixes of
    length ``up + 1`` to ``len``; ``first`` and ``handle`` the digests of length ``up + 1`` and of the two-fattest length;
    ``base`` the parent's code points. The root alone has a null parent.
    """

    nodes: DataFrame


def _node(parent: Column, up: Column, edge: Column, chars: Column, base: Column) -> list[Column]:
    """A node's columns from its parent, its depth and its edge."""
    size = F.size(edge)
    last = (up + size).cast("int")
    return [
        F.element_at(edge, -1).alias("node"), parent.alias("parent"), up.cast("int").alias("up"), last.alias("len"), F.element_at(edge, 1).alias("first"),
        F.element_at(edge, fattest(up, last) - up).alias("handle"), edge.alias("edge"), chars.alias("chars"), base.cast("long").alias("base"),
    ]


def empty(spark) -> Trie:
    """The root alone."""
    schema = "node binary, parent binary, up int, len int, first binary, handle binary, edge array<binary>, chars array<bigint>, base bigint"
    return Trie(spark.createDataFrame([(ROOT, None, 0, 0, None, ROOT, [], [], 0)], schema))


def locate(trie: Trie, classes: DataFrame, longest: int) -> DataFrame:
    """``classes(key, path)`` with ``low``, the depth of the deepest node on each path, by fat binary search.

    The search keeps ``low``, the depth of a node known to lie on the path, and ``high``,
    which no deeper node on it exceeds. A handle that is met names the only edge on
    which the path can run at that depth: if the edge's node lies on the path, the search goes on
    below it, else it ends at the edge's upper end. ``longest`` bounds the length of the paths.
    """
    handles = trie.nodes.where("len > 0").select(F.col("handle").alias("met"), F.col("node").alias("met_node"), F.col("up").alias("met_up"), F.col("len").alias("met_len"))
    found = classes.withColumns({"low": F.lit(0), "high": F.size("path")})
    for _ in range(longest.bit_length() + 1):
        at = fattest(F.col("low"), F.col("high"))
        # a finished search asks for its own key with a byte before it, which is no digest: no hot null key
        probe = F.when(F.col("low") < F.col("high"), F.element_at("path", F.greatest(at, F.lit(1)))["digest"]).otherwise(F.concat(F.lit(b"\0"), F.col("key")))
        met = found.withColumn("probe", probe).join(handles, F.col("probe") == F.col("met"), "left")
        whole = (F.col("met_len") <= F.size("path")) & (F.try_element_at("path", F.col("met_len"))["digest"] == F.col("met_node"))
        low = F.when(F.col("met").isNull(), F.col("low")).when(whole, F.col("met_len")).otherwise(F.greatest("low", "met_up"))
        high = F.when(F.col("low") >= F.col("high"), F.col("high")).when(F.col("met").isNull(), at - 1).when(whole, F.col("high")).otherwise(F.greatest("low", "met_up"))
        found = met.select("key", "path", low.alias("low"), high.alias("high"))
    return found.select("key", "path", "low")


def insert(trie: Trie, classes: DataFrame, longest: int) -> Trie:
    """The trie with all ``classes(key, path)`` in it; keys are the paths' last digests, each once. ``longest`` bounds their lengths."""
    nodes = trie.nodes
    spark = classes.sparkSession
    edges = nodes.where("len > 0").select(F.col("first").alias("met"), F.col("node").alias("exit"), F.col("edge").alias("met_edge"))
    placed = locate(trie, classes, longest).where(F.col("low") < F.size("path"))  # the others end at a node
    placed = placed.withColumn("next", F.element_at("path", F.col("low") + 1)["digest"]).join(edges, F.col("next") == F.col("met"), "left")
    digests = F.transform("path", lambda p: p["digest"])
    same = F.size(F.filter(F.zip_with("met_edge", F.slice(digests, F.col("low") + 1, F.greatest(F.size("met_edge"), F.lit(0))), lambda x, y: x == y), lambda x: x))
    leave = F.when(F.col("met").isNull(), F.col("low")).otherwise(F.col("low") + same)
    placed = stash(placed.select("key", "path", "exit", F.size("path").alias("n"), leave.alias("leave"), (leave > F.col("low")).alias("inside")), "located")

    # among the new sequences: where prefixes below the place of leaving end or go on in two ways
    below = placed.where("leave < n").select("key", "n", F.posexplode(F.slice(digests, F.col("leave") + 1, F.col("n") - F.col("leave"))).alias("i", "digest"), F.col("leave"), digests.alias("all"))
    depth = (F.col("leave") + F.col("i") + 1).cast("int")
    below = stash(below.select("key", "digest", depth.alias("depth"), F.try_element_at("all", depth + 1).alias("next")), "prefixes")
    parted = below.groupBy("digest").agg(F.min("next").alias("a"), F.max("next").alias("b"), F.max(F.col("next").isNull()).alias("ends"), F.min("key").alias("owner"))
    parted = parted.where("ends OR a <> b").select(F.col("digest").alias("kept"), "owner")
    marked = below.select("key", "digest", "depth").join(parted, F.col("digest") == F.col("kept"))
    stops = marked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("depth", (F.col("owner") == F.col("key")).alias("own")))).alias("stops"))
    pieces = placed.join(stops, "key").select("path", F.posexplode("stops").alias("k", "stop"), "stops", "leave").where("stop.own")
    up = F.when(F.col("k") == 0, F.col("leave")).otherwise(F.element_at("stops", F.greatest(F.col("k"), F.lit(1)))["depth"])
    pieces = pieces.select("path", up.alias("up"), F.col("stop.depth").alias("to"))
    part = F.slice("path", F.col("up") + 1, F.col("to") - F.col("up"))
    above = F.when(F.col("up") > 0, F.element_at("path", F.greatest(F.col("up"), F.lit(1))))
    pieces = pieces.select(F.coalesce(above["digest"], F.lit(ROOT)).alias("parent"), "up", F.transform(part, lambda p: p["digest"]).alias("edge"), F.transform(part, lambda p: p["chars"]).alias("chars"), F.coalesce(above["chars"], F.lit(0)).alias("base"))

    # edges that are left before their end are split there
    cuts = placed.where("inside").select("exit", "leave").distinct().groupBy("exit").agg(F.array_sort(F.collect_list("leave")).alias("cuts"))
    held = nodes.join(cuts, F.col("node") == F.col("exit"), "left")
    untouched = held.where("cuts IS NULL").select(*nodes.columns)
    ends = F.array_distinct(F.concat("cuts", F.array("len")))
    split = held.where("cuts IS NOT NULL").select("parent", "up", "edge", "chars", "base", F.posexplode(ends).alias("k", "to"), ends.alias("ends"))
    since = F.when(F.col("k") == 0, F.col("up")).otherwise(F.element_at("ends", F.greatest(F.col("k"), F.lit(1))))
    split = split.select("parent", "up", "edge", "chars", "base", since.alias("since"), "to")
    skip = F.col("since") - F.col("up")
    before = F.greatest(skip, F.lit(1))
    split = split.select(
        F.when(skip > 0, F.element_at("edge", before)).otherwise(F.col("parent")).alias("parent"), F.when(skip > 0, F.element_at("chars", before)).otherwise(F.col("base")).alias("base"),
        F.slice("edge", skip + 1, F.col("to") - F.col("since")).alias("edge"), F.slice("chars", skip + 1, F.col("to") - F.col("since")).alias("chars"), F.col("since").alias("up"),
    )
    changed = (x.select(*_node(*(F.col(c) for c in ("parent", "up", "edge", "chars", "base")))) for x in (pieces, split))
    grown = untouched
    for x in changed:
        grown = grown.unionByName(x)
    return Trie(stash(grown, "trie"))


def build(classes: DataFrame, batches: int = 2) -> Trie:
    """The trie of ``classes(key, path)``, dealt to batches by a hash of the key; batches that hold nothing change nothing."""
    longest = classes.agg(F.max(F.size("path"))).first()[0] or 0
    trie = empty(classes.sparkSession)
    for b in range(batches):
        following = insert(trie, classes.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == b), longest if b else 0)
        if b:
            discard(trie.nodes)
        trie = following
    return trie


def subtree_sums(nodes: DataFrame, values: DataFrame, sums: list[str], least: list[str]) -> DataFrame:
    """``values(node, ...)``, a row a node, with every named column summed (or its minimum taken) over the node's subtree.

    After ``k`` rounds a value covers all nodes less than ``2^k`` steps below; the pointer of as
    many steps carries it to the node above them.
    """
    fold = {**dict.fromkeys(sums, F.sum), **dict.fromkeys(least, F.min)}
    held = stash(values, "sums")
    jumps = stash(nodes.where("parent IS NOT NULL").select("node", F.col("parent").alias("target")), "jumps")
    while not jumps.isEmpty():
        carried = jumps.join(held, "node").groupBy("target").agg(*(f(c).alias(f"more_{c}") for c, f in fold.items()))
        both = held.join(carried, held["node"] == carried["target"], "left")
        new = [*((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums), *(F.least(c, f"more_{c}").alias(c) for c in least)]
        following = stash(both.select("node", *new), "sums")
        # the root has no pointer: what points there is done
        further = jumps.select(F.col("node").alias("via"), F.col("target").alias("to"))
        longer = stash(jumps.where(F.col("target") != F.lit(ROOT)).join(further, F.col("target") == F.col("via")).select("node", F.col("to").alias("target")), "jumps")
        for used in (held, jumps):
            discard(used)
        held, jumps = following, longer
    return held


def joined_digests(members: DataFrame, key: str, id: str) -> DataFrame:
    """``(key, sha256)``: SHA-256 of each key's ids, in numerical order, as decimals with commas between.

    Ids are sorted by range partitions and joined to pieces there; a task then hashes
    a key's pieces one after the other and holds one at a time.
    """
    kind = members.select(key).schema
    piece = StructType([*kind.fields]).add("least", "long").add("piece", "string")
    digest = StructType([*kind.fields]).add("sha256", "string")
    at_once = 8192

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, start = [], 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or keys[i] != keys[start] or i - start == at_once:
                    rows.append((keys[start], ids[start], ",".join(map(str, ids[start:i]))))
                    start = i
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (batch.column(0).type, pa.int64(), pa.string()), strict=True)], piece.fieldNames())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, running, kind_of = None, None, None
        for batch in batches:
            kind_of, rows = batch.column(0).type, []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if running is None or k != own:
                    if running is not None:
                        rows.append((own, running.hexdigest()))
                    own, running = k, hashlib.sha256(text.encode())
                else:
                    running.update(b"," + text.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind_of, pa.string()), strict=True)], digest.fieldNames())
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], kind_of), pa.array([running.hexdigest()])], digest.fieldNames())

    pieces = members.select(key, F.col(id).cast("long").alias("least")).repartitionByRange(key, "least").sortWithinPartitions(key, "least").mapInArrow(join, piece)
    return pieces.repartition(key).sortWithinPartitions(key, "least").mapInArrow(hashed, digest)


def prefix_report(paths: DataFrame, batches: int = 2) -> DataFrame:
    """A row for every distinct prefix of the sequences ``paths(id, path)``, the empty one included.

    ``(id, depth, parent_id, n_members, n_children, n_leaves, saved, ends_sha256)``: the smallest id among the
    sequences that begin with it, its length, the parent's smallest id (null at the root), how many
    sequences begin with it, its children, the childless prefixes in its subtree, the code points that
    sharing saves there, and the digest of the ids of the sequences that end there. Ids are numbers, not null,
    each once. Repeated sequences count each. No rows give no rows.
    """
    paths = stash(paths.select("id", F.coalesce("path", F.array().cast(ArrayType(_PREFIX))).alias("path"), F.coalesce(F.try_element_at("path", F.lit(-1))["digest"], F.lit(ROOT)).alias("key")), "paths")
    classes = stash(paths.groupBy("key").agg(F.min_by("path", "id").alias("path"), F.min("id").alias("least"), F.count("*").alias("n")), "classes")
    trie = build(classes.select("key", "path"), batches)
    nodes = trie.nodes
    chars = F.coalesce(F.try_element_at("path", F.lit(-1))["chars"], F.lit(0))
    ends = classes.select(F.col("key").alias("end"), "least", "n", (F.col("n") * chars).alias("weight"))
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("children")).withColumnRenamed("parent", "of")
    local = nodes.select("node", (F.coalesce(F.try_element_at("chars", F.lit(-1)), F.lit(0)) - F.col("base")).alias("length"))
    local = local.join(ends, F.col("node") == F.col("end"), "left").join(children, F.col("node") == F.col("of"), "left")
    counted = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "weight", "children")}
    local = stash(local.select("node", "least", "length", *counted.values(), F.when(F.coalesce("children", F.lit(0)) == 0, 1).otherwise(0).cast("long").alias("leaves")), "local")
    summed = subtree_sums(nodes, local.select("node", "least", "n", "weight", "length", "leaves"), ["n", "weight", "length", "leaves"], ["least"])
    digests = joined_digests(paths.select("key", "id"), "key", "id").withColumnRenamed("key", "end")
    above = summed.select(F.col("node").alias("above"), F.col("least").alias("parent_least"))
    whole = nodes.select("node", "parent", "up", "len", "chars", "base").join(summed, "node").join(local.select("node", "children"), "node")
    whole = whole.join(digests, F.col("node") == F.col("end"), "left").join(above, F.col("parent") == F.col("above"), "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    depths = F.when(F.col("len") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.col("up") + 1, F.greatest("len", F.col("up") + 1)))
    rows = whole.select("*", F.explode(depths).alias("depth"))
    at = F.col("depth") - F.col("up")
    before = F.when(at <= 1, F.col("base")).otherwise(F.element_at("chars", F.greatest(at - 1, F.lit(1))))
    end = F.col("depth") == F.col("len")
    return rows.where("n > 0").select(
        F.col("least").alias("id"), F.col("depth").cast("long").alias("depth"), F.when(at > 1, F.col("least")).otherwise(F.col("parent_least")).alias("parent_id"), F.col("n").alias("n_members"),
        F.when(end, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("weight") - F.col("length") - F.col("base") - (F.col("n") - 1) * before).cast("long").alias("saved"), F.when(end, F.coalesce("sha256", nothing)).otherwise(nothing).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame, id: str = "conv_id", turn: str = "turn", most: int = 6, every: int = 100) -> DataFrame:
    """``(id, turns)``: each conversation with its first turns taken from a common one.

    Conversation c has the first h turns of conversation ``c - c % every`` (all if it has fewer, none
    if it does not exist), then its own after its first h, where h is the CRC-32 of c's decimals, modulo ``most``.
    Turns are ordered by turn (null first), then role and text; null roles and texts are empty; repeated rows are turns of their own.
    Rows with a null id are left out: nothing says what they would be rebuilt from. A conversation's turn
    digests are one row. Other columns are left out; no rows give no rows.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("id").orderBy("turn", "role", "text")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = turns.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(turn).alias("turn"), role.alias("role"), text.alias("text"))
    numbered = plain.select("id", F.row_number().over(order).alias("number"), F.struct(turn_digest(F.col("role"), F.col("text")).alias("digest"), F.char_length("text").cast("long").alias("chars")).alias("turn"))
    numbered = stash(numbered, "turns")
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % most).cast("int")
    ids = numbered.where("number = 1").select("id", h.alias("h"), (F.col("id") - F.col("id") % every).alias("source"))
    taken = numbered.where((F.col("id") % every == 0) & (F.col("number") < most)).select(F.col("id").alias("source"), "number", "turn")
    first = ids.join(taken, "source").where("number <= h").select("id", F.lit(0).alias("own"), "number", "turn")
    own = numbered.where(F.col("number") > h).select("id", F.lit(1).alias("own"), "number", "turn")
    none = ids.select("id", F.lit(2).alias("own"), F.lit(None).cast("int").alias("number"), F.lit(None).cast(numbered.schema["turn"].dataType).alias("turn"))
    listed = first.union(own).union(none).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("own", "number", "turn"))).alias("rows"))
    return listed.select("id", F.transform(F.filter("rows", lambda r: r["turn"].isNotNull()), lambda r: r["turn"]).alias("turns"))
