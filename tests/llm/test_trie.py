"""The z-fast trie against plain grouping of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [x[2:] for x in sorted(s)] for c, s in own.items()}
    out = {}
    for c, s in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = plain.get(c - c % 100, [])[:h] + s[h:]
    return out


def brute(sequences):
    members, kids = defaultdict(list), defaultdict(int)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(sequences[c]) == len(p))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(400), n):
        if c % 100 == 0 and rnd.random() < 0.5:
            continue  # some sources are absent
        for t in range(rnd.choice([1, 2, 3, 5, 8, 9, 17])):
            rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bb", "", None, "ç😀"])))
    copied = [(1000 + c, t, "user", "the same") for c in range(40) for t in range(7)]
    branching = [(2000 + c, t, "user", "x" if t != c else "y") for c in range(12) for t in range(12)]
    return rows + copied + branching + rows[:6] + [(None, 0, "user", "no id"), (300, 0, "user", "z"), (-5, 1, "user", "negative")]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_report_matches_brute_force(spark, batches):
    rows = conversations(batches, 120)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("number", F.lit(1))
    own = rebuilt([r for r in rows if r[0] is None or r[0] >= 0])
    got = trie.prefix_report(trie.prefixes(trie.rebuilt(df.where("conv_id IS NULL OR conv_id >= 0"))), batches)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(own)


def test_turnless_conversations_end_at_the_root(spark):
    c = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 > 2)
    df = spark.createDataFrame([(c, 0, "user", "taken from a source that is absent")], SCHEMA)
    got = trie.prefix_report(trie.prefixes(trie.rebuilt(df))).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_no_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_report(trie.prefixes(trie.rebuilt(df))).collect() == []


def test_fattest(spark):
    pairs = [(a, b) for a in range(70) for b in range(a, 70)] + [(0, 2**20 + 5), (2**20, 2**20 + 1)]
    df = spark.createDataFrame(pairs, "a int, b int").select("a", "b", trie.fattest(F.col("a"), F.col("b")).alias("f"))
    for a, b, f in df.collect():
        assert f == (max(range(a + 1, b + 1), key=lambda x: x & -x) if a < b <= 100 else f if a < b else b)


def paths_of(spark, sequences):
    turns = [(i, [{"digest": hashlib.sha256(x.encode()).digest(), "chars": len(x)} for x in s]) for i, s in sequences.items()]
    df = trie.prefixes(spark.createDataFrame(turns, "id long, turns array<struct<digest:binary,chars:long>>"))
    return df.select("id", "path", F.element_at("path", -1)["digest"].alias("key"))


def test_locate_and_insert_in_batches(spark):
    """Sequences find the deepest node on their path; what is inserted later gives the same trie."""
    rnd = random.Random(11)
    sequences = {i: "".join(rnd.choices("ab", k=rnd.randint(1, 40))) for i in range(150)}
    sequences = {i: s for i, s in sequences.items() if s not in {t for j, t in sequences.items() if j < i}}
    df = paths_of(spark, sequences)
    classes = df.select("key", "path")
    old, new = df.where("id % 2 = 0").select("key", "path"), df.where("id % 2 = 1").select("key", "path")
    half = trie.insert(trie.empty(spark), old, 40)

    def nodes_of(texts):
        prefixes = defaultdict(set)
        for s in texts:
            for d in range(len(s) + 1):
                prefixes[s[:d]].add(s[d : d + 1])
        return {p for p, after in prefixes.items() if len(after) > 1 or "" in after or not p}

    known = nodes_of([s for i, s in sequences.items() if i % 2 == 0])
    found = {r.key: r.low for r in trie.locate(half, new, 40).collect()}
    for r in df.where("id % 2 = 1").collect():
        s = sequences[r.id]
        assert found[r.key] == max(d for d in range(len(s) + 1) if s[:d] in known)
    both = trie.insert(half, new, 40).nodes.collect()
    at_once = trie.insert(trie.empty(spark), classes, 40).nodes.collect()
    assert sorted(map(repr, both)) == sorted(map(repr, at_once)) and len(both) == len(nodes_of(sequences.values()))


def test_joined_digests(spark):
    rows = [(k, i) for k in range(3) for i in range(0, 9000 * (k == 1) + 30, k + 1)]
    random.Random(1).shuffle(rows)
    got = {r.k: r.sha256 for r in trie.joined_digests(spark.createDataFrame(rows, "k long, i long"), "k", "i").collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for j, i in sorted(rows) if j == k).encode()).hexdigest() for k in range(3)}
