"""Tables that outlive a run: the cache, the log, graph patterns, ontology scans."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import embedding_cache as C
from marlstone.operators import patterns as P
from marlstone.sources import ontologies as O
from marlstone.sources.exchange import Exchange, Layout
from marlstone.storage import scratch


def encoder(calls):
    def encode(texts):
        calls.add(len(texts))
        return np.array([[len(t), t.count("a") / 3, -1e-3] for t in texts], np.float32)

    return encode


def test_cache_encodes_each_content_once(spark):
    calls = spark.sparkContext.accumulator(0)
    rows = [(t, v) for t, n in (("t1", 60), ("t2", 60), ("t3", 3)) for v in range(n)]
    cells = spark.createDataFrame([(t, v, None if v == 1 else f"a{v}") for t, v in rows], "tab string, place int, cell string")
    columns = C.first_cells(cells, ["tab"], ["place"], "cell")
    listed = {r.tab: r.cells for r in columns.collect()}
    assert listed["t1"] == [f"a{v}" for v in range(52) if v != 1][:50] and listed["t3"] == ["a0", "a2"]
    cache = C.EmbeddingCache(spark, scratch(spark, "cache"), 3)
    first = {r.tab: r for r in cache.embed(columns, encoder(calls), ["tab"]).collect()}
    assert calls.value == 2 and not any(r.hit for r in first.values())  # t1 and t2 hold the same
    again = {r.tab: r for r in cache.embed(columns, encoder(calls), ["tab"]).collect()}
    assert calls.value == 2 and all(r.hit for r in again.values())
    for t, r in again.items():
        text = " ".join(listed[t])
        want = np.array([len(text), text.count("a") / 3, -1e-3])
        assert r.vector == first[t].vector and np.allclose(r.vector, want, rtol=1e-3)
        assert r.vector == np.array(want, np.float32).astype(np.float16).astype(np.float32).tolist()
    assert cache.embed(columns.limit(0), encoder(calls), ["tab"]).count() == 0


def test_exchange_append_runs_again(spark):
    layout = Layout("id bigint, what string, day string", ("day",), ("what",), "id")
    log = Exchange(spark, "exchange_test", layout, scratch(spark, "exchange"))
    rows = [(i, f"w{i % 5}", f"d{i % 3}") for i in range(40)]
    df = spark.createDataFrame(rows[:25] + rows[:3], layout.columns)
    try:
        log.append(df)
        log.append(df)
        log.append(spark.createDataFrame(rows, layout.columns))
        assert sorted(tuple(r) for r in log.read().collect()) == rows
        assert log.create_or_load().count() == 40
        plan = log.read().where("day = 'd1'")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(day" in plan
        with pytest.raises(Exception, match="no id"):
            log.append(spark.createDataFrame([(None, "w", "d0")], layout.columns))
    finally:
        log.drop()


def test_patterns_match_brute_force(spark):
    rnd = random.Random(2)
    vertices = [(f"v{i}", rnd.choice("ABC"), {"w": str(i % 4)} if i % 9 else None) for i in range(30)] + [("hub", "A", {"w": "1"}), (None, "A", {})]
    edges = [(rnd.choice(vertices)[0], rnd.choice(vertices)[0], rnd.choice("xy"), {"n": str(i)}) for i in range(150)]
    edges += [("hub", f"v{i}", "x", {}) for i in range(30)] + edges[:4] + [("hub", "nowhere", "x", {})]
    v = spark.createDataFrame(vertices, "id string, label string, props map<string,string>")
    e = spark.createDataFrame(edges, "src string, dst string, label string, props map<string,string>")
    pattern = P.Pattern(
        (P.Vertex("b", "B"), P.Vertex("a", "A"), P.Vertex("c", None, "props['w'] = '1'"), P.Vertex("d")),
        (P.Edge("a", "b", "x", name="ab"), P.Edge("c", "b", "y"), P.Edge("c", "d", "x")),
    )
    got = sorted((r.a, r.b, r.c, r.d, str(r.ab_props)) for r in P.match(v, e, pattern).collect())
    of = {i: (label, props) for i, label, props in vertices if i}
    want = []
    for (s1, t1, l1, p1), (s2, t2, l2, _), (s3, t3, l3, _) in itertools.product(edges, repeat=3):
        if l1 == "x" and l2 == "y" and l3 == "x" and t1 == t2 and s2 == s3 and all(x in of for x in (s1, t1, s2, t3)):
            if of[s1][0] == "A" and of[t1][0] == "B" and (of[s2][1] or {}).get("w") == "1":
                want.append((s1, t1, s2, t3, str(p1)))
    assert got == sorted(want) and want
    assert P.match(v, e.limit(0), pattern).count() == 0
    for broken in (P.Pattern(pattern.vertices, pattern.edges[:2]), P.Pattern(pattern.vertices, (*pattern.edges, P.Edge("a", "d")))):
        with pytest.raises(ValueError):
            P.match(v, e, broken)


def test_pattern_plan_has_no_cross_join(spark):
    v = spark.createDataFrame([("a", "A", {})], "id string, label string, props map<string,string>")
    e = spark.createDataFrame([("a", "a", "x", {})], "src string, dst string, label string, props map<string,string>")
    found = P.match(v, e, P.Pattern((P.Vertex("p"), P.Vertex("q")), (P.Edge("p", "q"),)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and found.count() == 1


def test_json_ld_of_every_shape(spark):
    docs = [
        ("1", '{"@graph": [{"@id": "a:x", "@type": "rdfs:Class", "rdfs:label": {"@value": "X"}, "rdfs:comment": null}, 5, {"@type": "rdfs:Class"}]}'),
        ("2", '{"@graph": [{"@id": "a:x", "@type": "rdfs:Class", "rdfs:label": [{"@value": "later"}], "rdfs:subClassOf": "plain"}, {"@id": "a:l", "@type": ["rdfs:Class"]}]}'),
        ("3", "{broken"),
        ("4", '{"no": "graph"}'),
        ("5", None),
        ("6", '{"@graph": [{"@id": "q", "@type": "rdf:Property", "rdfs:label": [], "schema:rangeIncludes": [{"@id": "r"}, 7, null, {}]}]}'),
    ]
    got = {(r.kind, r.id): (r.label, r.comment, r.parents, r.domains, r.ranges) for r in O.json_ld(spark.createDataFrame(docs, "source string, text string")).collect()}
    assert got == {("class", "a:x"): ("later", "", ["plain"], [], []), ("property", "q"): ("q", "", [], [], ["r", "7", ""])}


def test_short_names(spark):
    names = {"http://a/b#c": "c", "http://a/b/": "b", "plain": "plain", "<x>": "<x>", "http://a/b#c/": "c"}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", O.short_name(F.col("n")).alias("s"))
    assert {r.n: r.s for r in df.collect()} == names
