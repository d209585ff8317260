"""What findings on odd inputs and larger tables showed."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import aggregates as A
from marlstone.operators import evaluation as E
from marlstone.operators import graph as G
from marlstone.operators import similarity as S
from marlstone.plans import catalog

catalog.load()


def both(spark, path, name, **tables):
    """A query's rows and those of its SQL, over small tables."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(path))
    sql = con.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(sql.columns)
    return sorted(map(tuple, got.select(*sql.columns).collect())), sorted(sql.fetchall())


@pytest.mark.parametrize("name", ["fil_06_two_stage_keywords", "dq_01_04_terms", "doc_12_18_mentions", "agg_23_rubric", "str_09_phrase_rate"])
def test_edges_of_words_are_ascii(spark, tmp_path, name):
    texts = ["License \u00e9License under\u00e9 x", "License_ rights under", "rights \u00fcMIT\u00e9 MITx CC", "\u00e9TBD {a} TBD1 \u00e9the th\u00e9", "", None, "of the\u00e9 \u00e9of the", "a\u0301under License"]
    docs = spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts)], "doc_id long, text string, lang string")
    got, want = both(spark, tmp_path, name, documents=docs)
    assert got == want and got


def test_reading_ease_next_to_a_half(spark):
    counts = [(n, s, k) for n in range(1, 90) for s in range(1, 12) for k in range(n, 3 * n, 2)]
    df = spark.createDataFrame(counts, "n int, s int, k int").select("n", "s", "k", T.ease_score(F.col("n"), F.col("s"), F.col("k")).alias("ease")).toPandas()
    want = duckdb.sql("SELECT n, s, k, round(206.835 - 1.015 * n::BIGINT / greatest(s::BIGINT, 1) - 84.6 * k::HUGEINT / n::BIGINT, 1) AS ease FROM df ORDER BY ALL").fetchall()
    assert sorted(zip(df["n"].tolist(), df["s"].tolist(), df["k"].tolist(), df["ease"].tolist(), strict=True)) == [tuple(x) for x in want]


def test_byte_grams_hold_a_bounded_part(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 9, n)) for n in (0, 1, 3, 7, 8, 9, 30, 500, 4000)] + [None, "\u00e9\u4e00\U0001f600", "ab"]
    monkeypatch.setattr(E, "_RUNS", 64)
    sent = []
    monkeypatch.setattr(E, "stash", lambda df, name="": sent.append(df) or df)
    got = dict(E.byte_grams(spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1), "text").collect())
    raw = [x.encode() for x in texts if x]
    assert got == {k: len({r[i : i + k] for r in raw for i in range(len(r) - k + 1)}) for k in range(1, 9)}
    ended = {r[-k:] for r in raw for k in range(1, 8) if len(r) >= k}
    assert sent[0].where("k < 8").count() == len(ended)  # a shorter run leaves a task only where a text ends


def test_hierarchies_of_any_shape(spark):
    tree = [(i, i // 3) for i in range(1, 60)]
    shapes = {"forest": tree, "chain": [(i + 1, i) for i in range(20)], "ring": [((i + 1) % 9, i) for i in range(9)] + [(20, 3), (21, 20), (None, 4), (30, None)], "two parents": [*tree, (7, 40), (8, 1)], "self": [(1, 1), (2, 1)], "none": []}
    for name, pairs in shapes.items():
        edges = spark.createDataFrame([*pairs, *pairs[:2]], "child long, parent long")
        above: dict[int, dict[int, int]] = {x: {x: 0} for p in pairs for x in p if x is not None}
        for _ in above:
            for c, p in pairs:
                if c is not None and p is not None:
                    for a, n in list(above[p].items()):
                        above[c][a] = min(above[c].get(a, n + 1), n + 1)
        assert sorted(map(tuple, G.reachable(edges).collect())) == sorted((a, x, n) for x, of in above.items() for a, n in of.items()), name
        start = spark.createDataFrame([(7,), (8,), (999,), (7,)], "node long")
        assert sorted(map(tuple, G.ancestors(edges, start).collect())) == sorted((a, x, n) for x, of in above.items() for a, n in of.items() if x in (7, 8)), name
        got = {r.node: (r.distance, r.total) for r in G.climbed(edges, F.col("node") % 3).collect()}
        assert got == {x: (max(of.values()), sum(a % 3 for a in of)) for x, of in above.items()}, name
        rings = {c for c, p in pairs if c is not None and p is not None and c in above[p]}
        assert {r.node for r in G.cycle_nodes(edges).collect()} == rings, name


def test_hierarchies_list_no_paths(spark, monkeypatch):
    """A forest's rings, roots, sums and few nodes' ancestors come without the closure."""
    monkeypatch.setattr(G, "reachable", None)
    monkeypatch.setattr(G, "_closure", None)
    edges = spark.createDataFrame([(i, i // 3) for i in range(1, 60)], "child long, parent long")
    assert G.climbed(edges).count() == 60
    assert G.ancestors(edges, spark.createDataFrame([(59,)], "node long")).count() == 5
    assert G.cycle_nodes(edges).count() == 0
    assert G.cycle_nodes(spark.createDataFrame([((i + 1) % 9, i) for i in range(9)], "child long, parent long")).count() == 9


def test_components_shrink(spark, monkeypatch):
    """A long chain takes few rounds, and edges are fewer in each."""
    sizes = []
    monkeypatch.setattr(G, "stash", lambda df, name="", f=G.stash: (out := f(df, name), sizes.append(out.count()) if name == "edges" else None)[0])
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1001), (2000, 2000)]
    got = dict(G.connected(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect())
    assert got == {x: 0 for x in range(301)} | {1000: 1000, 1001: 1000, 2000: 2000}
    assert len(sizes) <= 3 and sizes == sorted(sizes, reverse=True)


def test_pruned_hubs_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 40, (230, 2))] + [(50, i) for i in range(30)]
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    live = {a for a, of in near.items() if len(of) <= 14}
    of = {a: near[a] & live for a in live}
    share = lambda x, y: len(of[x] & of[y]) / max(1, len((of[x] | of[y]) - {x, y}))
    want = {(a, b) for a in live for b in of[a] if a < b and share(a, b) >= 0.2}
    assert {tuple(r) for r in G.pruned_hubs(spark.createDataFrame(pairs, "a long, b long"), 14, 0.2).collect()} == want and want


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_sort_no_group(spark):
    rows = [(k, float(x)) for k in ("a", None) for x in [*range(20), 3, 3, 3]] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = A.ranked_quantiles(df, ["k"], "x", {"q": 0.5}, {"r": 0.9})
    assert "row_number" not in plan(got)
    values = sorted([*range(20), 3, 3, 3])
    assert {tuple(r) for r in got.collect()} == {(k, values[int(0.5 * 23)], values[round(0.9 * 22)]) for k in ("a", None)}


def test_redundancy_shuffles_once(spark, tmp_path):
    texts = ["a b c d e f", "a b c d e", "a b c d e a b c d e", "x y", None]
    docs = spark.createDataFrame([*enumerate(texts), (None, "b c d e f")], "doc_id long, text string")
    got, want = both(spark, tmp_path, "set_13_ngram_redundancy", documents=docs)
    assert got == want
    assert plan(catalog.QUERIES["set_13_ngram_redundancy"](spark, str(tmp_path))).count("Aggregate") == 2


def test_postings_order_long_texts_only(spark, tmp_path):
    long = " ".join(f"a{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(4400))
    docs = spark.createDataFrame([(0, long), (1, "abc abc xyz ab"), (2, None), (3, long[:16000])], "doc_id long, text string")

    docs.where("doc_id <> 0").coalesce(1).write.parquet(f"{tmp_path}/some/documents.parquet")
    got, want = both(spark, tmp_path, "src_31_document_postings", documents=docs)
    assert got == want
    assert "length(low" in plan(catalog.QUERIES["src_31_document_postings"](spark, f"{tmp_path}/some"))


def test_postings_take_whole_texts(spark, tmp_path):
    filler = "abc " * 6000  # 24,000 characters
    docs = spark.createDataFrame([(0, filler + "tail abc"), (1, "\u4e00 " * 70000 + "End end1"), (2, "xyz")], "doc_id long, text string")
    got, want = both(spark, tmp_path, "src_31_document_postings", documents=docs)
    assert got == want and [(token, n) for token, _, n in got] == [("abc", 6001), ("end", 1), ("end1", 1), ("tail", 1), ("xyz", 1)]


def test_nearest_takes_few_blocks_at_a_time(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(S, "stash", lambda df, name="": seen.append(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or df)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id long, v array<double>")
    S.nearest(df, df, "id", "v", 1)
    assert seen == ["4"] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_coverage_takes_labels_of_any_width(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).tolist(), (3, 1, None)[i % 3]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    vectors.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = catalog.QUERIES["sim_16_coverage"](spark, str(tmp_path)).select("label", "template", "rank").collect()
    want = con.sql(catalog.ORACLES["sim_16_coverage"]).fetchall()
    assert {tuple(r) for r in got} == set(want) and len(got) == len(want) == 9


def test_nearest_of_all_takes_every_row(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3).tolist(), 0) for i in range(1, 70)] + [(7, [1.0, 0.0, 0.0], 0), (7, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0, 0.0], 0), (300, None, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got, want = both(spark, tmp_path, "joi_21_nearest_of_all", embeddings=vectors)
    assert [i for i, _ in got] == [*range(1, 70), 300]
    assert [i for i, _ in got] == [i for i, _ in want] and got[-1][1] is None is want[-1][1]
    assert np.allclose([x for _, x in got[:-1]], [x for _, x in want[:-1]], atol=1e-6)


def test_nearest_of_all_in_any_groups(spark):
    rng = np.random.default_rng(9)
    u = rng.normal(size=(90, 4))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ids = np.array([*range(80), *range(10)])  # some ids twice
    scores = np.where(ids[:, None] == ids[None, :], -np.inf, u @ u.T).max(1)
    want = {int(i): scores[ids == i].max() for i in ids}
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, u, strict=True)], "id int, v array<double>")
    for numbers, least, tile in ((2**22, 1, 512), (2**22, 1, 4), (2**22, 8, 512), (60, 1, 4), (4, 1, 3)):
        got = dict(S.nearest_of_all(df, "id", "v", numbers, least, tile).collect())
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    for few, n in ((df.where("id = 3"), 0), (df.where("id = 30"), 0), (df.where("id in (3, 30)"), 2), (df.limit(0), 0)):
        assert S.nearest_of_all(few, "id", "v").count() == n


def test_few_terms_are_sent_to_the_counts(spark):
    """The optimizer is told to send the terms; without that the counts would be shuffled by term."""
    docs = spark.createDataFrame([(0, ["a", "b", "a"]), (1, ["a", "c"]), (2, ["b"])], "id long, t array<string>")
    assert plan(S.tf_idf(docs, "id", "t")).count("strategy=broadcast") == 2
