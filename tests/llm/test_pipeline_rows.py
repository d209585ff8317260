"""The pipeline's stages judge rows, not ids."""

import random

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_near_duplicates_of_null_and_shared_ids(spark):
    a, b, c, d, e = map(prose, range(5))
    rows = [(None, a), (None, b), (None, b), (1, c), (2, c), (2, d), (None, d), (3, e), (3, e)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 3, 5):
        got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, df.repartition(n), SF).collect()]
        assert sorted(got, key=str) == sorted([(None, a), (None, b), (1, c), (2, d), (3, e)], key=str)


def test_leaks_of_null_and_shared_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, f"before {item} after"), (None, "clean"), (1, item), (1, "clean too"), (2, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.decontamination(spark, df, SF).collect()]
    assert sorted(got, key=str) == sorted([(None, "clean"), (1, "clean too"), (2, None), (None, None)], key=str)


def test_leaks_by_blocks(spark):
    from marlstone.llm import decontaminate

    items = [(i, prose(i, 12)) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(None, t) for _, t in items] + [(None, prose(9))], "doc_id long, text string")
    assert [r.text for r in decontaminate.without_matches(df, bench, block_bytes=100).collect()] == [prose(9)]
    assert decontaminate.without_matches(df, bench.limit(0)).count() == 7


def test_odd_rows_through_all_stages(spark):
    """Nulls, empty and very long texts, repeated rows, columns with any names, and an empty table."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    good = lambda seed: "\n".join(prose(seed * 10 + k, 12).capitalize() + "." for k in range(9))
    long = "\n".join(prose(k, 12).capitalize() + "." for k in range(100, 4000))
    texts = [None, "", " \n ", good(1), good(1), good(2) + "\nMail bob@example.com now, please do.", long, good(3) + f"\n{item}"]
    rows = [(i if i % 3 else None, t, {"a": i}, i * 10, i, f"r{i}", True, "x", 0.5, -1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, n_chars long, row long, doc string, kept boolean, fp string, component_id double, n_email long")
    for table in (df, df.limit(0)):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stash(stage(spark, docs, SF))
            assert docs.columns == df.columns
        got = {r.row: r for r in docs.collect()}
        assert set(got) == ({4, 5, 6} if table is df else set())  # of equal texts, the one with an id
        for i, r in got.items():
            assert (r.tags, r.doc, r.kept, r.fp, r.component_id, r.n_email) == ({"a": i}, f"r{i}", True, "x", 0.5, -1) and r.n_chars == len(r.text)
        if got:
            assert got[6].text == long and "bob@example" not in got[5].text and "Mail " in got[5].text
        packed = corpus_pipeline.packing(spark, docs, SF).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in got.values()}
