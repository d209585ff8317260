from pyspark.sql import functions as F

from marlstone.llm import quality

GOOD = "\n".join(" ".join(f"word{i}x{j}" for j in range(9)) + f". Next{i} comes{i}." for i in range(12))
MENU = "\n".join(" | ".join(f"item{i}x{j}" for j in range(8)) for i in range(12))
SCHEMA = "doc_id long, text string, n_words long, __note string"


def judged(spark, *texts):
    rows = [(i, t, -7, None) for i, t in enumerate(texts)]
    return {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}


def brute(text):
    words = text.split() if text else []
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), len(hit)


def test_figures_match_brute_force(spark):
    texts = [GOOD, MENU, "a b c a b c a b", "x x x x", "", None, "one", " \t\n ", "a b c\n\na b c\nd", GOOD + "\n" + GOOD]
    got = judged(spark, *texts)
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_repeat_words) == brute(t), t


def test_lines_go_first_then_documents(spark):
    got = judged(spark, GOOD, MENU, GOOD + "\nAll rights reserved.", MENU + "\n" + GOOD)
    assert got[0].kept and got[0].lines_removed == 0 and got[0].cleaned == GOOD
    assert not got[1].kept and got[1].lines_removed == 12 and got[1].cleaned == ""
    assert got[2].kept and got[2].lines_removed == 1 and got[2].cleaned == GOOD
    assert not got[3].kept


def test_empty_null_and_repeated_rows(spark):
    got = judged(spark, None, "", "\n\n")
    assert all(not r.kept and r.n_words == 0 and r.lost_share == 0 and r.cleaned == "" for r in got.values())
    twice = spark.createDataFrame([(1, GOOD), (1, GOOD), (None, None)], "doc_id long, text string")
    assert quality.quality(twice).where("kept").count() == 2
    assert quality.quality(twice.limit(0)).count() == 0


def test_plan_has_no_python_and_no_shuffle(spark):
    df = quality.quality(spark.createDataFrame([(1, GOOD)], "doc_id long, text string")).select(F.col("kept"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
