"""What one task holds, and what is moved, on the way to a result."""

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import match


def test_rows_with_words_are_not_gathered(spark):
    """Words of a row come from lists of its texts; only pairs of repeated ids are compared."""
    rows = [(1, "Large Ring", "large tray", "C1"), (2, "ring", None, "ringtray"), (2, "ring", "large", "C2"), (3, None, None, None), (4, "tin", "tin", "tin")]
    goods = spark.createDataFrame(rows, "id long, product string, spec string, model string")
    words = spark.createDataFrame([(w,) for w in ("ring", "RING", "large", "tray", "tin", None, "arge")], "word string")
    out = match.glued_rows(words, goods)
    got = [(r["word"], r["id"]) for r in out.collect()]
    assert sorted(got) == [("arge", 1), ("arge", 2), ("large", 1), ("large", 2), ("ring", 1), ("ring", 2), ("tray", 1), ("tray", 2)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.count("Aggregate [word#") == 1


def test_scores_are_dealt_by_document(spark, monkeypatch):
    """As many tasks as there are scores to hold, and no shuffle of the scores themselves."""
    monkeypatch.setattr(match, "SCORES_A_TASK", 10, raising=False)
    docs = spark.range(40).select("id", F.concat(F.lit("tray "), F.when(F.col("id") % 4 == 0, "ring ").otherwise(""), F.col("id").cast("string")).alias("text"))
    terms = spark.createDataFrame([(1, "tray"), (1, "ring"), (2, "ring"), (2, "none")], "request int, term string")
    out = match.bm25(docs, "id", "text", terms, 5)
    got = {(r["request"], r["rank"]): r["id"] for r in out.collect()}
    assert got == {(q, k): 4 * (k - 1) for q in (1, 2) for k in range(1, 6)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 8), REPARTITION_BY_NUM" in plan and "hashpartitioning(request#" in plan
    assert not [x for x in plan.split("\n") if "Exchange" in x and "request#" in x and "id#" in x.split("hashpartitioning")[-1]]


def test_limits_of_a_line_are_read_once(spark):
    """The expression reads the limit of a line and of a piece once each, however often it is used."""
    out = spark.createDataFrame([("ring 2 pcs\ntray [x] under 500",), ("2 rings, 3 trays under 5k",), (None,), ("",), ("821510 4",)], "s string").select(X.prompt_items(F.col("s")).alias("x"))
    limit = X.RANGES[0].replace("\\", "")[:12]
    plan = out._jdf.queryExecution().optimizedPlan().toString().replace("\\", "")
    assert 0 < plan.count(limit) < 60, plan.count(limit)
    assert [r["x"] and len(r["x"]) for r in out.collect()][2:] == [None, None, 1]
