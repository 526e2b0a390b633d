"""Rows that a phrase can't tell apart: results by classes are those of judging every candidate, and few rows are judged."""

import random

import compare
import pytest
from pyspark.sql import functions as F
from test_cascade import SCHEMA
from test_copies import copied  # noqa: F401  a fixture

from tessera.operators import cascade, match
from tessera.plans import cascade as plans  # noqa: F401  adds its queries
from tessera.plans.registry import ORACLE_SQL, QUERIES


def every_candidate(asks, prod, hits, s, most, past=None):
    """What was judged before: every row that shares a request's rarest words, stands inside it or equals it."""
    rows = cascade.word_candidates(asks, prod, s.part_share, hits).unionByName(cascade.reverse_candidates(asks, prod))
    return rows.unionByName(cascade.name_candidates(asks, prod))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_lose_nothing(spark, monkeypatch, seed):
    r = random.Random(seed)
    words = "round steel tray cup lid bowl large indigo".split()
    name = lambda n: " ".join(r.choice(words) for _ in range(n))
    size = lambda: r.choice(["", "", f" {r.randint(1, 6)} ltr", f" {r.randint(1, 6)}.0l", f" {r.randint(1, 30)}cm", f" {r.randint(1, 6)}", f" {r.randint(1, 3)}/{r.randint(2, 4)}", ' 3"'])
    rows = []
    for i in range(600):
        brand, code = r.choice([None, "ACME", "ACME BE", "Zeta"]), r.choice([None, f"C{r.randint(1, 40)}", f"C{r.randint(1, 40)}-SS"])
        product = r.choice(["", f"{brand}-{code}-", "Acme-Casper-"]) + name(r.randint(1, 3)) + size()
        hsn, price, file = r.choice([None, "3924101", "392411"]), r.choice([None, 0.0, float(r.randint(1, 9))]), r.choice(["Indigo list.xls", "f1", None])
        rows.append((i, product, brand, code, r.choice([None, name(2), name(3) + size()]), hsn, price, r.choice([True, False, None]), file))
    products = spark.createDataFrame(rows, SCHEMA)
    codes = ["c1", "find c12", "c3-ss tray", "392410", "tray 392411 cup", "cup c4 3 ltr", "only acme items", "tray 12 100", "", "acme", "x 5", "gn be"]
    phrases = [name(r.randint(1, 4)) + size() for _ in range(70)] + [r.choice(["acme ", "acme be ", "indigo ", "zeta indigo ", "need "]) + name(r.randint(1, 2)) + size() for _ in range(30)] + codes + [x[1] for x in rows[:15]]
    req = spark.createDataFrame([(i, p, r.choice([None, None, None, name(1)])) for i, p in enumerate(phrases)], "request long, phrase string, label string")
    past = spark.createDataFrame([(r.choice(phrases), x[1], x[3], r.randint(1, 3)) for x in r.choices(rows, k=80)], "phrase string, product string, model string, times int")
    like = spark.createDataFrame([(r.choice(phrases), r.randrange(600), r.choice([0.3, 0.65, 0.73, 0.9])) for _ in range(120)], "phrase string, id long, like double")
    run = lambda: sorted((tuple(x) for x in cascade.resolve(req, products, 3, past, like, cascade.Scores(members_of=4)).collect()), key=repr)
    got = run()
    monkeypatch.setattr(cascade, "class_candidates", every_candidate)
    assert got == run()


def test_few_rows_of_a_class_are_judged(spark, monkeypatch):
    """Of many rows with one name a request takes as many as can be among its first, however many there are."""
    judged, write = {}, cascade.materialize

    def counted(df, name):
        out = write(df, name)
        judged[name] = out.count()
        return out

    monkeypatch.setattr(cascade, "materialize", counted)
    n, most = 2000, cascade.Scores().members_of
    rows = spark.range(n).select("id", F.lit("round tray").alias("product"), F.lit("b").alias("brand"), F.concat(F.lit("M"), "id").alias("model"), F.lit("s").alias("spec"), F.lit("").alias("hsn"), (F.col("id") % 3).cast("double").alias("price"), F.lit(False).alias("image"), F.concat(F.lit("f"), "id").alias("file_name"))
    asks = spark.createDataFrame([(1, "round tray"), (2, "trays"), (3, "a large round tray"), (4, "tray M1999")], "request long, phrase string")
    out = {}
    for x in cascade.resolve(asks, rows).orderBy("rank").collect():
        out.setdefault(x["request"], []).append(x["id"])
    assert out[1] == out[2] == [1 + 3 * i for i in range(15)]
    assert out[4] == [1999] and judged["cascade-judged"] <= 3 * most + 2


@pytest.mark.parametrize("name", ["resolve_full", "resolve_with_history"])
def test_same_as_sql_on_copies(spark, copied, name):  # noqa: F811
    compare.same(spark, name, QUERIES[name], ORACLE_SQL[name], copied)


def test_past_choices_meet_their_classes_only(spark, monkeypatch):
    """A past choice is no candidate of a phrase that shares no word with it."""
    judged, write = {}, cascade.materialize

    def counted(df, name):
        out = write(df, name)
        judged[name] = out.count()
        return out

    monkeypatch.setattr(cascade, "materialize", counted)
    rows = spark.createDataFrame([(i, "round tray" if i < 9 else "steel cup", "b", "M", "s", "", 1.0, False, "f") for i in range(500)], SCHEMA)
    past = spark.createDataFrame([("tray", "round tray", "M", 2), ("tray", "steel cup", "M", 5)], "phrase string, product string, model string, times int")
    got = cascade.resolve(spark.createDataFrame([(1, "tray")], "request long, phrase string"), rows, history=past).collect()
    assert sorted((x["id"], x["score"]) for x in got) == [(i, 600 - 10 + 30 + 1650) for i in range(9)] and judged["cascade-pairs"] == 9


def test_words_of_the_catalogue_are_not_broadcast(spark, monkeypatch):
    """The pool's words of all documents are shuffled, however small their file looks."""
    plans_, write = {}, match.materialize

    def seen(df, name):
        plans_[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(match, "materialize", seen)
    docs = spark.range(50).select("id", F.concat(F.lit("round tray "), "id").alias("text"))
    out = match.prefix_pool(spark.createDataFrame([(1, "tray 1")], "request long, phrase string"), docs)
    assert out.count() == 50 and "SortMergeJoin [term#" in plans_["pool-hits"]
