"""Many copies: results on tables of copies with shifted keys, and the rows that a plan makes on the way."""

import os
import time

import compare
import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import match
from tessera.operators import rules as R
from tessera.plans import cascade, formulas, requests, rules, sheets  # noqa: F401  add their queries
from tessera.plans.registry import ORACLE_SQL, QUERIES

SF, TIMES = "/root/testdata/sf0.001", 4
SHIFTS = {"part": ["p_partkey"], "supplier": ["s_suppkey"], "customer": ["c_custkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """The smallest tables, TIMES over, keys shifted."""
    path, con = tmp_path_factory.mktemp("copied"), duckdb.connect()
    keys = {"partkey": "part", "suppkey": "supplier", "custkey": "customer", "orderkey": "orders"}
    n = {k: con.sql(f"SELECT max({t[0] if t != 'supplier' else 's'}_{k}) + 1 FROM read_parquet('{SF}/{t}.parquet')").fetchall()[0][0] for k, t in keys.items()}
    for t in compare.TABLES:
        if t in SHIFTS:
            moved = ", ".join(f"{c} + i * {n[c.split('_')[1]]} AS {c}" for c in SHIFTS[t])
            con.sql(f"COPY (SELECT * REPLACE ({moved}) FROM read_parquet('{SF}/{t}.parquet'), range({TIMES}) AS x(i)) TO '{path}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SF}/{t}.parquet", path / f"{t}.parquet")
    return str(path)


def widest(spark, run):
    """The most rows that one step of the plans of ``run()`` puts out."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    done = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    most, plans = 0, store.executionsList(int(done), 10_000)
    for i in range(plans.size()):
        plan = plans.apply(i)
        values, metrics = store.executionMetrics(plan.executionId()), plan.metrics()
        for j in range(metrics.size()):
            m = metrics.apply(j)
            v = values.get(m.accumulatorId()) if m.name() == "number of output rows" else None
            if v is not None and v.isDefined():
                most = max(most, int(v.get().split("\n")[-1].split(" ")[0].replace(",", "")))
    return most


@pytest.mark.parametrize("name", ["resolve_requests", "loose_suggestions", "hard_qualifiers", "candidate_union", "code_suffix_lookup", "prefix_pool", "matched_rows", "best_sheet", "sheet_rows", "column_report"])
def test_same_as_sql_on_copies(spark, copied, name):
    compare.same(spark, name, QUERIES[name], ORACLE_SQL[name], copied)


N = 400


def goods(spark, **more):
    """N rows of one name and model."""
    columns = {"product": "round tray", "model": "C7", "brand": "b", "spec": "s", **more}
    rows = spark.range(N).select("id", *[F.lit(v).alias(k) for k, v in columns.items()])
    return rows.withColumns({"size": F.lit(5), "price": F.when(F.col("id") % 3 != 0, F.col("id") + 1).cast("decimal(18,2)")})


def asks(spark, phrase):
    return spark.range(N).select(F.col("id").alias("request"), F.lit(phrase).alias("phrase"))


def test_copies_of_a_phrase_meet_copies_of_a_name_once(spark):
    for phrase in ("round tray", "C7"):
        out = match.resolve(asks(spark, phrase), goods(spark))
        assert widest(spark, out.collect) <= 15 * N
        assert out.filter("rank = 1 and id = 1").count() == N and out.count() == 15 * N


def test_copies_in_suggestions(spark):
    out = R.suggestions(asks(spark, "trays round"), goods(spark))
    assert widest(spark, out.collect) <= 6 * N
    assert {tuple(r) for r in out.select("id", "score", "rank").distinct().collect()} == {(i, 3040, k) for k, i in enumerate((1, 2, 4, 5, 7, 8), 1)}


def test_qualifiers_are_told_once_for_each_text(spark):
    """Rows that don't carry the size never meet the requests."""
    asked = asks(spark, "tray 5cm").withColumn("head", F.lit("tray"))
    names = goods(spark).select("id", F.lit("tray").alias("head"), F.concat(F.lit("tray "), (F.col("id") % 100).cast("string"), F.lit(".0 CM")).alias("name"))
    out = R.carrying(asked, names)
    assert widest(spark, out.collect) <= N * 4
    assert sorted(r["id"] for r in out.filter("request = 3").collect()) == [5, 105, 205, 305]
    odd = spark.createDataFrame([(1, "h", "pan 2.5"), (2, "h", "lid ab-12"), (3, "h", "cup"), (4, "h", '3 " tin 1/2')], "request int, head string, phrase string")
    have = spark.createDataFrame([(1, "h", "pan 2.50 x"), (2, "h", "LID AB-12"), (3, "h", '13" 1/2'), (4, "h", '3" of 1/2')], "id int, head string, name string")
    assert {tuple(r) for r in R.carrying(odd, have).collect()} == {(1, 1), (2, 2), *((3, i) for i in (1, 2, 3, 4)), (4, 4)}


def test_pairs_of_candidates_are_not_grouped(spark):
    rows = goods(spark).filter("id < 30")
    out = R.candidate_pairs(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [q#") == 1 and "twice" in plan
    assert out.count() == 30 * 29 and out.filter("source = 1 and n_sources = 2").count() == 30 * 29
    odd = spark.createDataFrame([(1, "m", "b", 1, "s"), (1, "m", "b", 1, "s"), (2, "m", "b", 1, "s"), (3, None, "b", 1, "s"), (4, None, "c", 1, "s")], "id int, model string, brand string, size int, spec string")
    assert {tuple(r) for r in R.candidate_pairs(odd).collect()} == {(1, 2, 1, 4), (2, 1, 1, 4), (1, 3, 2, 2), (3, 1, 2, 2), (2, 3, 2, 1), (3, 2, 2, 1)}


def test_codes_meet_models_once(spark):
    codes = spark.range(N).select(F.col("id").alias("request"), F.lit("X-C7").alias("code"))
    out = match.code_lookup(codes, goods(spark, model="xc7").unionByName(goods(spark, model="c7")))
    assert widest(spark, out.collect) <= 2 * N
    assert out.filter("key = 'xc7' and id = 0").count() == N


def test_pool_scores_classes(spark):
    docs = spark.range(N).select("id", F.concat(F.lit("round tray c"), (F.col("id") % 100 + 100).cast("string")).alias("text"))
    ways = F.concat(F.lit("tray "), F.when(F.col("id") % 2 == 0, F.lit("c107")).otherwise(F.concat(F.lit("x"), "id")))
    out = match.prefix_pool(spark.range(N).select(F.col("id").alias("request"), ways.alias("phrase")), docs, k=20)
    assert widest(spark, out.collect) <= 25 * N
    assert [r["id"] for r in out.filter("request = 6").orderBy("rank").collect()] == [7, 107, 207, 307, *range(7), *range(8, 17)]


def moved(spark, run):
    """Bytes that ``run()`` writes for shuffles."""
    jsc = spark.sparkContext._jsc.sc()

    def written():
        jsc.listenerBus().waitUntilEmpty()
        time.sleep(1)
        tracks = jsc.statusStore().executorList(False)
        return sum(tracks.apply(i).totalShuffleWrite() for i in range(tracks.size()))

    before = written()
    run()
    return written() - before


@pytest.mark.parametrize("name, bytes_", [("matched_rows", 80), ("best_sheet", 80), ("sheet_rows", 80), ("column_report", 8)])
def test_sheets_are_shuffled_once(spark, copied, name, bytes_):
    """Bytes of shuffle for each line, where nothing is small enough to be broadcast."""
    lines = spark.read.parquet(f"{copied}/lineitem.parquet").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert moved(spark, lambda: QUERIES[name](spark, copied).write.format("noop").mode("overwrite").save()) < bytes_ * lines
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
