"""Rules against plain Python, where SQL can't say them, and streaming upserts."""

import difflib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.operators import rules, sheets
from tessera.plans import rules as plans
from tessera.plans import sheets as sheet_plans
from tessera.streaming import streams

SF = "/root/testdata/sf0.001"


def test_look_ahead(spark):
    r = random.Random(1)
    names = ["round tray", "ice box", "table fork", "soup spoon", "chop board", "waste bin", "glass jug"]
    rows, want = [], {}
    for doc in range(12):
        source = [r.choice(names) for _ in range(9)]
        answers = [s + r.choice(["", " new"]) for s in source if r.random() < 0.7]
        rows += [(doc, 0, i, s) for i, s in enumerate(source)] + [(doc, 1, i, s) for i, s in enumerate(answers)]
        at = 0
        for i in range(len(source)):
            want[doc, i] = None
        for i, a in enumerate(answers):
            for k in range(at, min(at + 6, len(source))):
                if difflib.SequenceMatcher(None, source[k], a).ratio() >= 0.6:
                    want[doc, k], at = i, k + 1
                    break
    got = rules.look_ahead(spark.createDataFrame(rows, "doc long, side int, pos long, label string")).collect()
    assert {(x["doc"], x["pos"]): x["match"] for x in got} == want
    assert plans.look_ahead_merge(spark, SF).filter("match is not null").count() > 1000


def test_header_suggestions(spark):
    aliases = {"PRODUCT NAME": "product", "UNIT PRICE": "price", "GST %": "gst"}
    labels = ["PRODUCT NAME", "PRODUCTS NAME", "RATE PER PC", "STOCK", "TAX SLAB", "ZZZ"]
    got = {x["label"]: (x["field"], x["score"]) for x in sheets.suggest_fields(spark.createDataFrame([(x,) for x in labels], "label string"), aliases).collect()}
    assert got["PRODUCT NAME"] == ("product", 1.0) and got["PRODUCTS NAME"][0] == "product" and got["RATE PER PC"] == ("price", 0.6)
    assert got["STOCK"] == (None, 0.0) and got["TAX SLAB"] == ("gst", 0.6) and got["ZZZ"] == (None, 0.0)
    assert sheet_plans.header_suggestions(spark, SF).count() >= 15


def test_tokens_covered(spark):
    words = {r["word"] for r in plans.asked(plans.catalogue(spark, SF)).select(F.explode(F.split("phrase", " ")).alias("word")).collect()}
    names = {r["id"]: r["product"].lower() for r in plans.catalogue(spark, SF).collect()}
    want = set()
    for w in words - {"5", "ltr"}:
        other = w[:-1] if w.endswith("s") and len(w) > 3 else w + "s"
        want |= {(w, i) for i, n in names.items() if {w, other} & set(n.split())}
    got = {(x["word"], x["id"]) for x in plans.tokens_covered(spark, SF).collect()}
    assert want <= got and all(w[:3] in names[i].replace(" ", "") for w, i in got if len(w) > 3)


def test_qualifiers(spark):
    rows = [
        ("ice box 25 ltr", "RIC125LTRWT", False), ("ice box 25 ltr", "Ice Box 25 Litre", True), ("kettle 1.0 l", "kettle 1ltr", True), ("kettle 1 litre", "kettle 1.0l", True),
        ("gn pan 1/3 150mm", "gn pan 1/9-150mm", False), ("gn pan 1/3 150mm", "gn pan 1/3-150 mm", True), ("crate 300 x 200", "crate 300*200", True), ("crate 300 x 200", "crate 300x250", False),
        ('scraper 4.5" dia x 1.25" ht', 'scraper 4.5"-1.25" ht', True), ('scraper 5"', 'scraper 15"', False), ("chiller wcce001-ss", "x wcce001-ss y", True), ("chiller wcce001-ss", "x wcce002-ss", False), ("plain tray", "any", True),
    ]
    got = spark.createDataFrame(rows, "phrase string, name string, want boolean")
    got = got.withColumn("g", rules.qualifier_groups(F.col("phrase"))).withColumn("hit", rules.qualified(F.col("g"), F.col("name"))).collect()
    assert [(x["phrase"], x["name"], x["g"]) for x in got if x["hit"] != x["want"]] == []


def test_amounts(spark):
    rows = [(0,), (7,), (21,), (100,), (115,), (1000,), (100000,), (12345678,), (9999999999,)]
    got = [x["w"] for x in spark.createDataFrame(rows, "v long").select(rules.amount_words(F.col("v")).alias("w")).collect()]
    assert got[:7] == ["zero", "seven", "twenty one", "one hundred", "one hundred fifteen", "one thousand", "one lakh"]
    assert got[7] == "one crore twenty three lakh forty five thousand six hundred seventy eight"
    assert got[8] == "nine hundred ninety nine crore ninety nine lakh ninety nine thousand nine hundred ninety nine"


def test_upserts_and_mark(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, r.randint(0, 50), f"k{r.randint(0, 5)}", r.random()) for i in range(90)]
    for n in range(3):
        spark.createDataFrame(rows[n * 30 : n * 30 + 30], "event_id long, ts long, key string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    streams.upserts(streams.read_files(spark, str(tmp_path / "in"), schema), ["key"], str(tmp_path / "out"), str(tmp_path / "ck"))
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir())
    assert last == 2
    table = spark.read.parquet(str(tmp_path / "out" / f"version={last}"))
    want = defaultdict(lambda: [(-1, -1), 0])
    for i, ts, k, _ in rows:
        want[k] = [max(want[k][0], (ts, i)), want[k][1] + 1]
    assert {x["key"]: [(x["ts"], x["event_id"]), x["times"]] for x in table.collect()} == dict(want)
    mark = streams.content_mark(table)
    assert mark == streams.content_mark(table.repartition(3)) and mark != streams.content_mark(table.limit(3))


def test_late_events(spark, tmp_path):
    """An event older than the watermark is left out, a repeated id is counted once."""
    rows = [[(1, "2024-01-05 10:00:00"), (2, "2024-01-05 11:00:00")], [(5, "2024-01-05 11:30:00")], [(2, "2024-01-05 11:00:00"), (3, "2024-01-01 00:00:00"), (4, "2024-01-05 12:00:00")]]
    for n, part in enumerate(rows):
        df = spark.createDataFrame(part, "event_id long, t string").select("event_id", F.to_timestamp("t").alias("ts"))
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema("event_id long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = streams.unique_events(source, "1 hour").writeStream.format("memory").queryName("unique_late").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(x["event_id"] for x in spark.table("unique_late").collect()) == [1, 2, 4, 5]
