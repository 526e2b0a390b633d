"""Sinks that are repeated, results that are reused in a stream, and an index that follows changes."""

import os
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import cascade, sinks
from tessera.streaming import streams


def files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_replace_files(spark, tmp_path):
    path = str(tmp_path / "cat")
    make = lambda names, price: spark.createDataFrame([(i, n, price) for n in names for i in range(5)], "id int, file_name string, price int")
    sinks.replace_files(make(["a", "b", "c"], 1), path)
    before = files(path)
    sinks.replace_files(make(["b"], 2), path)
    now = Counter((r["file_name"], r["price"]) for r in spark.read.parquet(path).collect())
    assert now == {("a", 1): 5, ("b", 2): 5, ("c", 1): 5}
    kept = lambda x: {f for f in x if "=b/" not in f}
    assert kept(before) == kept(files(path)) and before != files(path)
    sinks.replace_files(make(["b"], 2), path)
    assert Counter((r["file_name"], r["price"]) for r in spark.read.parquet(path).collect()) == now


def test_store_content(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(f"text {i % 40}",) for i in range(100)] + [(None,)], "content string")
    assert sinks.store_content(rows, path).count() == 40
    before = files(path)
    assert sinks.store_content(rows, path).count() == 0 and files(path) == before
    more = rows.unionByName(spark.createDataFrame([("new",)], "content string"))
    assert sinks.store_content(more, path).count() == 1
    stored = spark.read.parquet(path)
    assert stored.count() == 41 == stored.select("digest").distinct().count()
    assert stored.filter(F.sha2(F.col("content").cast("binary"), 256) != F.col("digest")).count() == 0


def test_audit(spark, tmp_path):
    path = str(tmp_path / "log")
    make = lambda ids: spark.createDataFrame([(i, f"2024-01-0{i % 3 + 1} 10:00:00", "edit") for i in ids], "event_id long, t string, what string").withColumn("ts", F.to_timestamp("t"))
    assert sinks.append_audit(make(range(9)), path) == 9 and sinks.append_audit(make(range(9)), path) == 0
    assert sinks.append_audit(make(range(5, 14)), path) == 5
    assert spark.read.parquet(path).select("event_id").distinct().count() == 14 == spark.read.parquet(path).count()


def test_snapshots(spark, tmp_path):
    schema = "request int, id long, rank int"
    old = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (3, 30, 1), (4, None, None), (5, 50, 1)], schema)
    new = spark.createDataFrame([(1, 11, 1), (1, 10, 2), (2, 20, 1), (3, None, None), (4, 40, 1), (5, 51, 1)], schema)
    path = str(tmp_path / "snap")
    for n, df in ((1, old), (2, new), (2, new)):
        sinks.keep_snapshot(df, path, n)
    read = [spark.read.parquet(f"{path}/version={n}") for n in (1, 2)]
    got = {r["request"]: (r["state"], r["rank_now"]) for r in sinks.snapshot_diff(*read).collect()}
    assert got == {1: ("moved", 2), 2: ("same", 1), 3: ("lost", None), 4: ("found", None), 5: ("gone", None)}


SCHEMA = "id long, product string, brand string, model string, spec string, hsn string, price double, image boolean, file_name string"


def test_reusing(spark, tmp_path):
    goods = spark.createDataFrame([(i, p, None, f"m{i}", "", "", 5.0 + i, False, "f") for i, p in enumerate(["Round Tray", "Ice Box", "Table Fork"])], SCHEMA)
    batches = [["tray", "ice box"], ["Tray", "table fork", "kettle"], ["tray", "ICE  BOX", "kettle"]]
    k = 0
    for n, phrases in enumerate(batches):
        spark.createDataFrame([(k + i, p) for i, p in enumerate(phrases)], "request long, phrase string").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        k += len(phrases)
    seen = []

    def resolve(rows):
        seen.append(sorted(r["phrase"].lower() for r in rows.collect()))
        return cascade.resolve(rows, goods)

    def run(name):
        source = spark.readStream.schema("request long, phrase string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        streams.reusing(source, resolve, str(tmp_path / f"{name}/cache"), str(tmp_path / f"{name}/out"), str(tmp_path / f"{name}/ck"))
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / f"{name}/out")).drop("batch").select("request", "id", "tier", "reused").collect())

    rows = run("a")
    assert len(seen) == 3 and sum(map(len, seen)) == 4  # every different phrase once
    assert {r[0]: r[1] for r in rows}.keys() == set(range(8)) and len({r[1] for r in rows if r[0] in (0, 2, 5)}) == 1
    assert sum(not r[3] for r in rows) == 4 and sum(r[3] for r in rows) == 4
    # A batch that is repeated (its checkpoint is lost) reads the parts before it and writes the same again.
    import shutil

    shutil.rmtree(tmp_path / "a/ck")
    assert run("a") == rows


def test_postings_follow_changes(spark, tmp_path):
    r = random.Random(4)
    words = ["tray", "box", "fork", "ice", "round", "x1"]
    changes, now = [], {}
    for i in range(120):
        k = r.randint(0, 25)
        text = None if r.random() < 0.2 else " ".join(r.choices(words, k=r.randint(0, 5)))
        changes.append((k, text, i // 2, i))
        now[k] = text
    for n in range(4):
        spark.createDataFrame(changes[n * 30 : n * 30 + 30], "id long, text string, ts long, event_id long").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    index = streams.Postings(str(tmp_path / "index"))
    source = spark.readStream.schema("id long, text string, ts long, event_id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    index.follow(source, str(tmp_path / "ck"))
    want = Counter((w, k) for k, t in now.items() if t is not None for w in re.findall("[a-z0-9]{2,}", t))

    def same():
        terms, df, totals = index.current(spark)
        assert {(x["term"], x["id"]): x["tf"] for x in terms.collect()} == dict(want)
        assert {x["term"]: x["df"] for x in df.collect()} == dict(Counter(w for w, _ in want))
        assert tuple(totals.first()) == (sum(t is not None for t in now.values()), sum(want.values()))

    same()
    written = len(files(str(tmp_path / "index/terms/batch=3")))
    assert 0 < written
    # The last batch again, as after a failure: nothing changes.
    batch = spark.createDataFrame(changes[90:], "id long, text string, ts long, event_id long")
    index.apply(batch, 3)
    same()
