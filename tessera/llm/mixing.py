"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words; a document's expected copies are target / source
size, at most 2. Whole copies are certain, and the fractions are rounded by pivotal
sampling: two fractional documents move mass (in words, so that the sum stays) from
one to the other until one is integral, the direction drawn so that expectations stay.
A source is cut into leaves of about LEAF documents by hash; each leaf leaves at most
one fractional document, and these residuals meet in a reduction tree of fan-in LEAF,
so no task sees a whole source. The one fraction that is left of a source goes to the
nearer side: its taken words differ from its target by at most half a document. Draws are seeded by source and leaf and rows are ordered by hash:
reruns agree.

Defined results: null text has size 0 and takes 0 words; a null source is a source of
its own, ordered last; rows equal in source, doc_id and text share one decision and
weigh together; an empty table gives an empty result; clashing column names are replaced.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import by_value, fresh, materialize, words_count

by_value(__name__)

#: Documents per leaf, and fan-in of the reduction tree.
LEAF = 4096
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, size) rows -> source, source_size, target, n_docs. Windows run over distinct sources only."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.lit(MOST) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("wanted", F.lit(SHARE) * F.sum("source_size").over(every))
    level = (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    per = per.withColumn("level", level).withColumn("rank", F.row_number().over(by_ratio))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("rank", "level"))
    per = per.withColumn("level", F.min(fits).over(every)["level"])
    return per.select("source", "source_size", F.least("cap", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")).alias("target"), "n_docs")


def _round_leaf(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Pivotal rounding within one leaf; at most one row keeps a fraction."""
    rows = rows.sort_values(["h", "doc_id"], kind="mergesort").reset_index(drop=True)
    draw = random.Random(f"{key[0]!r}/{key[1]}/{int(rows['level'].iat[0])}/{len(rows)}/{int(rows['h'].iat[0])}").random
    p, s = rows["p"].tolist(), rows["mass"].tolist()
    open_, eps = -1, 1e-12
    for i in range(len(p)):
        if not eps < p[i] < 1 - eps or s[i] <= 0:
            p[i] = 1.0 if p[i] >= 1 - eps and s[i] > 0 else 0.0
            continue
        if open_ < 0:
            open_ = i
            continue
        a = min(s[open_] * (1 - p[open_]), s[i] * p[i])  # the open one gains
        b = min(s[open_] * p[open_], s[i] * (1 - p[i]))  # the open one gives
        move = a if draw() * (a + b) < b else -b
        p[open_] += move / s[open_]
        p[i] -= move / s[i]
        left = [j for j in (open_, i) if eps < p[j] < 1 - eps]
        for j in (open_, i):
            if j not in left:
                p[j] = float(round(p[j]))
        open_ = left[0] if left else -1
    if open_ >= 0 and bool(rows["root"].iat[0]):
        p[open_] = 1.0 if p[open_] >= 0.5 else 0.0  # the one document that is left goes to the nearer side
    rows["p"] = p
    return rows


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``docs`` plus size, source_size, target, copies and taken (words)."""
    new = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.select([c for c in docs.columns if c.lower() not in new])
    h, n = fresh(docs, "_h", "_n")
    keyed = docs.withColumn(n, words_count(F.col(text))).withColumn(h, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    slim = keyed.select(F.col(source).alias("source"), F.col(id_col).alias("doc_id"), F.col(h).alias("h"), F.col(n).alias("size"))
    slim = materialize(slim.groupBy("source", "doc_id", "h", "size").agg(F.count("*").alias("m")), "mix-docs")
    totals = materialize(source_targets(slim.select("source", (F.col("size") * F.col("m")).alias("size"))), "mix-sources")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = totals.withColumnRenamed("source", "_s")
    rows = slim.join(t, slim["source"].eqNullSafe(t["_s"]), "left").drop("_s").withColumn("want", want)
    whole = F.floor(F.col("want") + F.lit(1e-12))
    leaves = F.ceil(F.col("n_docs") / LEAF)
    rows = rows.select(
        "source", "doc_id", "h", "size", "m", "source_size", "target", whole.cast("long").alias("whole"),
        F.greatest(F.lit(0.0), F.col("want") - whole).alias("p"), (F.col("size") * F.col("m")).cast("double").alias("mass"),
        F.pmod(F.xxhash64("h", "doc_id"), leaves).alias("leaf"), F.lit(0).alias("level"), (leaves <= 1).alias("root"), leaves.alias("leaves"),
    )
    level, parts, most = 0, [], totals.agg(F.max(F.ceil(F.col("n_docs") / LEAF))).first()[0] or 1
    while True:
        done = materialize(rows.groupBy("source", "leaf").applyInPandas(_round_leaf, rows.schema), f"mix-level{level}")
        parts.append(done.filter((F.col("p") == 0) | (F.col("p") == 1)))
        if most <= 1:
            break
        level, most = level + 1, -(-most // LEAF)
        up = F.ceil(F.col("leaves") / LEAF)
        rows = done.filter((F.col("p") > 0) & (F.col("p") < 1)).withColumns(
            {"leaf": F.floor(F.col("leaf") / LEAF), "level": F.lit(level), "leaves": up, "root": up <= 1}
        )
    decided = parts[0]
    for x in parts[1:]:
        decided = decided.unionByName(x)
    decided = decided.select(
        F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("h").alias("_hh"), "source_size", "target",
        (F.col("whole") + F.col("p").cast("long")).alias("copies"),
    )
    joined = keyed.join(
        decided, keyed[source].eqNullSafe(F.col("_s")) & keyed[id_col].eqNullSafe(F.col("_d")) & (keyed[h] == F.col("_hh")), "left"
    )
    return joined.select(
        *[keyed[c] for c in docs.columns], keyed[n].alias("size"), "source_size", "target", "copies", (keyed[n] * F.col("copies")).alias("taken")
    )


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
