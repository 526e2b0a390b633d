"""Evidence, corrections and upserts: append-only logs turned into state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def phrase_history(log: DataFrame, k: int = 6) -> DataFrame:
    """Per phrase the k products seen most often, the latest first among equals."""
    n = log.groupBy("phrase", "product").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    order = Window.partitionBy("phrase").orderBy(F.desc("n"), F.desc("last"), "product")
    return n.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("last")


def latest_upsert(log: DataFrame, keys: list[str]) -> DataFrame:
    """Last writer of each key, with the number of writes; rows combine before they are shuffled."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("row"), F.count("*").alias("times"))
    return last.select(*keys, "row.*", "times")


def confirm(corrections: DataFrame, seen: DataFrame) -> DataFrame:
    """Counter of each correction raised by equal confirmations only."""
    n = seen.groupBy("phrase", "product").agg(F.count("*").alias("extra"))
    return corrections.join(n, ["phrase", "product"], "left").withColumn("times", F.col("times") + F.coalesce("extra", F.lit(0))).drop("extra")


def changed_lines(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys whose value differs between two versions (null-safe)."""
    rows = old.select(*key, F.col(value).alias("before")).join(new.select(*key, F.col(value).alias("after")), key)
    return rows.filter(~F.col("before").eqNullSafe(F.col("after")))


def insert_missing(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` plus the rows whose trimmed lower-case keys it lacks."""
    norm = [F.lower(F.trim(F.coalesce(k, F.lit("")))).alias(f"_{i}") for i, k in enumerate(keys)]
    own = base.select(*norm).distinct()
    new = rows.select("*", *norm).join(own, [f"_{i}" for i in range(len(keys))], "left_anti").drop(*[f"_{i}" for i in range(len(keys))])
    return base.unionByName(new)


def daily_counts(log: DataFrame, days: int) -> DataFrame:
    """Counts of the last ``days`` days that have any event."""
    return log.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(days)
