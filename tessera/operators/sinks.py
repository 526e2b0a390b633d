"""Sinks that can be repeated: replacing by partition, content that is stored once, and an audit log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.scratch import materialize

#: Rows of one file that one task writes.
FILE_ROWS = 1_000_000


def _there(df: DataFrame, path: str) -> DataFrame | None:
    """What lies at ``path`` with the columns of ``df``, or None."""
    try:
        return df.sparkSession.read.schema(df.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def replace_files(rows: DataFrame, path: str, by: str = "file_name") -> None:
    """The rows of every file that ``rows`` names replace those at ``path``; partitions of other files stay untouched.

    A large file is written by several tasks; a rerun leaves the same rows.
    """
    sizes = rows.groupBy(F.col(by).alias("_by")).agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("_parts"))
    dealt = rows.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).drop("_by").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.col("_parts")))
    dealt = dealt.repartition(by, "_part").drop("_parts", "_part")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def store_content(rows: DataFrame, path: str, content: str = "content", shard_digits: int = 2) -> DataFrame:
    """Stores each different content once under its sha256, in shards of its first digits, and returns the digests that are new.

    What lies there is looked up in the shards by digest; a rerun stores nothing.
    """
    digest = F.sha2(F.col(content).cast("binary"), 256)
    new = rows.filter(F.col(content).isNotNull()).select(digest.alias("digest"), F.col(content)).dropDuplicates(["digest"])
    new = new.withColumn("shard", F.substring("digest", 1, shard_digits))
    if (there := _there(new, path)) is not None:
        new = new.join(there.select("shard", "digest"), ["shard", "digest"], "left_anti").select("digest", content, "shard")
    digests = materialize(new.select("digest", "shard"), "content-new")  # told before the files change
    new.write.mode("append").partitionBy("shard").parquet(path)
    return digests


def append_audit(rows: DataFrame, path: str, key: str = "event_id", day: Column | None = None) -> int:
    """Appends audit rows that the log doesn't hold yet, by ``key``, in partitions by day; returns how many were new."""
    new = rows.dropDuplicates([key]).withColumn("day", day if day is not None else F.to_date("ts"))
    if (there := _there(new, path)) is not None:
        new = new.join(there.select("day", key), ["day", key], "left_anti").select(*new.columns)
    new = new.persist()
    n = new.count()
    if n:
        new.write.mode("append").partitionBy("day").parquet(path)
    new.unpersist()
    return n


def keep_snapshot(rows: DataFrame, path: str, version: int) -> None:
    """Results of a resolver run as version n; a rerun replaces it."""
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(request, state, old_id, new_id, old_rank): what became of each request's first row: same, moved (still listed), gone, lost (none now), found (none before)."""
    first = lambda df, name: df.filter("rank = 1 or rank is null").select("request", F.col("id").alias(name))
    both = first(old, "old_id").join(first(new, "new_id"), "request", "full")
    listed = new.select("request", F.col("id").alias("old_id"), F.col("rank").alias("now"))
    both = both.join(listed, ["request", "old_id"], "left")
    state = (
        F.when(F.col("old_id").eqNullSafe(F.col("new_id")), "same").when(F.col("old_id").isNull(), "found").when(F.col("new_id").isNull(), "lost")
        .when(F.col("now").isNotNull(), "moved").otherwise("gone")
    )
    return both.select("request", state.alias("state"), "old_id", "new_id", F.col("now").alias("rank_now"))
