"""Exact deduplication by progressive refinement, in DataFrame functions only.

1. Lengths: rows whose byte length is unique leave at once (only lengths are grouped).
2. Prefix hashes: of the others, rows whose (length, hash of the first characters) is unique leave.
3. Full hash: the content of the surviving groups alone is hashed in full and grouped.

Every grouping combines before its shuffle and carries keys, not texts. Texts move in two
joins: the one that tells which of them are hashed in full, and the one that brings the
decision back, where they only move if the result has them. Both are left joins of shuffled
sides, in which Spark can split a hot key.

Defined results: null text counts as empty; texts are equal when identical after
lower-casing A-Z only; the largest doc_id of a group stays (nulls are smaller than
any number; a group with null ids only has a null keep_id and keeps its rows); rows
that repeat both text and doc_id are one document and get the same answer; an empty
table gives an empty result; further columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. lower() does it for plain ASCII, much faster."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", prefix_chars: int = 64) -> DataFrame:
    """``docs`` plus keep_id, group_size and kept (names of ``docs`` that clash are replaced)."""
    docs = docs.select([c for c in docs.columns if c.lower() not in ("keep_id", "group_size", "kept")])
    n, p, full, hit, gid, size, top = fresh(docs, "_len", "_prefix", "_full", "_hit", "_gid", "_size", "_top")
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn(n, F.octet_length(body)).withColumn(
        p, F.xxhash64(F.translate(F.substring(body, 1, prefix_chars), UPPER, UPPER.lower()))
    )
    keys = keyed.select(n, p)
    lengths = keys.groupBy(n).agg(F.count("*").alias(size)).filter(F.col(size) > 1).select(n)
    prefixes = keys.join(lengths, n, "left_semi").groupBy(n, p).agg(F.count("*").alias(size))
    prefixes = prefixes.filter(F.col(size) > 1).select(n, p, F.lit(True).alias(hit))
    # Rows that have left keep a key of their own, so that they don't meet under one null key.
    alone = F.concat_ws(":", F.col(n).cast("string"), F.col(p).cast("string"))
    marked = keyed.join(prefixes, [n, p], "left").withColumn(
        full, F.when(F.col(hit), F.sha2(ascii_lower(F.col(text)).cast("binary"), 256)).otherwise(alone)
    )
    groups = (
        marked.filter(F.col(hit))
        .groupBy(F.col(full).alias(gid))
        .agg(F.max(id_col).alias(top), F.count("*").alias(size))
        .filter(F.col(size) > 1)
    )
    out = marked.join(groups, F.col(full) == F.col(gid), "left")
    found = F.col(gid).isNotNull()
    return out.select(
        *docs.columns,
        F.when(found, F.col(top)).otherwise(F.col(id_col)).alias("keep_id"),
        F.when(found, F.col(size)).otherwise(F.lit(1)).cast("long").alias("group_size"),
        F.when(found, F.col(top).eqNullSafe(F.col(id_col))).otherwise(F.lit(True)).alias("kept"),
    )


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(ascii_lower(F.col("text")).cast("binary"), 256))
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = f"""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
