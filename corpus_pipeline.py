"""Training corpus pipeline: quality filter, exact and near deduplication, mixing, packing.

Every stage takes all rows that its predecessor kept and, but for the last, returns the columns
of ``documents`` as they are, whatever their names. Defined results in every stage: null text
counts as empty; any length of text is read whole; an empty table gives an empty one; rows
that repeat id and text get one answer; further columns pass through, also where their names
clash with those of an operator's results (only the last stage drops them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialize
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.mixing import mix_sources
from tessera.llm.near_dedup import near_dedup
from tessera.llm.packing import pack
from tessera.llm.quality import CUT, fit_quality, score_quality


def _guarded(docs: DataFrame, new: tuple[str, ...], operate) -> DataFrame:
    """``operate(docs)`` with the columns of ``docs``; those named like the operator's ``new`` ones stand aside meanwhile."""
    clash = [c for c in docs.columns if c.lower() in new]
    aside = docs.withColumnsRenamed(dict(zip(clash, fresh(docs, *(f"_own_{c}" for c in clash)), strict=True)))
    return operate(aside).select(aside.columns).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least CUT stay; the model learns from the labels of these documents.

    Null and empty texts get a score as any other; without labels of both kinds all documents
    get the share of label 1 (0.5 without any label).
    """
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "_score")
    return score_quality(docs, model, name=score).filter(F.col(score) >= CUT).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z), the row with the largest doc_id stays.

    Null ids are the smallest; rows that tie on it all stay (they repeat each other).
    """
    return _guarded(docs, ("keep_id", "group_size", "kept"), lambda d: exact_dedup(d).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component, the document with the smallest doc_id stays.

    Texts without words are linked with nothing and stay. A null id stays where its component
    has no other id.
    """
    return _guarded(docs, ("n_shingles", "component_id", "kept"), lambda d: near_dedup(d).filter("kept"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times).

    Null sources are a source of their own; documents without words, which can't change the
    words of a source, are taken with the whole copies of their source's rate.
    """

    def copied(d):
        return mix_sources(d).filter("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies"))))

    return _guarded(docs, ("size", "source_size", "target", "copies", "taken"), copied)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens; ties on the curve go by doc_id and text hash."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", packing)]

#: SQL can express neither the classifier nor the draws of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
