"""Structured Streaming forms: progressive resolving, evidence counts, daily activity, upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import norm_phrase

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()),
])


def read_files(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def daily_activity(events: DataFrame, delay: str) -> DataFrame:
    """Events a day, late ones up to ``delay``; works on a stream and on a table."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "n")


def evidence_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def unique_events(events: DataFrame, delay: str) -> DataFrame:
    """First of each event id within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def progressive(requests: DataFrame, resolve: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Resolves a request stream in micro-batches until the input is used up; a batch is written once, by its number."""

    def write(batch: DataFrame, number: int) -> None:
        resolve(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upserts(changes: DataFrame, keys: list[str], out: str, checkpoint: str) -> None:
    """Keeps the last writer of each key of a change stream: state ``n`` in ``out/version=n``, each batch from the one before.

    A batch that is repeated after a failure writes the same version again.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct("ts", "event_id")).alias("row"), F.count("*").alias("times"))
        new = new.select("row.*", "times")
        if number:
            old = batch.sparkSession.read.parquet(f"{out}/version={number - 1}")
            both = old.unionByName(new).groupBy(*keys)
            new = both.agg(F.max_by(F.struct(*batch.columns), F.struct("ts", "event_id")).alias("row"), F.sum("times").alias("times")).select("row.*", "times")
        new.write.mode("overwrite").parquet(f"{out}/version={number}")

    changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def content_mark(rows: DataFrame) -> int:
    """A number that changes with any row of a table, whatever their order: tells when an index must be built again."""
    return rows.agg(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.count("*")).select(F.xxhash64("*")).first()[0]


def _before(spark: SparkSession, folder: str, schema: str, number: int) -> DataFrame:
    """What batches before ``number`` have written to ``folder`` (batch=n); a repeated batch doesn't see its own or later parts."""
    if not number:
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").option("basePath", folder).parquet(folder).filter(F.col("batch") < number)


#: Columns of a resolved row, by the content that was asked.
RESOLVED = "key string, id long, tier string, score long, rank int"


def reusing(requests: DataFrame, resolve: Callable[[DataFrame], DataFrame], cache: str, out: str, checkpoint: str) -> None:
    """Resolves a stream of (request, phrase), each different phrase once: what is known is looked up, the rest is resolved and remembered.

    The key is a hash of the normalised phrase. Batch n reads the parts of ``cache`` before n and writes part n of
    ``cache`` and of ``out`` (request, id, tier, score, rank, reused), so a repeated batch writes the same again.
    Every batch writes a part, also if nothing is new.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("request", "phrase", F.sha2(norm_phrase(F.coalesce("phrase", F.lit(""))), 256).alias("key")).persist()
        known = _before(spark, cache, RESOLVED, number).drop("batch")
        asked = rows.groupBy("key").agg(F.min("phrase").alias("phrase")).join(known.select("key").distinct(), "key", "left_anti")
        found = resolve(asked.select(F.col("key").alias("request"), "phrase")).withColumnRenamed("request", "key")
        found.select("key", F.col("id").cast("long"), "tier", F.col("score").cast("long"), F.col("rank").cast("int")).write.mode("overwrite").parquet(f"{cache}/batch={number}")
        new = spark.read.schema(RESOLVED).parquet(f"{cache}/batch={number}")
        both = known.withColumn("reused", F.lit(True)).unionByName(new.withColumn("reused", F.lit(False)))
        rows.select("request", "key").join(both, "key").drop("key").write.mode("overwrite").parquet(f"{out}/batch={number}")
        rows.unpersist()

    requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Postings:
    """An inverted index kept by a stream of changes (id, text, ts, event_id; a null text deletes), one part a batch.

    A batch writes what changed only: the changed rows (id, length, alive), their new postings by bucket of
    id, and the differences of document frequencies and totals. A row's postings are those of its last
    part. The old postings of changed rows are read from their buckets alone. Batch n reads the parts before n.
    """

    BUCKETS = 64
    ROWS, TERMS, FREQUENCIES = "id long, length long, alive boolean, bucket int", "term string, id long, tf long, bucket int", "term string, df long"

    def __init__(self, folder: str):
        self.rows, self.terms, self.frequencies = (f"{folder}/{x}" for x in ("rows", "terms", "frequencies"))

    def _last(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("id").agg(F.max_by(F.struct("batch", "length", "alive", "bucket"), "batch").alias("x")).select("id", "x.*")

    def apply(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("id").agg(F.max_by(F.struct("text"), F.struct("ts", "event_id")).alias("x")).select("id", "x.text")
        words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.BUCKETS)).cast("int")
        changed = last.select("id", words.alias("w"), F.col("text").isNotNull().alias("alive"), bucket.alias("bucket")).persist()
        touched = [r[0] for r in changed.select("bucket").distinct().collect()]  # at most BUCKETS
        past = self._last(_before(spark, self.rows, self.ROWS, number).filter(F.col("bucket").isin(touched)))
        past = past.filter("alive").join(changed.select("id"), "id", "left_semi").select("id", "batch", "bucket")
        before = _before(spark, self.terms, self.TERMS, number).filter(F.col("bucket").isin(touched)).join(past, ["id", "batch", "bucket"])
        new = changed.filter("alive").select("id", "bucket", F.explode("w").alias("term")).groupBy("term", "id", "bucket").agg(F.count("*").alias("tf"))
        moves = new.select("term", F.lit(1).alias("n")).unionByName(before.select("term", F.lit(-1).alias("n")))
        moves = moves.groupBy("term").agg(F.sum("n").alias("df")).filter("df <> 0")
        moves.write.mode("overwrite").parquet(f"{self.frequencies}/batch={number}")
        new.select("term", "id", "tf", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.terms}/batch={number}")
        changed.select("id", F.size("w").cast("long").alias("length"), "alive", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.rows}/batch={number}")
        changed.unpersist()

    def follow(self, changes: DataFrame, checkpoint: str) -> None:
        changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def current(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(postings: term, id, tf; frequencies: term, df; totals: docs, length)."""
        every = 1 << 30
        live = self._last(_before(spark, self.rows, self.ROWS, every)).filter("alive")
        terms = _before(spark, self.terms, self.TERMS, every).join(live.select("id", "batch"), ["id", "batch"]).select("term", "id", "tf")
        df = _before(spark, self.frequencies, self.FREQUENCIES, every).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        return terms, df, live.agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
