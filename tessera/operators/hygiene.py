"""Catalogue hygiene: junk, duplicates, overlaps, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def junk(df: DataFrame, name: str) -> DataFrame:
    return df.filter((F.length(F.trim(name)) < 6) | ~F.col(name).rlike("[A-Za-z]{3}"))


def clean_names(df: DataFrame, name: str) -> DataFrame:
    """Names with white space collapsed; ``dirty`` where that changed something."""
    clean = F.trim(F.regexp_replace(name, r"\s+", " "))
    return df.withColumn("clean", clean).withColumn("dirty", F.col(name) != clean)


def duplicate_names(products: DataFrame) -> DataFrame:
    return products.groupBy(F.lower(F.trim("product")).alias("name")).agg(F.count("*").alias("n"), F.countDistinct("file_name").alias("files")).filter("n > 1")


def overlapping_files(products: DataFrame, least: int = 5, most_files: int = 8) -> DataFrame:
    """Pairs of files with ``least`` models or more in common, among models found in 2 to ``most_files`` files."""
    own = products.select(F.lower("model").alias("model"), "file_name").distinct()
    sets = own.groupBy("model").agg(F.sort_array(F.collect_set("file_name")).alias("f")).filter((F.size("f") >= 2) & (F.size("f") <= most_files))
    pairs = sets.select(F.posexplode("f").alias("i", "a"), "f").select("a", F.explode(F.slice(F.col("f"), F.col("i") + 2, F.size("f"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def completeness(products: DataFrame) -> DataFrame:
    """Counts of filled fields by file, in one pass."""
    filled = [F.count_if(F.trim(F.col(c)) != "").alias(f"with_{c}") for c in ("model", "brand", "category")]
    return products.groupBy("file_name").agg(
        F.count("*").alias("n"), F.count_if(F.col("price") > 0).alias("with_price"), F.count("cost").alias("with_cost"), F.count("gst").alias("with_gst"), *filled
    )


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]{3,}"), F.lit(0)))
    return df.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
