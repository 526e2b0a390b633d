"""Numbers of rows within groups of any size: ranges are numbered apart, and what earlier ranges hold is added."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import materialize


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with their number (from 1) within ``keys``, in the order of ``order`` (which must tell rows apart).

    Rows are dealt by ranges of keys and order, so a group that holds most rows is numbered by many tasks.
    """
    ranged = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "numbered")
    local = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    sizes = ranged.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_of")).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))  # a row a group and range
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return ranged.withColumn("_local", local).join(sizes, same).withColumn(name, F.col("_before") + F.col("_local")).select(*rows.columns, name)
