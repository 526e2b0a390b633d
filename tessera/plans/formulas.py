"""Recomputed workbooks: a sheet for each customer with its orders as lines, and an index sheet, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import formulas
from tessera.plans.registry import query
from tessera.sources.catalogue import table

#: Rows of the sums below the lines.
TOTAL, TAX, GRAND, LAST = 2_000_000_000, 2_000_000_001, 2_000_000_002, 1_999_999_999


def workbook(spark, sf):
    """Cells (sheet, r, c, v): quantity, price and =C*D of each order; below them a sum, its tax and both; an index of all sums."""
    cell = lambda c, v: F.struct(F.lit(c).alias("c"), v.cast("string").alias("v"))
    r = F.col("o_orderkey") + 6
    text = r.cast("string")
    price = F.when(F.col("o_orderkey") % 23 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    amount = F.concat(F.lit("=C"), text, F.lit(" * $D$"), text)
    lines = table(spark, sf, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("sheet"), r.alias("r"), F.inline(F.array(cell(3, F.col("o_orderkey") % 9 + 1), cell(4, price), cell(6, amount)))
    )
    own = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("sheet"))
    row = lambda r, v: F.struct(F.lit(r).cast("long").alias("r"), F.lit(6).alias("c"), F.lit(v).alias("v"))
    below = own.select("sheet", F.inline(F.array(row(TOTAL, f"=SUM(F1:F{LAST})"), row(TAX, f"=F{TOTAL}*18/100"), row(GRAND, f"=(F{TOTAL}+F{TAX})*1-0"))))
    index = own.select(F.lit("INDEX").alias("sheet"), (F.col("c_custkey") + 1).alias("r"), F.lit(2).alias("c"), F.concat(F.lit("='"), "sheet", F.lit(f"'!F{TOTAL}")).alias("v"))
    whole = spark.createDataFrame([("INDEX", LAST, 2, "=SUM(B1:B1999999998)"), ("INDEX", LAST, 3, f"=B{LAST}/0"), ("INDEX", LAST, 4, f"=B{LAST}*2")], "sheet string, r long, c int, v string")
    return lines.unionByName(below).unionByName(index).unionByName(whole)


@query(f"""WITH l AS (SELECT o_custkey AS k, o_orderkey + 6 AS r, CASE WHEN o_orderkey % 23 <> 0 THEN round((o_orderkey % 9 + 1) * o_totalprice::decimal(18,2), 2) END AS amount FROM orders),
t AS (SELECT c_custkey AS k, coalesce(sum(amount), 0)::decimal(30,2) AS total, count(l.k) AS n, count(l.k) - count(amount) AS open_ FROM customer LEFT JOIN l ON l.k = c_custkey GROUP BY c_custkey)
SELECT 'C' || k AS sheet, r::bigint AS r, 6 AS c, amount::double AS value, CASE WHEN amount IS NOT NULL THEN 1 END AS step FROM l
UNION ALL SELECT 'C' || k, {TOTAL}, 6, CASE WHEN open_ = 0 THEN total::double END, CASE WHEN open_ > 0 THEN NULL WHEN n > 0 THEN 2 ELSE 1 END FROM t""")
def recomputed_sums(spark, sf):
    """Amounts of the lines and sums of the sheets; a sum over a line without a price waits for it, and stays open."""
    rows = formulas.recomputed(workbook(spark, sf)).filter(f"sheet <> 'INDEX' and c = 6 and r <= {TOTAL}")
    return rows.select("sheet", "r", "c", F.col("value").cast("double").alias("value"), "step")
