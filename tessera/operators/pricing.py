"""Quotation money: totals, margins, tiers, refresh, brand and section summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import money as M


def priced_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with their catalogue row (left: unknown parts stay), amount and tax; a missing rate is 18, zero stays zero."""
    p = products.select(F.col("id").alias("part"), "product", "brand", "cost", "gst", F.col("price").alias("list_price"), F.lit(True).alias("known"))
    rows = lines.join(p, "part", "left").withColumn("amount", M.line_amount(F.col("qty"), F.col("price")))
    return rows.withColumn("tax", M.percent_of(F.col("amount"), F.coalesce("gst", F.lit(18))))


def quote_totals(rows: DataFrame) -> DataFrame:
    total, tax = F.sum("amount"), F.sum("tax")
    return rows.groupBy("quote").agg(F.count("*").alias("n"), total.alias("total"), tax.alias("tax"), (total + tax).alias("grand"))


def margin_summary(rows: DataFrame) -> DataFrame:
    """Per quote: lines by state, revenue, and profit over lines of known cost only."""
    state = M.margin_state(F.col("price"), F.col("cost"), F.coalesce("known", F.lit(False)))
    ok = state == "ok"
    cost = M.line_amount(F.col("qty"), F.col("cost"))
    return rows.groupBy("quote").agg(
        F.count_if(ok).alias("n_ok"), F.count_if(state == "no_cost").alias("n_no_cost"), F.count_if(state == "not_in_master").alias("n_unknown"),
        F.sum("amount").alias("revenue"), F.sum(F.when(ok, F.col("amount"))).alias("known_revenue"), F.sum(F.when(ok, F.col("amount") - cost)).alias("profit"),
    )


def brand_summary(rows: DataFrame, discounts: dict[str, int]) -> DataFrame:
    """Per brand: amount, discount by the brand's percent, tax on what is left, total."""
    table = F.create_map(*[x for k, v in discounts.items() for x in (F.lit(k), F.lit(v))])
    per = rows.groupBy("brand").agg(F.sum("amount").alias("amount"), F.sum("tax").alias("tax"))
    percent = F.coalesce(F.element_at(table, F.col("brand")), F.lit(0))
    per = per.withColumn("discount", M.percent_of(F.col("amount"), percent)).withColumn("net_tax", F.col("tax") - M.percent_of(F.col("tax"), percent))
    return per.select("brand", "amount", "discount", "net_tax", (F.col("amount") - F.col("discount") + F.col("net_tax")).alias("total"))


def section_rollup(rows: DataFrame) -> DataFrame:
    """Totals of each section and of all (section null)."""
    return rows.rollup("section").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.sum("tax").alias("tax"))


def bulk_tier(products: DataFrame, percent: int) -> DataFrame:
    """Tier price from the snapshot base: repeated runs do not compound; unpriced rows are skipped."""
    base = F.coalesce("snapshot", "price")
    return products.withColumn("snapshot", base).withColumn("price", M.tier_price(base, F.lit(percent)))


def reset_tier(products: DataFrame) -> DataFrame:
    """Prices back from the snapshot, which is cleared."""
    return products.withColumn("price", F.coalesce("snapshot", "price")).withColumn("snapshot", F.lit(None).cast("decimal(18,2)"))


def refresh_prices(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines (with previous, null at first) with the live price of their product; the first previous price is kept."""
    live = products.select(F.col("id").alias("part"), F.col("price").alias("live"))
    rows = lines.join(live, "part", "left")
    changed = F.col("live").isNotNull() & (F.col("live") != F.col("price"))
    new = {"changed": changed, "previous": F.coalesce("previous", F.when(changed, F.col("price"))), "price": F.coalesce("live", "price")}
    return rows.withColumns(new).drop("live")


def co_purchase(lines: DataFrame, k: int = 6, most_lines: int = 60) -> DataFrame:
    """Per part the k parts found most often in the same baskets (baskets of at most ``most_lines`` lines)."""
    basket = lines.select("quote", "part").distinct()
    small = lines.groupBy("quote").agg(F.count("*").alias("n")).filter(F.col("n") <= most_lines).select("quote")
    basket = basket.join(small, "quote", "left_semi")
    pairs = basket.join(basket.withColumnRenamed("part", "other"), "quote").filter("part <> other").groupBy("part", "other").agg(F.count("*").alias("together"))
    order = Window.partitionBy("part").orderBy(F.desc("together"), "other")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
