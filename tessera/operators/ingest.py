"""Sheets as cells (sheet, r, c, v): headers, column mapping, rows, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import sheets as S
from tessera.scratch import materialize


#: Fixed value: rows of a sheet that are looked at for its header.
SCAN = 25


def header_rows(cells: DataFrame, aliases: DataFrame, scan: int = SCAN) -> DataFrame:
    """Header row of each sheet: among the first rows the one that names most fields, product among them."""
    named = cells.filter(F.col("r") <= scan).join(aliases, X.norm_header(F.col("v")) == F.col("label"))
    score = named.groupBy("sheet", "r").agg(F.countDistinct("field").alias("fields"), F.max((F.col("field") == "product").cast("int")).alias("has_product"))
    best = Window.partitionBy("sheet").orderBy(F.desc("fields"), "r")
    return score.filter("has_product = 1").withColumn("k", F.row_number().over(best)).filter("k = 1").select("sheet", "r", "fields")


def column_map(cells: DataFrame, aliases: DataFrame) -> DataFrame:
    """(sheet, field, c): the column of each field, by alias priority and then place."""
    head = cells.filter(F.col("r") <= SCAN).join(header_rows(cells, aliases).select("sheet", "r"), ["sheet", "r"]).join(aliases, X.norm_header(F.col("v")) == F.col("label"))
    best = Window.partitionBy("sheet", "field").orderBy("priority", "c")
    return head.withColumn("k", F.row_number().over(best)).filter("k = 1").select("sheet", "field", "c")


def sheet_rows(cells: DataFrame, aliases: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Data rows with fields as columns: totals and section labels go, blank and OPTION products inherit the last one.

    ``lines`` may give the cells as rows (sheet, r, cells: array<struct<c, v>>), which are less to shuffle.
    """
    heads = materialize(header_rows(cells, aliases).select("sheet", "r"), "ingest-header-rows")
    columns = materialize(column_map(cells, aliases), "ingest-columns")
    if lines is None:
        lines = cells.select("sheet", "r", F.array(F.struct("c", "v")).alias("cells"))
    rows = S.line_fields(lines, columns, heads, ["product", "model", "qty", "price", "gst"])
    label = F.coalesce(F.trim("product"), F.lit(""))
    rows = rows.filter(~F.lower(label).rlike("^(grand |sub)?total|^summary") & ~label.rlike(":-?$"))
    named = F.when((label != "") & (F.upper(label) != "OPTION"), label)
    before = Window.partitionBy("sheet").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("product", F.last(named, ignorenulls=True).over(before))
    qty = F.expr("try_cast(qty AS double)")
    return rows.select(
        "sheet", "r", "product", "model", F.when(F.coalesce(qty, F.lit(0.0)) == 0, 1.0).otherwise(qty).alias("qty"),
        F.coalesce(F.expr("try_cast(price AS double)"), F.lit(0.0)).alias("price"), X.gst_percent(F.expr("try_cast(gst AS double)")).alias("gst"),
    )


def file_kind(cells: DataFrame) -> DataFrame:
    """Structural class of each sheet by its labels: catalogue, requirement or other; with the winning share."""
    v = X.norm_header(F.col("v"))
    points = cells.groupBy("sheet").agg(
        F.sum(v.isin("HSN CODE", "BRAND", "UNIT PRICE", "PRICE").cast("int")).alias("catalogue"),
        F.sum(v.isin("QTY", "SL. NO.", "MODEL NO").cast("int")).alias("requirement"),
    )
    total = F.col("catalogue") + F.col("requirement")
    kind = F.when(total == 0, "other").when(F.col("catalogue") >= F.col("requirement"), "catalogue").otherwise("requirement")
    return points.select("sheet", kind.alias("kind"), F.when(total > 0, F.round(F.greatest("catalogue", "requirement") / total, 4)).otherwise(0.0).alias("confidence"))


def assign_spans(anchors: DataFrame, rows: DataFrame, place: str = "r") -> DataFrame:
    """Each anchor goes to the row whose span [its place, the next row's place) holds it: one sorted pass, no range join."""
    both = rows.select("sheet", F.col(place).alias("p"), F.col(place).alias("row_at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("anchor"))
    both = both.unionByName(anchors.select("sheet", F.col(place).alias("p"), F.lit(None).cast("long").alias("row_at"), F.lit(1).alias("kind"), F.col("anchor").cast("long").alias("anchor")))
    upto = Window.partitionBy("sheet").orderBy("p", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("row_at", F.last("row_at", ignorenulls=True).over(upto)).filter("kind = 1 and row_at is not null").select("sheet", "anchor", F.col("row_at").cast("long").alias("row_at"))


# Headings that tell kinds of workbooks apart, headings that only a quotation repeats, sheets that are looked at.
QUANTITIES, AMOUNTS = ["QTY", "QUANTITY"], ["AMOUNT", "TOTAL VALUE", "LINE TOTAL", "TOTAL AMOUNT"]
PIECE_PRICES, REPEATED = ["PRICE/PC", "PRICE / PC", "RATE/PC", "UNIT PRICE", "PRICE PER PC"], ["BRAND", "MODEL NO", "SPECIFICATION", "IMAGE", "PRODUCT"]
SHEETS_SEEN = 4


def workbook_types(sheets: DataFrame, heads: DataFrame) -> DataFrame:
    """(workbook, kind, confidence, price_list, client_boq, quotation): what a workbook is, by the headings of its first sheets.

    sheets: workbook, sheet, place; heads: sheet, c, label (normalised) of the sheets with a product column. Whole headings count,
    not parts of them; a workbook without a header or a point is unknown. Ties go to the first kind.
    """
    place = Window.partitionBy("workbook").orderBy("place", "sheet")
    known = sheets.withColumn("k", F.row_number().over(place)).withColumn("n", F.count("*").over(Window.partitionBy("workbook")))
    label = F.col("label")
    per = heads.groupBy("sheet", "label").agg(F.count("*").alias("times"))
    has = lambda *names: F.coalesce(F.max(label.isin(*names).cast("int")), F.lit(0)) == 1
    rows = known.filter(F.col("k") <= SHEETS_SEEN).join(per, "sheet", "left")
    seen = rows.groupBy("workbook").agg(
        F.max("n").alias("sheets"), F.count("label").alias("labels"), F.coalesce(F.sum(F.when(label.isin(REPEATED), F.col("times") - 1)), F.lit(0)).alias("dupes"),
        (has(*QUANTITIES) | (F.coalesce(F.max(label.rlike("(^| )(REQUIREMENT|REQD)$").cast("int")), F.lit(0)) == 1)).alias("qty"), has(*AMOUNTS).alias("amount"), has(*PIECE_PRICES).alias("piece"),
        (F.coalesce(F.max((F.contains(label, F.lit("PRICE")) | label.isin("RATE", "MRP")).cast("int")), F.lit(0)) == 1).alias("price"), has("COST").alias("cost"), has("STOCK").alias("stock"),
    )
    points = lambda *terms: sum((F.when(c, n).otherwise(0) for c, n in terms[1:]), F.when(terms[0][0], terms[0][1]).otherwise(0))
    c = F.col
    seen = seen.withColumns({
        "price_list": points((c("cost"), 2), (c("stock"), 1), (c("price") & ~c("qty"), 2), (c("sheets") == 1, 1)),
        "client_boq": points((c("qty") & ~c("cost") & ~c("amount"), 3), (c("qty") & ~c("price"), 2)),
        "quotation": points((c("dupes") > 0, 3), (c("amount") & c("qty"), 3), (c("piece"), 1)),
    })
    most, total = F.greatest("price_list", "client_boq", "quotation"), c("price_list") + c("client_boq") + c("quotation")
    kind = F.when((c("labels") == 0) | (most == 0), "unknown").when(c("price_list") == most, "price_list").when(c("client_boq") == most, "client_boq").otherwise("quotation")
    confidence = F.when((c("labels") == 0) | (most == 0), 0.0).otherwise(F.bround(most / total, 2))
    return seen.select("workbook", kind.alias("kind"), confidence.alias("confidence"), "price_list", "client_boq", "quotation")
