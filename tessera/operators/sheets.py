"""Sheets as cells (sheet, r, c, v): header rows, column resolution, reports and row parsing."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import materialize

# Label words of a header row, ordered column names with exclusions, hints.
NAME_LABELS = "PRODUCT|ITEM NAME|ITEM CODE|MATERIAL DESCRI|DESCRIPTION"
FIELD_LABELS = "PRICE|QTY|QUANTITY|MODEL|AMOUNT|RATE|MRP"
COLUMN_NAMES = {
    "product": ["PRODUCT NAME", "PRODUCT", "ITEM NAME", "MATERIAL DESCRIPTION", "MATERIAL DESCRI", "DESCRIPTION", "ITEM"],
    "qty": ["TOTAL QTY", "QTY", "QUANTITY", "REQUIREMENT"],
    "model": ["MODEL NO", "MODEL", "ITEM CODE", "ITEM CODES"],
    "price": ["PRICE/PC INR", "PRICE INR", "PRICE/PC", "PRICE", "RATE", "UNIT PRICE", "AMOUNT"],
    "gst": ["GST%", "GST"],
}
EXCLUDED = {"price": ["USD", "DOLLAR"]}
HINTS = {
    "price": ["price", "rate", "amount", "value", "inr", "rs", "selling"], "cost": ["cost", "purchase", "buying", "landed"],
    "gst": ["gst", "tax", "vat", "slab"], "model": ["model", "sku", "art", "item code", "code", "part"],
    "product": ["product", "item", "description", "particular", "material"], "brand": ["brand", "make", "manufacturer"],
    "unit": ["unit", "uom", "nos", "pcs"],
}
CLOSE, HINTED, LEAST_CLOSE = 0.72, 0.6, 0.65
SAMPLE_ROWS = 8
BILL_LINES = 12


def label(v: Column) -> Column:
    return F.upper(F.trim(v))


def header_rows(cells: DataFrame) -> DataFrame:
    """(sheet, r): first row of a sheet that names a product and a field."""
    v = label(F.col("v"))
    # Cells that name nothing are left out before rows are grouped.
    rows = cells.select("sheet", "r", (v.rlike(NAME_LABELS) | (v == "ITEM")).alias("named"), v.rlike(FIELD_LABELS).alias("field")).filter("named or field")
    rows = rows.groupBy("sheet", "r").agg(F.bool_or("named").alias("named"), F.bool_or("field").alias("field"))
    return rows.filter("named and field").groupBy("sheet").agg(F.min("r").alias("r"))


def _within(cells: DataFrame, rows: DataFrame, first: int, last: int) -> DataFrame:
    """Cells from ``first`` rows below the topmost of ``rows`` to ``last`` below the lowest: the others can't meet them, and aren't shuffled."""
    ends = rows.agg((F.min("r") + first).alias("_lo"), (F.max("r") + last).alias("_hi"))
    return cells.join(F.broadcast(ends), (F.col("r") >= F.col("_lo")) & (F.col("r") <= F.col("_hi"))).drop("_lo", "_hi")


def header_cells(cells: DataFrame) -> DataFrame:
    """(sheet, r, c, label) of the header rows, written once: what is made of them is small beside the cells."""
    heads = materialize(header_rows(cells), "sheets-header-rows")
    return materialize(_within(cells, heads, 0, 0).join(heads, ["sheet", "r"]).select("sheet", "r", "c", label(F.col("v")).alias("label")), "sheets-headers")


def resolve_columns(heads: DataFrame) -> DataFrame:
    """(sheet, field, c): the first name of a field's list that a label contains, the leftmost such column."""
    names = [(f, i, n, "|".join(EXCLUDED.get(f, []))) for f, all_ in COLUMN_NAMES.items() for i, n in enumerate(all_)]
    names = heads.sparkSession.createDataFrame(names, "field string, i int, name string, no string")
    hit = F.col("label").contains(F.col("name")) & ((F.col("no") == "") | ~F.regexp_like("label", F.col("no")))
    return heads.join(F.broadcast(names), hit).groupBy("sheet", "field").agg(F.min_by("c", F.struct("i", "c")).alias("c"))


def described(heads: DataFrame, aliases: DataFrame, learned: DataFrame) -> DataFrame:
    """Header cells with field and source (learned before built in); both dims are (label, field)."""
    rows = heads.join(F.broadcast(learned.withColumnRenamed("field", "taught")), "label", "left").join(F.broadcast(aliases), "label", "left")
    source = F.when(F.col("taught").isNotNull(), "learned").when(F.col("field").isNotNull(), "builtin").otherwise("none")
    return rows.select("sheet", "r", "c", "label", F.coalesce("taught", "field").alias("field"), source.alias("source"))


def column_report(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """``described`` columns with the first sample that is not blank in the SAMPLE_ROWS rows below the header."""
    below = _within(cells, columns, 1, SAMPLE_ROWS).filter(F.trim("v") != "").join(columns.select("sheet", "c", F.col("r").alias("h")), ["sheet", "c"])
    below = below.filter((F.col("r") > F.col("h")) & (F.col("r") <= F.col("h") + SAMPLE_ROWS))
    sample = below.groupBy("sheet", "c").agg(F.min_by("v", F.struct("r", "v")).alias("sample"))
    return columns.join(sample, ["sheet", "c"], "left").select("sheet", "c", "label", "field", "source", "sample")


def missing_fields(columns: DataFrame, fields: list[str]) -> DataFrame:
    """(sheet, field) that no column of the sheet has."""
    every = columns.select("sheet").distinct().select("sheet", F.explode(F.lit(fields)).alias("field"))
    return every.join(columns.filter("field is not null"), ["sheet", "field"], "left_anti")


def suggest_fields(labels: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(label, field, score) for distinct labels: exact, close by matching blocks, hinted, or weakly close; else null and 0."""

    @F.pandas_udf("field string, score double")
    def suggest(column: pd.Series) -> pd.DataFrame:
        out = []
        for h in column.str.lower():
            ratio, name = max(((difflib.SequenceMatcher(None, h, a.lower()).ratio(), a) for a in aliases), key=lambda x: x[0])
            hits, hinted = max(((sum(w in h for w in words), f) for f, words in HINTS.items()), key=lambda x: x[0])
            if ratio >= CLOSE or not hits:
                out.append((aliases[name], round(ratio, 2)) if ratio >= LEAST_CLOSE else (None, 0.0))
            else:
                out.append((hinted, HINTED))
        return pd.DataFrame(out, columns=["field", "score"])

    return labels.select("label").distinct().withColumn("s", suggest("label")).select("label", "s.field", "s.score")


def parsed_rows(cells: DataFrame, columns: DataFrame, heads: DataFrame) -> DataFrame:
    """(sheet, r, product, model, qty, price, gst) of rows below the header; blank products leave, a zero price is none, tax is scaled."""
    return parsed_lines(cells.select("sheet", "r", F.array(F.struct("c", "v")).alias("cells")), columns, heads)


def line_fields(lines: DataFrame, columns: DataFrame, heads: DataFrame, fields: list[str], value=lambda v: v) -> DataFrame:
    """(sheet, r, *fields) of the lines (sheet, r, cells) below their sheet's header: the largest value of each field's columns.

    Lines meet one row of their sheet, so they are shuffled once, by sheet; rows that stand in several lines come together there.
    """
    of = columns.groupBy("sheet").agg(F.collect_set("c").alias("_all"), *[F.collect_set(F.when(F.col("field") == f, F.col("c"))).alias(f"_{f}") for f in fields])
    of = heads.select("sheet", F.col("r").alias("_h")).join(of, "sheet")
    found = lambda f: F.array_max(F.transform(F.filter("cells", lambda x: F.array_contains(F.col(f"_{f}"), x["c"])), lambda x: value(x["v"])))
    rows = lines.join(of, "sheet").filter((F.col("r") > F.col("_h")) & F.arrays_overlap("cells.c", "_all")).select("sheet", "r", *[found(f).alias(f) for f in fields])
    return rows.groupBy("sheet", "r").agg(*[F.max(f).alias(f) for f in fields])


def parsed_lines(lines: DataFrame, columns: DataFrame, heads: DataFrame) -> DataFrame:
    """``parsed_rows`` of lines (sheet, r, cells: array<struct<c, v>>)."""
    fields = line_fields(lines, columns, heads, ["product", "model", "qty", "price", "gst"], F.trim)
    price = F.nullif(F.expr("try_cast(price as decimal(18,2))"), F.lit(0).cast("decimal(18,2)"))
    gst = F.expr("try_cast(gst as double)")
    return fields.filter("product <> ''").select(
        "sheet", "r", "product", "model", F.expr("try_cast(qty as int)").alias("qty"), price.alias("price"),
        F.round(F.when((gst > 0) & (gst <= 1), gst * 100).otherwise(gst), 6).alias("gst"),
    )


def best_sheets(columns: DataFrame, workbook: Column) -> DataFrame:
    """(workbook, sheet): the sheet that maps most fields, the earliest among equals."""
    n = columns.groupBy("sheet").agg(F.count("*").alias("n")).withColumn("workbook", workbook)
    place = F.regexp_extract("sheet", "([0-9]+)$", 1).cast("long")
    return n.groupBy("workbook").agg(F.max_by("sheet", F.struct("n", -place)).alias("sheet"))


def template_rows(cells: DataFrame) -> DataFrame:
    """Landmarks of each sheet: bill-to, date, header, last data and first footer row."""
    v = F.lower(F.trim("v"))
    marks = cells.groupBy("sheet").agg(
        F.min(F.when(v == "to", F.col("r"))).alias("bill_to"), F.min(F.when(v.startswith("date"), F.col("r"))).alias("date"),
        F.min(F.when(v.contains("grand total"), F.col("r"))).alias("footer"),
    )
    marks = marks.join(header_rows(cells).withColumnRenamed("r", "header"), "sheet", "left")
    data = cells.join(marks.select("sheet", "header", "footer"), "sheet").filter("r > header and r < coalesce(footer, r + 1)")
    return marks.join(data.groupBy("sheet").agg(F.max("r").alias("data_end")), "sheet", "left")


def bill_to(cells: DataFrame, stops: list[str]) -> DataFrame:
    """(sheet, bill_to): lines below the label 'To', up to a stop word, at most BILL_LINES."""
    first = cells.filter("c = 1").select("sheet", "r", "v", F.lower(F.trim("v")).alias("w"))
    start = first.filter("w = 'to'").groupBy("sheet").agg(F.min("r").alias("s"))
    rows = first.join(start, "sheet").filter(F.col("r").between(F.col("s") + 1, F.col("s") + BILL_LINES))
    end = rows.filter(F.col("w").isin(stops)).groupBy("sheet").agg(F.min("r").alias("e"))
    rows = rows.join(end, "sheet", "left").filter("r < coalesce(e, r + 1)")
    return rows.groupBy("sheet").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]), "\n").alias("bill_to"))


def renumbered(rows: DataFrame) -> DataFrame:
    """Priced rows with the sheet as category and a serial number in order."""
    order = Window.partitionBy("sheet").orderBy("r")
    return rows.filter("price > 0").withColumn("serial", F.row_number().over(order)).withColumn("category", F.col("sheet"))
