"""Adapters: the star schema read as catalogue, quotation lines, evidence log and sheet cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, product, model, brand, spec, size, price, cost (null at times), gst (null at times), file_name, category."""
    k = F.col("p_partkey")
    price = F.col("p_retailprice").cast(MONEY)
    gst = F.when(k % 5 == 0, 0).when(k % 5 == 1, 5).when(k % 5 == 2, 12).when(k % 5 == 3, 18)
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_name").alias("product"), F.concat(F.lit("C"), (k % 900).cast("string")).alias("model"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("spec"), F.col("p_size").alias("size"), price.alias("price"),
        F.when(k % 13 != 0, (price * F.lit("0.60").cast("decimal(4,2)")).cast(MONEY)).alias("cost"), gst.alias("gst"),
        F.concat(F.lit("file"), (k % 7).cast("string")).alias("file_name"), F.when(k % 11 == 0, " ").otherwise(F.col("p_type")).alias("category"),
    )


CATALOGUE_SQL = """cat AS (
  SELECT p_partkey AS id, p_name AS product, 'C' || (p_partkey % 900) AS model, p_brand AS brand, p_type AS spec, p_size AS size,
    CAST(p_retailprice AS DECIMAL(18,2)) AS price,
    CASE WHEN p_partkey % 13 <> 0 THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.60 AS DECIMAL(4,2)) AS DECIMAL(18,2)) END AS cost,
    CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 12 WHEN 3 THEN 18 END AS gst,
    'file' || (p_partkey % 7) AS file_name, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_type END AS category
  FROM part)"""


def quote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quote, part, pos, qty, price (sold unit price), section."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("quote"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("supplier"),
        F.col("l_quantity").cast("decimal(10,2)").alias("qty"), (F.col("l_extendedprice").cast(MONEY)).alias("price"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("section"),
    )


LINES_SQL = """lines AS (
  SELECT l_orderkey AS quote, l_partkey AS part, l_linenumber AS pos, l_suppkey AS supplier, CAST(l_quantity AS DECIMAL(10,2)) AS qty,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS price, l_returnflag || l_linestatus AS section
  FROM lineitem)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only log: event_id, ts, user_id, phrase, product, kind, value."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", "user_id", F.concat(F.lit("phrase "), (F.col("event_id") % 40).cast("string")).alias("phrase"),
        F.concat(F.lit("product "), (F.col("user_id") % 9).cast("string")).alias("product"), F.col("event_type").alias("kind"), "value",
    )


EVIDENCE_SQL = """ev AS (
  SELECT event_id, ts, user_id, 'phrase ' || (event_id % 40) AS phrase, 'product ' || (user_id % 9) AS product, event_type AS kind, value
  FROM events)"""

#: A small workbook as cells; the same text runs in any SQL engine.
CELLS_SQL = """SELECT * FROM (VALUES
  ('S1',1,1,'Offer for kitchen'),('S1',2,1,'To'),('S1',3,1,'Hotel Example'),('S1',4,1,'Date'),
  ('S1',6,1,'Sl. No.'),('S1',6,2,'Product Name'),('S1',6,3,'Model No'),('S1',6,4,'Qty'),('S1',6,5,'Unit Price'),('S1',6,6,'GST %'),
  ('S1',7,1,'1'),('S1',7,2,'Round Tray'),('S1',7,3,'A100'),('S1',7,4,'4'),('S1',7,5,'318.00'),('S1',7,6,'0.18'),
  ('S1',8,1,'2'),('S1',8,2,'OPTION'),('S1',8,3,'A101'),('S1',8,4,'0'),('S1',8,5,'90'),('S1',8,6,'12'),
  ('S1',9,2,'Cold items:'),
  ('S1',10,1,'3'),('S1',10,2,'Ice Box'),('S1',10,3,'B200'),('S1',10,4,'x'),('S1',10,5,'n/a'),('S1',10,6,'0'),
  ('S1',11,1,'4'),('S1',11,3,'B201'),('S1',11,4,'2'),('S1',11,5,'11000'),('S1',11,6,'5'),
  ('S1',12,2,'Grand Total'),('S1',12,5,'12000'),
  ('S2',1,1,'notes'),('S2',3,1,'DESCRIPTION'),('S2',3,2,'BRAND'),('S2',3,3,'HSN CODE'),
  ('S2',4,1,'Table Fork'),('S2',4,2,'CORE'),('S2',4,3,'8215')
) AS t(sheet, r, c, v)"""

#: Header label (normalised) -> field, priority.
ALIASES_SQL = """SELECT * FROM (VALUES
  ('PRODUCT NAME','product',1),('DESCRIPTION','product',2),('MODEL NO','model',1),('QTY','qty',1),('UNIT PRICE','price',1),
  ('PRICE','price',2),('GST %','gst',1),('BRAND','brand',1),('HSN CODE','hsn',1),('SL. NO.','serial',1)
) AS t(label, field, priority)"""

#: Labels of the sheets' headers by kind of sheet; kind 3 has none that is known.
LABELS_SQL = """SELECT * FROM (VALUES
  (0,1,'Product Name'),(0,2,'Model No'),(0,3,'Qty'),(0,4,'Unit Price'),(0,5,'GST %'),
  (1,1,'DESCRIPTION'),(1,2,'Item Code'),(1,3,'Quantity'),(1,4,'Rate'),(1,5,'Tax'),
  (2,1,'Item'),(2,2,'Model'),(2,3,'Qty'),(2,4,'Price USD'),(2,5,'GST'),
  (3,1,'Remarks'),(3,2,'Ref'),(3,3,'Nos'),(3,4,'Value'),(3,5,'Slab')
) AS t(kind, c, label)"""

#: Headers that were taught.
LEARNED_SQL = "SELECT * FROM (VALUES ('TAX','gst'),('RATE','price'),('ITEM','product')) AS t(label, field)"


def sheet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sheet_cells`` as lines (sheet, r, cells: array<struct<c, v>>); a row's cells may stand in several lines."""
    s = table(spark, sf_dir, "supplier").withColumn("sheet", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")))
    one = lambda c, v: F.struct(F.lit(c).alias("c"), v.alias("v"))
    line = lambda r, v: F.struct(F.lit(r).cast("long").alias("r"), F.array(one(1, v)).alias("cells"))
    titles = [line(1, F.lit("Offer for kitchen")), line(2, F.lit("To")), line(3, F.col("s_name")), line(4, F.lit("Date")), line(10**12, F.lit("Grand Total"))]
    top = s.select("sheet", F.inline(F.array(*titles)))
    head = s.join(F.broadcast(spark.sql(LABELS_SQL)), F.col("s_suppkey") % 4 == F.col("kind"))
    head = head.select("sheet", F.lit(5).cast("long").alias("r"), F.array(F.struct("c", F.col("label").alias("v"))).alias("cells"))
    k = F.col("l_partkey")
    price = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_extendedprice").cast(MONEY).cast("string"))
    values = [
        F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit("part "), k.cast("string"))), F.concat(F.lit("C"), (k % 900).cast("string")),
        F.col("l_quantity").cast("int").cast("string"), price, F.col("l_tax").cast("decimal(4,2)").cast("string"),
    ]
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber") + 6
    cells = F.array(*[one(i, v) for i, v in enumerate(values, 1)])
    body = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("sheet"), at.alias("r"), cells.alias("cells"))
    return top.unionByName(head).unionByName(body)


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each supplier (sheet, r, c, v): titles, header in row 5, its lines as rows, and a footer."""
    return sheet_lines(spark, sf_dir).select("sheet", "r", F.inline("cells"))


SHEETS_SQL = f"""labels_ AS ({LABELS_SQL}), cells AS (
  SELECT 'S' || s_suppkey AS sheet, CAST(t.r AS BIGINT) AS r, 1 AS c, coalesce(t.v, s_name) AS v
  FROM supplier, (VALUES (1, 'Offer for kitchen'), (2, 'To'), (3, NULL), (4, 'Date'), (1000000000000, 'Grand Total')) AS t(r, v)
  UNION ALL SELECT 'S' || s_suppkey, 5, c, label FROM supplier JOIN labels_ ON s_suppkey % 4 = kind
  UNION ALL SELECT 'S' || l_suppkey, l_orderkey * 10 + l_linenumber + 6, t.c,
    CASE t.c WHEN 1 THEN CASE WHEN l_partkey % 17 = 0 THEN ' ' ELSE 'part ' || l_partkey END WHEN 2 THEN 'C' || (l_partkey % 900)
      WHEN 3 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) WHEN 4 THEN CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END
      ELSE CAST(CAST(l_tax AS DECIMAL(4,2)) AS VARCHAR) END
  FROM lineitem, (VALUES (1), (2), (3), (4), (5)) AS t(c))"""
