"""Named queries over whole sheets, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ingest
from tessera.operators import sheets as S
from tessera.plans.registry import doubles, query
from tessera.scratch import materialize
from tessera.sources.catalogue import ALIASES_SQL, LEARNED_SQL, SHEETS_SQL, sheet_cells, sheet_lines, table

HEADS_SQL = f"""{SHEETS_SQL}, named AS (
  SELECT sheet, r FROM cells GROUP BY sheet, r
  HAVING bool_or(regexp_matches(upper(trim(v)), '{S.NAME_LABELS}') OR upper(trim(v)) = 'ITEM') AND bool_or(regexp_matches(upper(trim(v)), '{S.FIELD_LABELS}'))
), header AS (SELECT sheet, min(r) AS r FROM named GROUP BY sheet), heads AS (
  SELECT sheet, r, c, upper(trim(v)) AS label FROM cells JOIN header USING (sheet, r))"""
NAMES = ", ".join(f"('{f}', {i}, '{n}', '{'|'.join(S.EXCLUDED.get(f, []))}')" for f, all_ in S.COLUMN_NAMES.items() for i, n in enumerate(all_))
COLUMNS_SQL = f"""{HEADS_SQL}, names AS (SELECT * FROM (VALUES {NAMES}) AS t(field, i, name, no)), columns_ AS (
  SELECT sheet, field, arg_min(c, i * 1000 + c) AS c FROM heads JOIN names ON contains(label, name) AND (no = '' OR NOT regexp_matches(label, no)) GROUP BY sheet, field)"""
PARSED_SQL = f"""{COLUMNS_SQL}, fields AS (
  SELECT c.sheet, c.r, {", ".join(f"max(CASE WHEN field = '{f}' THEN trim(v) END) AS {f}" for f in ("product", "model", "qty", "price", "gst"))}
  FROM cells c JOIN header h ON c.sheet = h.sheet AND c.r > h.r JOIN columns_ k ON k.sheet = c.sheet AND k.c = c.c GROUP BY c.sheet, c.r
), parsed AS (
  SELECT sheet, r, product, model, TRY_CAST(qty AS INT) AS qty, nullif(TRY_CAST(price AS DECIMAL(18,2)), 0) AS price,
    round(CASE WHEN TRY_CAST(gst AS DOUBLE) > 0 AND TRY_CAST(gst AS DOUBLE) <= 1 THEN TRY_CAST(gst AS DOUBLE) * 100 ELSE TRY_CAST(gst AS DOUBLE) END, 6) AS gst
  FROM fields WHERE product <> '')"""
DESCRIBED_SQL = f"""{HEADS_SQL}, builtin AS (SELECT label, min(field) AS field FROM ({ALIASES_SQL}) GROUP BY label), learned AS ({LEARNED_SQL}), described AS (
  SELECT sheet, r, c, h.label, coalesce(l.field, b.field) AS field, CASE WHEN l.field IS NOT NULL THEN 'learned' WHEN b.field IS NOT NULL THEN 'builtin' ELSE 'none' END AS source
  FROM heads h LEFT JOIN learned l ON l.label = h.label LEFT JOIN builtin b ON b.label = h.label)"""
WORKBOOK = "CAST(regexp_extract(sheet, '([0-9]+)$', 1) AS BIGINT)"


def _described(spark, cells):
    aliases = spark.sql(ALIASES_SQL).groupBy("label").agg(F.min("field").alias("field"))
    return S.described(S.header_cells(cells), aliases, spark.sql(LEARNED_SQL))


def _parsed(lines, heads):
    return S.parsed_lines(lines, S.resolve_columns(heads), heads.select("sheet", "r").distinct())


@query(f"WITH {HEADS_SQL} SELECT sheet, r FROM header")
def header_rows(spark, sf):
    return S.header_rows(sheet_cells(spark, sf))


@query(f"WITH {COLUMNS_SQL} SELECT sheet, field, c FROM columns_")
def column_resolve(spark, sf):
    return S.resolve_columns(S.header_cells(sheet_cells(spark, sf)))


@query(f"WITH {DESCRIBED_SQL} SELECT sheet, c, label, field, source FROM described")
def learned_headers(spark, sf):
    return _described(spark, sheet_cells(spark, sf)).drop("r")


@query(f"""WITH {DESCRIBED_SQL} SELECT d.sheet, d.c, d.label, d.field, d.source, (SELECT arg_min(v, (r, v)) FROM cells x WHERE x.sheet = d.sheet AND x.c = d.c
  AND x.r > d.r AND x.r <= d.r + {S.SAMPLE_ROWS} AND trim(v) <> '') AS sample FROM described d""")
def column_report(spark, sf):
    cells = sheet_cells(spark, sf)
    return S.column_report(cells, _described(spark, cells))


@query(f"""WITH {DESCRIBED_SQL} SELECT DISTINCT d.sheet, f.field FROM described d, (VALUES ('product'), ('model'), ('qty'), ('price'), ('gst'), ('brand')) AS f(field)
  WHERE NOT EXISTS (SELECT 1 FROM described x WHERE x.sheet = d.sheet AND x.field = f.field)""")
def missing_fields(spark, sf):
    return S.missing_fields(_described(spark, sheet_cells(spark, sf)), ["product", "model", "qty", "price", "gst", "brand"])


@query()
def header_suggestions(spark, sf):
    heads = sheet_cells(spark, sf).filter("r = 5").select(S.label(F.col("v")).alias("label"))
    aliases = {r["label"]: r["field"] for r in spark.sql(ALIASES_SQL).orderBy("priority", "label").collect()}
    return S.suggest_fields(heads, aliases)


@query(f"""WITH {PARSED_SQL}, n AS (SELECT sheet, count(*) AS n, {WORKBOOK} AS place FROM columns_ GROUP BY sheet),
best AS (SELECT place % 3 AS workbook, arg_max(sheet, n * 1000000 - place) AS sheet FROM n GROUP BY ALL)
SELECT workbook, sheet, count(*) AS n_rows, count(price) AS priced, CAST(sum(price) AS DOUBLE) AS three_star, CAST(sum(price) AS DOUBLE) AS four_star, round(max(gst), 4) AS most_gst
FROM best JOIN parsed USING (sheet) GROUP BY workbook, sheet""")
def best_sheet(spark, sf):
    heads = S.header_cells(sheet_cells(spark, sf))
    best = S.best_sheets(S.resolve_columns(heads), F.regexp_extract("sheet", "([0-9]+)$", 1).cast("long") % 3)
    best = materialize(best, "best-sheets")
    # Only the lines of the best sheets are parsed.
    rows = _parsed(sheet_lines(spark, sf).join(best.select("sheet"), "sheet", "left_semi"), heads).join(best, "sheet")  # a single price fills both tiers
    out = rows.groupBy("workbook", "sheet").agg(F.count("*").alias("n_rows"), F.count("price").alias("priced"), F.sum("price").alias("three_star"), F.round(F.max("gst"), 4).alias("most_gst"))
    return doubles(out.withColumn("four_star", F.col("three_star")), "three_star", "four_star")


@query(f"WITH {PARSED_SQL} SELECT sheet AS category, r, product, CAST(price AS DOUBLE) AS price, row_number() OVER (PARTITION BY sheet ORDER BY r) AS serial FROM parsed WHERE price > 0")
def matched_rows(spark, sf):
    rows = _parsed(sheet_lines(spark, sf), S.header_cells(sheet_cells(spark, sf)))
    return doubles(S.renumbered(rows).select("category", "r", "product", "price", "serial"), "price")


@query(f"""WITH {HEADS_SQL}, m AS (SELECT sheet, min(r) FILTER (lower(trim(v)) = 'to') AS bill_to, min(r) FILTER (lower(trim(v)) LIKE 'date%') AS date,
  min(r) FILTER (lower(v) LIKE '%grand total%') AS footer FROM cells GROUP BY sheet)
SELECT m.sheet, m.bill_to, m.date, m.footer, h.r AS header, (SELECT max(r) FROM cells c WHERE c.sheet = m.sheet AND c.r > h.r AND c.r < m.footer) AS data_end
FROM m LEFT JOIN header h ON h.sheet = m.sheet""")
def template_rows(spark, sf):
    return S.template_rows(sheet_cells(spark, sf))


@query("SELECT 'S' || s_suppkey AS sheet, s_name AS bill_to FROM supplier")
def bill_to_text(spark, sf):
    return S.bill_to(sheet_cells(spark, sf), ["date", "subject", "dear"])


@query("SELECT doc_id, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', 0) AS email FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')")
def first_email(spark, sf):
    mail = F.regexp_extract("text", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", 0)
    return table(spark, sf, "documents").select("doc_id", mail.alias("email")).filter("email <> ''")


@query("SELECT sha256(text) AS digest, substr(sha256(text), 1, 2) AS shard, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def content_store(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).withColumn("shard", F.substring("digest", 1, 2))


#: Headings of sheets by kind; kind 7 has no product column.
_HEADINGS = """SELECT * FROM (VALUES (0,1,'Product'),(0,2,'Cost'),(0,3,'Price'),(0,4,'Stock'),(1,1,'Item'),(1,2,'Qty'),(2,1,'Description'),(2,2,'Qty'),(2,3,'Unit Price'),(2,4,'Amount'),
  (3,1,'Product'),(3,2,'Brand'),(3,3,'Model No'),(3,4,'Quantity'),(3,5,'Product'),(3,6,'Brand'),(3,7,'Line Total'),(4,1,'Product'),(4,2,'Total Requirement'),(4,3,'RECEIVE QTY AMOUNT'),(5,1,'Product'),(5,2,'Mrp'),
  (6,1,'Product'),(6,2,'Remarks'),(7,1,'Notes'),(7,2,'Qty')) AS t(kind, c, label)"""


@query(f"""WITH s AS (SELECT s_nationkey AS workbook, s_suppkey AS sheet, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
h AS (SELECT sheet, upper(label) AS label, count(*) AS times FROM s JOIN ({_HEADINGS}) ON kind = sheet % 8 WHERE kind <> 7 GROUP BY ALL),
f AS (SELECT workbook, max(n) AS sheets, count(label) AS labels, coalesce(sum(CASE WHEN label IN ('BRAND', 'MODEL NO', 'SPECIFICATION', 'IMAGE', 'PRODUCT') THEN times - 1 END), 0) AS dupes,
  coalesce(bool_or(label IN ('QTY', 'QUANTITY') OR regexp_matches(label, '(^| )(REQUIREMENT|REQD)$')), false) AS qty, coalesce(bool_or(label IN ('AMOUNT', 'TOTAL VALUE', 'LINE TOTAL', 'TOTAL AMOUNT')), false) AS amount,
  coalesce(bool_or(label IN ('PRICE/PC', 'PRICE / PC', 'RATE/PC', 'UNIT PRICE', 'PRICE PER PC')), false) AS piece, coalesce(bool_or(contains(label, 'PRICE') OR label IN ('RATE', 'MRP')), false) AS price,
  coalesce(bool_or(label = 'COST'), false) AS cost, coalesce(bool_or(label = 'STOCK'), false) AS stock FROM s LEFT JOIN h USING (sheet) WHERE k <= {ingest.SHEETS_SEEN} GROUP BY workbook),
p AS (SELECT workbook, labels, cost::int * 2 + stock::int + (price AND NOT qty)::int * 2 + (sheets = 1)::int AS price_list, (qty AND NOT cost AND NOT amount)::int * 3 + (qty AND NOT price)::int * 2 AS client_boq,
  (dupes > 0)::int * 3 + (amount AND qty)::int * 3 + piece::int AS quotation FROM f), m AS (SELECT *, greatest(price_list, client_boq, quotation) AS most FROM p)
SELECT workbook, CASE WHEN labels = 0 OR most = 0 THEN 'unknown' WHEN price_list = most THEN 'price_list' WHEN client_boq = most THEN 'client_boq' ELSE 'quotation' END AS kind,
  CASE WHEN labels = 0 OR most = 0 THEN 0.0 ELSE round_even(most / (price_list + client_boq + quotation), 2) END::double AS confidence, price_list, client_boq, quotation FROM m""")
def workbook_types(spark, sf):
    """What each workbook is (here: the suppliers of a nation as its sheets): price list, list of wants, or quotation."""
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("workbook"), F.col("s_suppkey").alias("sheet"), F.col("s_suppkey").alias("place"))
    kinds = F.broadcast(spark.sql(_HEADINGS))
    heads = s.join(kinds, F.col("sheet") % 8 == F.col("kind")).filter("kind <> 7").select("sheet", "c", F.upper("label").alias("label"))
    return ingest.workbook_types(s, heads)
