"""Named queries and, for each that SQL can express, the SQL.

Every query reads tables, whole but where a part of them is what it asks about. Money leaves as double, so that engines with other
decimal widths compare equal.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import money as M
from tessera.functions import text as X
from tessera.operators import history, hygiene, ingest, match, pricing, vectors
from tessera.operators.numbering import numbered
from tessera.sources.catalogue import ALIASES_SQL, CATALOGUE_SQL, EVIDENCE_SQL, LINES_SQL, SHEETS_SQL, catalogue, evidence, quote_lines, sheet_cells, sheet_lines, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
UNITS = "('" + "','".join(X.UNIT_WORDS) + "')"
PRICED_SQL = f"""{CATALOGUE_SQL}, {LINES_SQL}, priced AS (
  SELECT l.*, c.id IS NOT NULL AS known, c.product, c.brand, c.cost, c.gst, CAST(round(l.qty * l.price, 2) AS DECIMAL(18,2)) AS amount,
    CAST(round(CAST(round(l.qty * l.price, 2) AS DECIMAL(18,2)) * CAST(coalesce(c.gst, 18) AS DECIMAL(9,2)) * CAST(0.01 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS tax
  FROM lines l LEFT JOIN cat c ON c.id = l.part)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def doubles(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


# ---------------------------------------------------------------- filters, projections, paging


@query(f"WITH {CATALOGUE_SQL} SELECT id, product, model, CAST(price AS DOUBLE) AS price FROM cat WHERE file_name = 'file3' AND (product ILIKE '%co%' OR model ILIKE '%co%' OR brand ILIKE '%co%') ORDER BY id LIMIT 50 OFFSET 10")
def paged_search(spark, sf):
    c = catalogue(spark, sf)
    hit = F.col("product").ilike("%co%") | F.col("model").ilike("%co%") | F.col("brand").ilike("%co%")
    return doubles(c.filter((F.col("file_name") == "file3") & hit).orderBy("id").offset(10).limit(50).select("id", "product", "model", "price"), "price")


@query(f"WITH {CATALOGUE_SQL} SELECT id, product, CAST(price AS DOUBLE) AS price FROM cat WHERE product ILIKE '%re%' AND price > 0 ORDER BY price, id LIMIT 20")
def typeahead(spark, sf):
    c = catalogue(spark, sf).filter(F.col("product").ilike("%re%") & (F.col("price") > 0))
    return doubles(c.select("id", "product", "price").orderBy("price", "id").limit(20), "price")


@query(f"WITH {CATALOGUE_SQL} SELECT coalesce(nullif(trim(category), ''), 'Uncategorised') AS category, file_name, count(*) AS n FROM cat GROUP BY ALL")
def category_counts(spark, sf):
    c = catalogue(spark, sf).withColumn("category", F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("Uncategorised")))
    return c.groupBy("category", "file_name").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE length(trim(text)) < 6 OR NOT regexp_matches(text, '[A-Za-z]{3}')")
def junk_predicate(spark, sf):
    return hygiene.junk(table(spark, sf, "documents"), "text").select("doc_id")


@query(r"SELECT doc_id, length(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS n, text <> trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS dirty FROM documents")
def dirty_names(spark, sf):
    return hygiene.clean_names(table(spark, sf, "documents"), "text").select("doc_id", F.length("clean").cast("long").alias("n"), "dirty")


@query(f"WITH {CATALOGUE_SQL} SELECT id, product, CAST(price AS DOUBLE) AS price FROM cat")
def mask_cost(spark, sf):
    return doubles(catalogue(spark, sf).select("id", "product", "price", "cost").drop("cost"), "price")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3 AND o_orderstatus = 'O'")
def own_quotes(spark, sf):
    return table(spark, sf, "orders").filter("o_custkey % 10 = 3 AND o_orderstatus = 'O'").select("o_orderkey")


@query(f"""WITH {CATALOGUE_SQL}, hit AS (SELECT brand, count(*) AS n, min(price) AS low FROM cat WHERE price BETWEEN 1000 AND 1200 GROUP BY brand),
near AS (SELECT brand, min(abs(price - 1100)) AS off FROM cat WHERE price > 0 GROUP BY brand)
SELECT near.brand, coalesce(n, 0) AS n, CAST(low AS DOUBLE) AS low, CAST(off AS DOUBLE) AS off FROM near LEFT JOIN hit USING (brand)""")
def price_range_filter(spark, sf):
    c = catalogue(spark, sf)
    hit = c.filter("price between 1000 and 1200").groupBy("brand").agg(F.count("*").alias("n"), F.min("price").alias("low"))
    near = c.filter("price > 0").groupBy("brand").agg(F.min(F.abs(F.col("price") - 1100)).alias("off"))
    return doubles(near.join(hit, "brand", "left").select("brand", F.coalesce("n", F.lit(0)).alias("n"), "low", "off"), "low", "off")


@query(f"WITH {LINES_SQL} SELECT section, count(*) AS n, min(quote) AS first_quote FROM lines WHERE section IN ('AF', 'NO', 'RF') GROUP BY section")
def section_counts(spark, sf):
    return quote_lines(spark, sf).filter(F.col("section").isin("AF", "NO", "RF")).groupBy("section").agg(F.count("*").alias("n"), F.min("quote").alias("first_quote"))


@query("SELECT e.event_id, e.event_type, c.c_name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'click' OR c.c_name LIKE '%7'")
def activity_filter(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    e = table(spark, sf, "events").join(c, "user_id", "left")
    return e.filter((F.col("event_type") == "click") | F.col("c_name").like("%7")).select("event_id", "event_type", "c_name")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_path(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long") % 7
    return table(spark, sf, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- catalogue changes


@query(f"""WITH {CATALOGUE_SQL} SELECT id, CAST(price AS DOUBLE) AS snapshot,
CAST(CASE WHEN price > 0 THEN round(price * CAST(0.88 AS DECIMAL(12,4)), 2) ELSE price END AS DOUBLE) AS price FROM cat""")
def bulk_tier_pricing(spark, sf):
    c = catalogue(spark, sf).withColumn("snapshot", F.lit(None).cast("decimal(18,2)"))
    twice = pricing.bulk_tier(pricing.bulk_tier(c, 40), 12)  # the second run starts from the snapshot again
    return doubles(twice.select("id", "snapshot", "price"), "snapshot", "price")


@query(f"""WITH {CATALOGUE_SQL} SELECT id, CAST(CASE WHEN price > 0 THEN round(price * CAST(0.60 AS DECIMAL(12,4)), 2) ELSE price END AS DOUBLE) AS reduced,
CAST(price AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS snapshot FROM cat""")
def tier_reset(spark, sf):
    c = pricing.bulk_tier(catalogue(spark, sf).withColumn("snapshot", F.lit(None).cast("decimal(18,2)")), 40)
    return doubles(pricing.reset_tier(c.withColumn("reduced", F.col("price"))).select("id", "reduced", "price", "snapshot"), "reduced", "price", "snapshot")


@query(f"WITH {CATALOGUE_SQL} SELECT id, CASE WHEN id % 50 = 0 THEN 'moved' ELSE file_name END AS file_name, CASE WHEN id % 50 = 0 THEN NULL ELSE category END AS category FROM cat WHERE id % 77 <> 0")
def row_updates(spark, sf):
    c = catalogue(spark, sf)
    picked, gone = c.filter("id % 50 = 0").select("id", F.lit(True).alias("hit")), c.filter("id % 77 = 0").select("id")
    c = c.join(gone, "id", "left_anti").join(picked, "id", "left")
    return c.select("id", F.when(F.col("hit"), "moved").otherwise(F.col("file_name")).alias("file_name"), F.when(F.col("hit").isNull(), F.col("category")).alias("category"))


@query(f"""WITH {CATALOGUE_SQL}, base AS (SELECT product, model FROM cat WHERE id % 3 <> 0), more AS (SELECT DISTINCT upper(product) || ' ' AS product, model FROM cat)
SELECT product, model FROM base UNION ALL SELECT product, model FROM more m
WHERE NOT EXISTS (SELECT 1 FROM base b WHERE lower(trim(b.product)) = lower(trim(m.product)) AND lower(trim(b.model)) = lower(trim(m.model)))""")
def add_missing(spark, sf):
    c = catalogue(spark, sf)
    more = c.select(F.concat(F.upper("product"), F.lit(" ")).alias("product"), "model").distinct()
    return history.insert_missing(c.filter("id % 3 <> 0").select("product", "model"), more, ["product", "model"])


@query(f"WITH {CATALOGUE_SQL} SELECT id, file_name FROM cat WHERE file_name <> 'file2' UNION ALL SELECT id + 1000000 AS id, file_name FROM cat WHERE file_name = 'file2' AND price > 0")
def replace_by_file(spark, sf):
    c = catalogue(spark, sf)
    new = c.filter("file_name = 'file2' and price > 0").select((F.col("id") + 1000000).alias("id"), "file_name")
    return c.join(new.select("file_name").distinct(), "file_name", "left_anti").select("id", "file_name").unionByName(new)


@query(f"""WITH {CATALOGUE_SQL} SELECT file_name, count(*) AS n, count(*) FILTER (WHERE price > 1500 OR cost > 900) AS priced,
CASE WHEN count(*) FILTER (WHERE price > 1500 OR cost > 900) = 0 THEN 'reject' WHEN count(*) FILTER (WHERE price > 1500 OR cost > 900) < count(*) THEN 'warn' ELSE 'ok' END AS status FROM cat GROUP BY file_name""")
def import_gate(spark, sf):
    n = F.count_if((F.col("price") > 1500) | (F.col("cost") > 900))
    per = catalogue(spark, sf).groupBy("file_name").agg(F.count("*").alias("n"), n.alias("priced"))
    return per.withColumn("status", F.when(F.col("priced") == 0, "reject").when(F.col("priced") < F.col("n"), "warn").otherwise("ok"))


# ---------------------------------------------------------------- money


@query(f"""WITH {PRICED_SQL} SELECT quote, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, CAST(sum(tax) AS DOUBLE) AS tax, CAST(sum(amount) + sum(tax) AS DOUBLE) AS grand
FROM priced GROUP BY quote""")
def line_totals(spark, sf):
    return doubles(pricing.quote_totals(pricing.priced_lines(quote_lines(spark, sf), catalogue(spark, sf))), "total", "tax", "grand")


@query(f"""WITH {PRICED_SQL}, s AS (SELECT *, CASE WHEN NOT known THEN 'not_in_master' WHEN cost IS NULL OR cost <= 0 THEN 'no_cost' WHEN price > 0 THEN 'ok' ELSE 'no_price' END AS state FROM priced)
SELECT quote, count(*) FILTER (WHERE state = 'ok') AS n_ok, count(*) FILTER (WHERE state = 'no_cost') AS n_no_cost, count(*) FILTER (WHERE state = 'not_in_master') AS n_unknown,
CAST(sum(amount) AS DOUBLE) AS revenue, CAST(sum(CASE WHEN state = 'ok' THEN amount END) AS DOUBLE) AS known_revenue,
CAST(sum(CASE WHEN state = 'ok' THEN amount - CAST(round(qty * cost, 2) AS DECIMAL(18,2)) END) AS DOUBLE) AS profit FROM s GROUP BY quote""")
def margin_by_quote(spark, sf):
    rows = pricing.priced_lines(quote_lines(spark, sf), catalogue(spark, sf).filter("id % 17 <> 0"))
    return doubles(pricing.margin_summary(rows), "revenue", "known_revenue", "profit")


ORACLE_SQL["margin_by_quote"] = ORACLE_SQL["margin_by_quote"].replace("LEFT JOIN cat c ON c.id = l.part", "LEFT JOIN cat c ON c.id = l.part AND c.id % 17 <> 0")

_BRANDS = {"Brand#11": 10, "Brand#23": 5}


@query(f"""WITH {PRICED_SQL}, p AS (SELECT brand, sum(amount) AS amount, sum(tax) AS tax, CAST(CASE brand WHEN 'Brand#11' THEN 10 WHEN 'Brand#23' THEN 5 ELSE 0 END AS DECIMAL(9,2)) AS pc FROM priced GROUP BY brand),
d AS (SELECT brand, amount, CAST(round(amount * pc * CAST(0.01 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS discount, tax - CAST(round(tax * pc * CAST(0.01 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS net_tax FROM p)
SELECT brand, CAST(amount AS DOUBLE) AS amount, CAST(discount AS DOUBLE) AS discount, CAST(net_tax AS DOUBLE) AS net_tax, CAST(amount - discount + net_tax AS DOUBLE) AS total FROM d""")
def brand_summary(spark, sf):
    rows = pricing.priced_lines(quote_lines(spark, sf), catalogue(spark, sf))
    return doubles(pricing.brand_summary(rows, _BRANDS), "amount", "discount", "net_tax", "total")


@query(f"WITH {PRICED_SQL} SELECT section, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(tax) AS DOUBLE) AS tax FROM priced GROUP BY ROLLUP (section)")
def section_rollup(spark, sf):
    return doubles(pricing.section_rollup(pricing.priced_lines(quote_lines(spark, sf), catalogue(spark, sf))), "amount", "tax")


@query(f"WITH {CATALOGUE_SQL} SELECT file_name, round(avg(CAST(price - cost AS DOUBLE) * 100.0 / CAST(price AS DOUBLE)), 1) AS margin, count(*) AS n FROM cat WHERE cost > 0 AND price > cost GROUP BY file_name")
def avg_margin_by_file(spark, sf):
    pc = (F.col("price") - F.col("cost")).cast("double") * 100.0 / F.col("price").cast("double")
    return catalogue(spark, sf).filter("cost > 0 and price > cost").groupBy("file_name").agg(F.round(F.avg(pc), 1).alias("margin"), F.count("*").alias("n"))


@query(f"""WITH {CATALOGUE_SQL}, {LINES_SQL}, l AS (SELECT *, CASE WHEN quote % 4 = 0 THEN CAST(1.5 AS DECIMAL(18,2)) END AS before FROM lines) SELECT quote, part, pos, supplier, CAST(coalesce(c.price, l.price) AS DOUBLE) AS price,
CAST(CASE WHEN c.price <> l.price THEN coalesce(l.before, l.price) ELSE l.before END AS DOUBLE) AS previous, coalesce(c.price <> l.price, false) AS changed FROM l LEFT JOIN cat c ON c.id = l.part""")
def price_refresh(spark, sf):
    lines = quote_lines(spark, sf).withColumn("previous", F.when(F.col("quote") % 4 == 0, F.lit("1.5").cast("decimal(18,2)")))
    rows = pricing.refresh_prices(lines, catalogue(spark, sf))
    return doubles(rows.select("quote", "part", "pos", "supplier", "price", "previous", "changed"), "price", "previous")


@query(f"""WITH {LINES_SQL}, b AS (SELECT DISTINCT quote, part FROM lines WHERE quote IN (SELECT quote FROM lines GROUP BY quote HAVING count(*) <= 60)),
p AS (SELECT a.part, o.part AS other, count(*) AS together FROM b a JOIN b o ON a.quote = o.quote AND a.part <> o.part GROUP BY ALL)
SELECT part, other, together, row_number() OVER (PARTITION BY part ORDER BY together DESC, other) AS rank FROM p QUALIFY rank <= 6""")
def co_purchase_top6(spark, sf):
    return pricing.co_purchase(quote_lines(spark, sf))


@query(f"""WITH {LINES_SQL} SELECT quote, part, supplier, pos, CASE WHEN supplier % 5 <> 0 THEN sum(CASE WHEN supplier % 5 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY quote ORDER BY pos, part, supplier, qty, price ROWS UNBOUNDED PRECEDING) END AS serial FROM lines""")
def serial_skip_charges(spark, sf):
    w = Window.partitionBy("quote").orderBy("pos", "part", "supplier", "qty", "price").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    item = F.col("supplier") % 5 != 0
    return quote_lines(spark, sf).select("quote", "part", "supplier", "pos", F.when(item, F.sum(item.cast("int")).over(w)).alias("serial"))


# ---------------------------------------------------------------- hygiene and audits


@query(f"WITH {CATALOGUE_SQL} SELECT lower(trim(product)) AS name, count(*) AS n, count(DISTINCT file_name) AS files FROM cat GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf):
    return hygiene.duplicate_names(catalogue(spark, sf))


@query(f"""WITH {CATALOGUE_SQL}, d AS (SELECT file_name, lower(trim(product)) AS name, count(*) AS n FROM cat GROUP BY ALL HAVING count(*) > 1)
SELECT file_name, count(*) AS groups_, CAST(sum(n) AS BIGINT) AS rows_ FROM d GROUP BY file_name""")
def duplicates_in_file(spark, sf):
    d = catalogue(spark, sf).groupBy("file_name", F.lower(F.trim("product")).alias("name")).agg(F.count("*").alias("n")).filter("n > 1")
    return d.groupBy("file_name").agg(F.count("*").alias("groups_"), F.sum("n").alias("rows_"))


@query(f"""WITH {CATALOGUE_SQL}, m AS (SELECT DISTINCT lower(model) AS model, file_name AS f FROM cat), ok AS (SELECT model FROM m GROUP BY model HAVING count(*) BETWEEN 2 AND 8)
SELECT a.f AS a, b.f AS b, count(*) AS shared FROM m a JOIN m b ON a.model = b.model AND a.f < b.f WHERE a.model IN (SELECT model FROM ok) GROUP BY ALL HAVING count(*) >= 5""")
def overlapping_imports(spark, sf):
    return hygiene.overlapping_files(catalogue(spark, sf))


@query("""WITH m AS (SELECT p_partkey AS id, p_partkey % 7 AS f, lower('M' || (1000 + p_partkey % 2900)) AS model FROM part)
SELECT a.model, a.id AS a, b.id AS b FROM m a JOIN m b ON a.model = b.model WHERE a.f = 0 AND b.f = 4 AND length(a.model) >= 5 ORDER BY model, a, b LIMIT 30""")
def overlap_preview(spark, sf):
    """The first pairs of two files that share a code of five characters or more."""
    k = F.col("p_partkey")
    c = table(spark, sf, "part").select(k.alias("id"), F.lower(F.concat(F.lit("M"), (1000 + k % 2900).cast("string"))).alias("model"), (k % 7).alias("f")).filter(F.length("model") >= 5)
    a, b = c.filter("f = 0").select("model", F.col("id").alias("a")), c.filter("f = 4").select("model", F.col("id").alias("b"))
    return a.join(b, "model").orderBy("model", "a", "b").limit(30)


@query(f"""WITH {CATALOGUE_SQL} SELECT file_name, count(*) AS n, count(*) FILTER (WHERE price > 0) AS with_price, count(cost) AS with_cost, count(gst) AS with_gst,
count(*) FILTER (WHERE trim(model) <> '') AS with_model, count(*) FILTER (WHERE trim(brand) <> '') AS with_brand, count(*) FILTER (WHERE trim(category) <> '') AS with_category FROM cat GROUP BY file_name""")
def completeness_audit(spark, sf):
    return hygiene.completeness(catalogue(spark, sf))


@query("WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word")
def vocab_frequency(spark, sf):
    return hygiene.vocabulary(table(spark, sf, "documents"), "text")


@query("""WITH w AS (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z]{3,}')) AS word FROM part), v AS (SELECT word, count(*) AS n FROM w GROUP BY word),
s AS (SELECT left(word, 1) || regexp_replace(substr(word, 2), '[aeiou]', '', 'g') AS skeleton, word, n FROM v)
SELECT skeleton, word, n, row_number() OVER (PARTITION BY skeleton ORDER BY n DESC, word) AS rank FROM s QUALIFY rank <= 2""")
def skeleton_map(spark, sf):
    v = hygiene.vocabulary(table(spark, sf, "part"), "p_name").withColumn("skeleton", X.skeleton(F.col("word")))
    order = Window.partitionBy("skeleton").orderBy(F.desc("n"), "word")
    return v.select("skeleton", "word", "n", F.row_number().over(order).alias("rank")).filter("rank <= 2")


@query(f"""WITH {CATALOGUE_SQL}, w AS (SELECT DISTINCT id, brand, unnest(regexp_extract_all(lower(product || ' ' || model), '[a-z0-9]{{2,}}')) AS word FROM cat),
own AS (SELECT brand, word, count(*) AS own FROM w GROUP BY ALL), total AS (SELECT word, count(*) AS n FROM w GROUP BY word)
SELECT brand, word, own, n - own AS elsewhere FROM own JOIN total USING (word) WHERE n - own < 25""")
def brand_generic(spark, sf):
    """Words that name a brand: fewer than 25 rows of other brands have them."""
    c = catalogue(spark, sf)
    w = c.select("id", "brand", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "product", "model")), F.lit("[a-z0-9]{2,}"), F.lit(0)))).alias("word"))
    own = w.groupBy("brand", "word").agg(F.count("*").alias("own"))
    total = own.groupBy("word").agg(F.sum("own").alias("n"))
    return own.join(total, "word").select("brand", "word", "own", (F.col("n") - F.col("own")).alias("elsewhere")).filter("elsewhere < 25")


@query("""WITH t AS (SELECT DISTINCT p_partkey % 7 AS f, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]{3,}')) AS token FROM part)
SELECT token, string_agg(CAST(f AS VARCHAR), ',' ORDER BY f) AS files FROM t GROUP BY token""")
def file_tokens(spark, sf):
    p = table(spark, sf, "part")
    t = p.select((F.col("p_partkey") % 7).alias("f"), F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("[a-z]{3,}"), F.lit(0))).alias("token"))
    return t.groupBy("token").agg(F.array_join(F.transform(F.sort_array(F.collect_set("f")), lambda x: x.cast("string")), ",").alias("files"))


@query("""WITH t AS (SELECT string_split(p_name, ' ') AS w FROM part), m AS (SELECT unnest(w[2:len(w) - 1]) AS word, 1 AS mid, 0 AS last FROM t UNION ALL SELECT w[len(w)], 0, 1 FROM t)
SELECT word, CAST(sum(mid) AS BIGINT) AS middle, CAST(sum(last) AS BIGINT) AS final FROM m GROUP BY word""")
def collection_words(spark, sf):
    t = table(spark, sf, "part").select(F.split("p_name", " ").alias("w"))
    n = F.size("w")
    mid = t.select(F.explode(F.when(n > 2, F.slice("w", 2, n - 2)).otherwise(F.array().cast("array<string>"))).alias("word"), F.lit(1).alias("mid"), F.lit(0).alias("last"))
    last = t.select(F.element_at("w", -1).alias("word"), F.lit(0).alias("mid"), F.lit(1).alias("last"))
    return mid.unionByName(last).groupBy("word").agg(F.sum("mid").alias("middle"), F.sum("last").alias("final"))


@query("""SELECT CASE WHEN regexp_matches(lower(text), 'token|secret|password') THEN 'secret' WHEN regexp_matches(text, '[0-9]{6,}') THEN 'number' WHEN length(text) < 100 THEN 'short' ELSE 'other' END AS bucket,
lang, count(*) AS n FROM documents GROUP BY ALL""")
def keyword_buckets(spark, sf):
    t = F.col("text")
    bucket = F.when(F.lower(t).rlike("token|secret|password"), "secret").when(t.rlike("[0-9]{6,}"), "number").when(F.length(t) < 100, "short").otherwise("other")
    return table(spark, sf, "documents").groupBy(bucket.alias("bucket"), "lang").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- logs, evidence, windows


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 14")
def daily_activity_14(spark, sf):
    return history.daily_counts(table(spark, sf, "events"), 14)


@query(f"""WITH {EVIDENCE_SQL}, g AS (SELECT phrase, product, count(*) AS n, max(ts) AS last FROM ev GROUP BY ALL)
SELECT phrase, product, n, row_number() OVER (PARTITION BY phrase ORDER BY n DESC, last DESC, product) AS rank FROM g QUALIFY rank <= 6""")
def phrase_history(spark, sf):
    return history.phrase_history(evidence(spark, sf))


@query(f"""WITH {EVIDENCE_SQL} SELECT phrase, product, kind, event_id, count(*) OVER (PARTITION BY phrase, kind) AS times FROM ev
QUALIFY row_number() OVER (PARTITION BY phrase, kind ORDER BY ts DESC, event_id DESC) = 1""")
def latest_upsert(spark, sf):
    return history.latest_upsert(evidence(spark, sf), ["phrase", "kind"]).select("phrase", "product", "kind", "event_id", "times")


@query(f"""WITH {EVIDENCE_SQL}, c AS (SELECT DISTINCT phrase, product FROM ev WHERE kind = 'click'), s AS (SELECT phrase, product, count(*) AS n FROM ev WHERE kind <> 'click' GROUP BY ALL)
SELECT c.phrase, c.product, 1 + coalesce(n, 0) AS times FROM c LEFT JOIN s USING (phrase, product)""")
def confirm_counts(spark, sf):
    e = evidence(spark, sf)
    c = e.filter("kind = 'click'").select("phrase", "product").distinct().withColumn("times", F.lit(1).cast("long"))
    return history.confirm(c, e.filter("kind <> 'click'"))


@query(f"""WITH {EVIDENCE_SQL}, top AS (SELECT phrase, product FROM ev GROUP BY phrase, product QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY count(*) DESC, product) = 1)
SELECT r.request, r.phrase, coalesce(t.product, 'none') AS product, CASE WHEN t.product IS NULL THEN 'not_found' ELSE 'learned' END AS matched_by
FROM (SELECT DISTINCT user_id AS request, 'phrase ' || (user_id % 60) AS phrase FROM events) r LEFT JOIN top t ON t.phrase = r.phrase""")
def learned_override(spark, sf):
    n = evidence(spark, sf).groupBy("phrase", "product").agg(F.count("*").alias("n"))
    top = n.withColumn("k", F.row_number().over(Window.partitionBy("phrase").orderBy(F.desc("n"), "product"))).filter("k = 1").select("phrase", "product")
    r = table(spark, sf, "events").select(F.col("user_id").alias("request"), F.concat(F.lit("phrase "), (F.col("user_id") % 60).cast("string")).alias("phrase")).distinct()
    out = r.join(top, "phrase", "left")
    return out.select("request", "phrase", F.coalesce("product", F.lit("none")).alias("product"), F.when(F.col("product").isNull(), "not_found").otherwise("learned").alias("matched_by"))


@query("""SELECT c.c_custkey AS user_id, count(e.event_id) AS n, count(DISTINCT e.event_type) AS kinds FROM customer c LEFT JOIN events e ON e.user_id = c.c_custkey GROUP BY 1""")
def activity_left_join(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return c.join(e, "user_id", "left").groupBy("user_id").agg(F.count("event_id").alias("n"), F.countDistinct("event_type").alias("kinds"))


@query("""WITH l AS (SELECT l_orderkey AS quote, l_partkey AS part, l_suppkey AS supplier, max(l_quantity) AS before, max(CASE WHEN l_partkey % 6 = 0 THEN l_quantity + 1 WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END) AS after FROM lineitem GROUP BY ALL)
SELECT * FROM l WHERE before IS DISTINCT FROM after""")
def change_detect(spark, sf):
    base = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("quote"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).agg(F.max("l_quantity").alias("q"))
    new = base.withColumn("q", F.when(F.col("part") % 6 == 0, F.col("q") + 1).when(F.col("part") % 7 == 0, F.lit(None)).otherwise(F.col("q")))
    return history.changed_lines(base, new, ["quote", "part", "supplier"], "q")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events""")
def forward_fill(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w).alias("filled"))


@query("""WITH r AS (SELECT user_id % 50 AS sheet, event_id AS r, lead(event_id) OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS nxt FROM events WHERE event_type = 'click'),
a AS (SELECT user_id % 50 AS sheet, event_id AS r FROM events WHERE event_type <> 'click')
SELECT CAST(a.sheet AS VARCHAR) AS sheet, a.r AS anchor, r.r AS row_at FROM a JOIN r ON a.sheet = r.sheet AND a.r >= r.r AND (r.nxt IS NULL OR a.r < r.nxt)""")
def span_assign(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 50).cast("string").alias("sheet"), F.col("event_id").alias("r"), "event_type")
    return ingest.assign_spans(e.filter("event_type <> 'click'").withColumn("anchor", F.col("r")), e.filter("event_type = 'click'"))


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderstatus AS status, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY ALL")
def monthly_dashboard(spark, sf):
    o = table(spark, sf, "orders")
    month = F.trunc(F.to_date("o_orderdate"), "month")
    return o.groupBy(month.alias("month"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""SELECT r_name AS region, c_mktsegment AS segment, count(DISTINCT c_custkey) AS clients, count(o_orderkey) AS quotes FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def region_clients(spark, sf):
    r, n, c, o = (table(spark, sf, t) for t in ("region", "nation", "customer", "orders"))
    j = r.join(n, r.r_regionkey == n.n_regionkey).join(c, c.c_nationkey == n.n_nationkey).join(o, o.o_custkey == c.c_custkey, "left")
    return j.groupBy(F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.countDistinct("c_custkey").alias("clients"), F.count("o_orderkey").alias("quotes"))


# ---------------------------------------------------------------- text and retrieval


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS phrase FROM documents")
def norm_phrase(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.norm_phrase(F.col("text")).cast("binary")).alias("phrase"))


@query(f"""WITH w AS (SELECT p_partkey AS id, unnest(regexp_extract_all(lower(p_name), '[a-z]{{3,}}')) AS word FROM part), d AS (SELECT DISTINCT id, word FROM w WHERE word NOT IN {UNITS})
SELECT id, count(*) AS n, string_agg(word, ' ' ORDER BY word) AS words FROM d GROUP BY id""")
def sig_words(spark, sf):
    w = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.sig_words(F.col("p_name")).alias("w")).filter(F.size("w") > 0)
    return w.select("id", F.size("w").cast("long").alias("n"), F.array_join(F.sort_array("w"), " ").alias("words"))


@query("""WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM documents), tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY ALL), len AS (SELECT id, count(*) AS length FROM w GROUP BY id),
n AS (SELECT count(*) AS docs, avg(length) AS mean FROM len), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS request, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) AS term FROM benchmark),
s AS (SELECT request, tf.id, round(sum(greatest(0.0, ln((docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
FROM q JOIN df USING (term) JOIN tf USING (term) JOIN len ON len.id = tf.id, n GROUP BY ALL)
SELECT request, id, score, row_number() OVER (PARTITION BY request ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 50""")
def bm25_top50(spark, sf):
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,}"), F.lit(0))))
    terms = table(spark, sf, "benchmark").select(F.col("item_id").alias("request"), words.alias("term"))
    return match.bm25(table(spark, sf, "documents"), "doc_id", "text", terms, 50)


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]{4,}')) AS near FROM part),
t AS (SELECT DISTINCT word FROM (SELECT substr(near, 2, 1) || left(near, 1) || substr(near, 3) AS word FROM w UNION ALL SELECT left(near, 2) || substr(near, 4) FROM w UNION ALL SELECT near || 's' FROM w))
SELECT t.word, w.near FROM t JOIN w ON t.word <> w.near AND damerau_levenshtein(t.word, w.near) <= 1""")
def typo_neighbours(spark, sf):
    p = table(spark, sf, "part")
    w = p.select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")).distinct()
    s, n = F.col("word"), F.length("word")
    typo = F.array(F.concat(F.substr(s, F.lit(2), F.lit(1)), F.substr(s, F.lit(1), F.lit(1)), F.substr(s, F.lit(3), n)), F.concat(F.substr(s, F.lit(1), F.lit(2)), F.substr(s, F.lit(4), n)), F.concat(s, F.lit("s")))
    return match.typo_pairs(w.select(F.explode(typo).alias("word")).distinct(), w)


@query(f"""WITH {CATALOGUE_SQL}, w AS (SELECT * FROM (VALUES ('nvil'),('izmo'),('arge'),('late'),('idge')) AS t(word)), t AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(product), '[a-z]{{5,}}')) AS token FROM cat)
SELECT DISTINCT word, id FROM w JOIN t ON contains(token, word) AND token <> word""")
def glued_substring(spark, sf):
    return match.glued(spark.createDataFrame([("nvil",), ("izmo",), ("arge",), ("late",), ("idge",)], "word string"), catalogue(spark, sf))


@query(f"""WITH {CATALOGUE_SQL}, r AS (SELECT p_partkey AS request, 'x' || 'c' || (p_partkey * 3 % 1000) AS code FROM part),
j AS (SELECT request, code, lower(model) AS key, id FROM r JOIN cat ON length(model) >= 3 AND (lower(model) = code OR (length(model) < length(code) AND right(code, length(model)) = lower(model))))
SELECT request, code, key, id FROM j QUALIFY row_number() OVER (PARTITION BY request ORDER BY key = code DESC, length(key) DESC, id) = 1""")
def code_suffix_lookup(spark, sf):
    r = table(spark, sf, "part").select(F.col("p_partkey").alias("request"), F.concat(F.lit("X-C"), (F.col("p_partkey") * 3 % 1000).cast("string")).alias("code"))
    return match.code_lookup(r, catalogue(spark, sf))


@query("""WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q, v.vec_id AS id, round(list_cosine_similarity(q.e::DOUBLE[], v.embedding::DOUBLE[]), 6) AS cosine FROM q JOIN embeddings v ON v.vec_id <> q.q)
SELECT q, id, cosine, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, id) AS rank FROM s QUALIFY rank <= 5""")
def knn_top5(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.nearest(e.filter("id % 100 = 0").withColumnRenamed("id", "q"), e, 5)


@query("""WITH q AS (SELECT vec_id AS q, embedding AS e, label FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q, v.vec_id AS id, round(list_cosine_similarity(q.e::DOUBLE[], v.embedding::DOUBLE[]), 6) AS cosine FROM q JOIN embeddings v ON v.vec_id <> q.q),
near AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY cosine DESC, id) <= 40), words AS (SELECT q, vec_id AS id FROM q JOIN embeddings v ON v.label = q.label AND v.vec_id <> q.q AND v.vec_id % 10 = q.q // 100 % 10)
SELECT q, id, cosine, CASE WHEN words.id IS NOT NULL AND near.id IS NOT NULL THEN 'both' WHEN words.id IS NOT NULL THEN 'word' ELSE 'sem' END AS tier FROM words FULL JOIN near USING (q, id) WHERE words.id IS NOT NULL OR cosine >= 0.25""")
def vector_candidates(spark, sf):
    """The 40 nearest of each query beside those that share a word (here: label and last digit), in one table with tiers."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    q = e.filter("id % 100 = 0").withColumnRenamed("id", "q")
    digit = F.floor(F.col("q") / 100) % 10
    words = q.select("q", "label", digit.alias("d")).join(e.select("id", "label", (F.col("id") % 10).alias("d")), ["label", "d"]).filter("id <> q")
    return vectors.united(words, vectors.nearest(q.select("q", "v"), e.select("id", "v"), 40), 0.25)


@query(f"""WITH {CATALOGUE_SQL}, s AS (SELECT brand AS request, id, price, CASE WHEN id % 4 = 0 THEN 'name' ELSE 'part' END AS tier, (id * 37) % 1000 AS score FROM cat),
o AS (SELECT *, (first_value(tier) OVER w = tier) AND (first_value(score) OVER w - score <= 120) AS ok FROM s WINDOW w AS (PARTITION BY request ORDER BY score DESC, id)),
b AS (SELECT *, min(CAST(ok AS INT)) OVER (PARTITION BY request ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS in_band FROM o)
SELECT request, id, in_band, row_number() OVER (PARTITION BY request ORDER BY in_band DESC, CASE WHEN in_band = 1 THEN price END, score DESC, id) AS rank FROM b""")
def price_band_rerank(spark, sf):
    c = catalogue(spark, sf).select(F.col("brand").alias("request"), "id", "price", F.when(F.col("id") % 4 == 0, "name").otherwise("part").alias("tier"), (F.col("id") * 37 % 1000).alias("score"))
    return match.cheapest_band(c).select("request", "id", "in_band", "rank")


@query(f"""WITH {CATALOGUE_SQL}, r AS (SELECT DISTINCT s_suppkey AS request, CASE s_suppkey % 4 WHEN 0 THEN 'C' || s_suppkey WHEN 1 THEN p.p_name WHEN 2 THEN split_part(p.p_name, ' ', 1) ELSE 'unknown thing' END AS phrase
FROM supplier JOIN part p ON p.p_partkey = s_suppkey), rw AS (SELECT request, list_distinct(regexp_extract_all(lower(phrase), '[a-z]{{3,}}')) AS asked, trim(lower(phrase)) AS phrase, regexp_replace(lower(phrase), '[^a-z0-9]', '', 'g') AS code FROM r),
p AS (SELECT id, price, trim(lower(product)) AS name, list_distinct(regexp_extract_all(lower(product), '[a-z]{{3,}}')) AS words, lower(model) AS key FROM cat),
c AS (SELECT request, id, price, name, asked, len(list_intersect(asked, words)) AS hits, phrase = name AS is_exact, code = key AS is_code FROM rw JOIN p ON len(list_intersect(asked, words)) > 0 OR code = key),
t AS (SELECT *, CASE WHEN is_exact THEN 'exact' WHEN is_code THEN 'code' WHEN hits = len(asked) THEN 'name' WHEN hits >= len(asked) * 0.6 THEN 'part' END AS tier FROM c),
s AS (SELECT request, id, price, tier, CASE tier WHEN 'exact' THEN 2000 WHEN 'code' THEN 1500 WHEN 'name' THEN 600 - least(length(name), 120) ELSE 200 + 10 * hits END + CASE WHEN price > 0 THEN 30 ELSE 0 END AS score FROM t WHERE tier IS NOT NULL),
k AS (SELECT *, max(score) OVER (PARTITION BY request) AS top FROM s), f AS (SELECT request, id, tier, score, row_number() OVER (PARTITION BY request ORDER BY score DESC, price, id) AS rank FROM k WHERE score >= least(top * 0.6, 420) QUALIFY rank <= 15)
SELECT r.request, f.id, coalesce(f.tier, 'not_found') AS tier, CAST(f.score AS BIGINT) AS score, f.rank FROM (SELECT DISTINCT request FROM r) r LEFT JOIN f USING (request)""")
def resolve_requests(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("s_suppkey"), "p_name")
    s = table(spark, sf, "supplier").select("s_suppkey").join(p, "s_suppkey")
    k = F.col("s_suppkey")
    phrase = F.when(k % 4 == 0, F.concat(F.lit("C"), k.cast("string"))).when(k % 4 == 1, F.col("p_name")).when(k % 4 == 2, F.split("p_name", " ")[0]).otherwise("unknown thing")
    return match.resolve(s.select(k.alias("request"), phrase.alias("phrase")), catalogue(spark, sf))


# ---------------------------------------------------------------- sheets and requests

_SHEET = f"{SHEETS_SQL}, al AS ({ALIASES_SQL}), named AS (SELECT c.*, field, priority FROM cells c JOIN al ON upper(trim(v)) = label WHERE r <= 25)"
_HEADS = "heads AS (SELECT sheet, r, count(DISTINCT field) AS fields FROM named GROUP BY sheet, r HAVING max(CASE WHEN field = 'product' THEN 1 ELSE 0 END) = 1 QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY count(DISTINCT field) DESC, r) = 1)"
_MAP = "cmap AS (SELECT n.sheet, field, c FROM named n JOIN heads h ON n.sheet = h.sheet AND n.r = h.r QUALIFY row_number() OVER (PARTITION BY n.sheet, field ORDER BY priority, c) = 1)"


@query(f"WITH {_SHEET}, {_HEADS} SELECT * FROM heads")
def header_score(spark, sf):
    return ingest.header_rows(sheet_cells(spark, sf), spark.sql(ALIASES_SQL))


@query(f"WITH {_SHEET}, {_HEADS}, {_MAP} SELECT * FROM cmap")
def column_map(spark, sf):
    return ingest.column_map(sheet_cells(spark, sf), spark.sql(ALIASES_SQL))


@query(f"""WITH {_SHEET}, {_HEADS}, {_MAP}, x AS (SELECT c.sheet, c.r, max(v) FILTER (WHERE field = 'product') AS product, max(v) FILTER (WHERE field = 'model') AS model, max(v) FILTER (WHERE field = 'qty') AS qty,
max(v) FILTER (WHERE field = 'price') AS price, max(v) FILTER (WHERE field = 'gst') AS gst FROM cells c JOIN heads h ON c.sheet = h.sheet AND c.r > h.r JOIN cmap m ON m.sheet = c.sheet AND m.c = c.c GROUP BY c.sheet, c.r),
k AS (SELECT *, coalesce(trim(product), '') AS label FROM x), f AS (SELECT * FROM k WHERE NOT regexp_matches(lower(label), '^(grand |sub)?total|^summary') AND NOT regexp_matches(label, ':-?$'))
SELECT sheet, r, last_value(CASE WHEN label <> '' AND upper(label) <> 'OPTION' THEN label END IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY r ROWS UNBOUNDED PRECEDING) AS product, model,
CASE WHEN coalesce(TRY_CAST(qty AS DOUBLE), 0) = 0 THEN 1.0 ELSE TRY_CAST(qty AS DOUBLE) END AS qty, coalesce(TRY_CAST(price AS DOUBLE), 0.0) AS price,
coalesce(CASE WHEN TRY_CAST(gst AS DOUBLE) > 0 AND TRY_CAST(gst AS DOUBLE) <= 1 THEN TRY_CAST(gst AS DOUBLE) * 100 ELSE TRY_CAST(gst AS DOUBLE) END, 18.0) AS gst FROM f""")
def sheet_rows(spark, sf):
    return ingest.sheet_rows(sheet_cells(spark, sf), spark.sql(ALIASES_SQL), sheet_lines(spark, sf))


@query(f"""WITH {SHEETS_SQL}, p AS (SELECT sheet, sum(CASE WHEN upper(trim(v)) IN ('HSN CODE','BRAND','UNIT PRICE','PRICE') THEN 1 ELSE 0 END) AS a, sum(CASE WHEN upper(trim(v)) IN ('QTY','SL. NO.','MODEL NO') THEN 1 ELSE 0 END) AS b FROM cells GROUP BY sheet)
SELECT sheet, CASE WHEN a + b = 0 THEN 'other' WHEN a >= b THEN 'catalogue' ELSE 'requirement' END AS kind, CASE WHEN a + b > 0 THEN round(greatest(a, b) / (a + b), 4) ELSE 0.0 END AS confidence FROM p""")
def file_type(spark, sf):
    return ingest.file_kind(sheet_cells(spark, sf))


@query(f"""WITH {PRICED_SQL} SELECT quote, count(*) AS n, count(*) FILTER (WHERE known) AS found, round(count(*) FILTER (WHERE known) * 100.0 / count(*), 1) AS percent FROM priced GROUP BY quote""".replace("ON c.id = l.part", "ON c.id = l.part AND c.id % 9 <> 0"))
def coverage(spark, sf):
    rows = pricing.priced_lines(quote_lines(spark, sf), catalogue(spark, sf).filter("id % 9 <> 0"))
    found = F.count("known")
    return rows.groupBy("quote").agg(F.count("*").alias("n"), found.alias("found"), F.round(found * 100.0 / F.count("*"), 1).alias("percent"))


@query("SELECT doc_id, CAST(list_sum(list_transform(string_split(text, chr(10)), lambda x: greatest(1, CAST(ceil(length(x) / 40.0) AS INT)))) AS BIGINT) AS n FROM documents")
def wrapped_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.wrapped_lines(F.col("text"), 40).cast("long").alias("n"))


@query(f"""WITH {CATALOGUE_SQL}, d AS (SELECT id, left(regexp_replace(brand, '[^A-Za-z0-9 ]', ' ', 'g'), 28) AS name FROM cat)
SELECT id, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY id) = 1 THEN name ELSE name || ' ' || row_number() OVER (PARTITION BY name ORDER BY id) END AS sheet FROM d""")
def sheet_names(spark, sf):
    d = catalogue(spark, sf).select("id", F.substring(F.regexp_replace("brand", "[^A-Za-z0-9 ]", " "), 1, 28).alias("name"))
    k = F.col("number")
    return numbered(d, ["name"], ["id"]).select("id", F.when(k == 1, F.col("name")).otherwise(F.concat_ws(" ", "name", k.cast("string"))).alias("sheet"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') || '-' || lpad(CAST(row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 5, '0') AS ref FROM orders")
def reference_numbers(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    number = F.lpad(F.col("number").cast("string"), 5, "0")
    return numbered(rows, ["month"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.concat_ws("-", "month", number).alias("ref"))


@query(f"WITH {CATALOGUE_SQL} SELECT id, sha1(lower(product) || '|' || model || '|' || brand) AS key FROM cat")
def verdict_key(spark, sf):
    return catalogue(spark, sf).select("id", F.sha1(F.concat_ws("|", F.lower("product"), "model", "brand").cast("binary")).alias("key"))


@query(f"""WITH {CATALOGUE_SQL} SELECT id, CAST(CASE WHEN cost > 0 AND price > 0 THEN round(CAST(price - cost AS DOUBLE) * 100 / CAST(price AS DOUBLE), 1) END AS DOUBLE) AS margin,
CAST(CAST(round(price * CAST(coalesce(gst, 18) AS DECIMAL(9,2)) * CAST(0.01 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS DOUBLE) AS tax FROM cat""")
def margin_and_tax(spark, sf):
    price = F.col("price").cast("double")
    margin = F.when((F.col("cost") > 0) & (F.col("price") > 0), F.round((F.col("price") - F.col("cost")).cast("double") * 100 / price, 1))
    return catalogue(spark, sf).select("id", margin.alias("margin"), M.percent_of(F.col("price"), F.coalesce("gst", F.lit(18))).cast("double").alias("tax"))
