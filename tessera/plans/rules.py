"""Named queries of the rules around matching, catalogue history and evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import match, pricing
from tessera.operators import rules as R
from tessera.plans.registry import PRICED_SQL, doubles, query
from tessera.sources.catalogue import CATALOGUE_SQL, EVIDENCE_SQL, LINES_SQL, catalogue, evidence, quote_lines, table

UNITS = "('" + "','".join(R.UNITS) + "')"
CORE = "list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda w: length(w) >= 3 AND w NOT IN " + UNITS + ")"
FORMS = "(contains({0}, w) OR contains({0}, CASE WHEN w LIKE '%s' AND length(w) > 3 THEN w[:-2] ELSE w || 's' END) OR contains(replace({0}, ' ', ''), w) OR contains(replace({0}, ' ', ''), CASE WHEN w LIKE '%s' AND length(w) > 3 THEN w[:-2] ELSE w || 's' END))"
#: Requests made from the catalogue: a name's words the other way round, plural, with a size.
ASKED_SQL = f"""{CATALOGUE_SQL}, names AS (SELECT DISTINCT product AS name FROM cat), asked AS (
  SELECT id AS request, split_part(product, ' ', 2) || 's ' || split_part(product, ' ', 1) || ' 5 ltr' AS phrase, product AS truth FROM cat WHERE file_name = 'file1')"""


def asked(c):
    word = lambda i: F.split_part("product", F.lit(" "), F.lit(i))
    return c.filter("file_name = 'file1'").select(F.col("id").alias("request"), F.concat(word(2), F.lit("s "), word(1), F.lit(" 5 ltr")).alias("phrase"), F.col("product").alias("truth"))


# ---------------------------------------------------------------- retrieval and ranking


@query(f"""WITH {ASKED_SQL}, words AS (SELECT DISTINCT request, unnest({CORE.format('phrase')}) AS w FROM asked), n AS (SELECT request, count(*) AS n FROM words GROUP BY request),
hits AS (SELECT request, name, count(*) AS k FROM words JOIN names ON {FORMS.format('lower(name)')} GROUP BY ALL)
SELECT request, arg_min(name, (length(name), name)) AS name FROM hits JOIN n USING (request) WHERE k = n GROUP BY request""")
def covers_all_words(spark, sf):
    c = catalogue(spark, sf)
    return R.covers_all(asked(c), c.select(F.col("product").alias("name")))


@query(f"""WITH {ASKED_SQL}, words AS (SELECT DISTINCT request, unnest(regexp_extract_all(lower(phrase), '[a-z]{{3,}}')) AS w FROM asked),
hits AS (SELECT request, name, count(*) AS hits FROM words JOIN names ON contains(lower(name), w) OR contains(replace(lower(name), ' ', ''), w) GROUP BY ALL)
SELECT request, name, hits, row_number() OVER (PARTITION BY request ORDER BY hits DESC, length(name), name DESC) AS rank FROM hits QUALIFY rank <= {R.PER_TERM}""")
def word_shortlist(spark, sf):
    c = catalogue(spark, sf)
    return R.shortlist(asked(c), c.select(F.col("product").alias("name")))


@query(f"""WITH {ASKED_SQL}, core AS (SELECT request, {CORE.format('phrase')} AS l FROM asked), words AS (SELECT request, unnest(l) AS w, len(l) AS n, generate_subscripts(l, 1) - 1 AS place FROM core),
hits AS (SELECT request, name, sum(n - place) AS hits FROM words JOIN names ON {FORMS.format('lower(name)')} GROUP BY ALL),
scored AS (SELECT request, id, CAST(hits * {R.PER_WORD} - least(length(name), {R.NAME_CAP}) + CASE WHEN price > 0 THEN {R.PRICED} ELSE 0 END AS BIGINT) AS score FROM hits JOIN cat ON product = name)
SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 6""")
def loose_suggestions(spark, sf):
    c = catalogue(spark, sf)
    return R.suggestions(asked(c), c).withColumn("score", F.col("score").cast("long"))


@query(f"""WITH {CATALOGUE_SQL}, w AS (SELECT id, brand, product, unnest(list_distinct(regexp_extract_all(lower(product), '[a-z0-9]{{2,}}'))) AS term FROM cat),
ask AS (SELECT DISTINCT brand, split_part(lower(product), ' ', 2) AS term FROM cat WHERE file_name = 'file2'),
hits AS (SELECT brand, id, count(*) AS hits, min(length(product)) AS n FROM w JOIN ask USING (brand, term) GROUP BY ALL)
SELECT brand, id, hits, row_number() OVER (PARTITION BY brand ORDER BY hits DESC, n, id) AS rank FROM hits QUALIFY rank <= 5""")
def preferred_brand_source(spark, sf):
    """The inverted index restricted to the brand that a request prefers."""
    c = catalogue(spark, sf)
    ask = c.filter("file_name = 'file2'").select("brand", F.split_part(F.lower("product"), F.lit(" "), F.lit(2)).alias("term")).distinct()
    hits = match.postings(c, "id", "product").join(c.select("id", "brand", F.length("product").alias("n")), "id").join(ask, ["brand", "term"])
    hits = hits.groupBy("brand", "id").agg(F.count("*").alias("hits"), F.min("n").alias("n"))
    order = Window.partitionBy("brand").orderBy(F.desc("hits"), "n", "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter("rank <= 5").drop("n")


@query(f"""WITH {EVIDENCE_SQL}, h AS (SELECT phrase, product, count(*) AS n FROM ev WHERE kind = 'purchase' GROUP BY ALL),
c AS (SELECT phrase, product, 600 - 10 * row_number() OVER (PARTITION BY phrase ORDER BY product) AS score FROM (SELECT DISTINCT phrase, product FROM ev))
SELECT c.phrase, c.product, CAST(score + CASE WHEN n IS NULL OR score >= {R.BOOST_BELOW} OR regexp_matches(c.phrase, '[0-9]{{3}}') THEN 0 WHEN n >= 2 THEN {R.RECURRING} ELSE {R.ONCE} END AS BIGINT) AS score
FROM c LEFT JOIN h ON h.phrase = c.phrase AND h.product = c.product""")
def history_boost(spark, sf):
    e = evidence(spark, sf)
    order = Window.partitionBy("phrase").orderBy("product")
    c = e.select("phrase", "product").distinct().withColumn("score", 600 - 10 * F.row_number().over(order))
    out = R.boosted(c, e.filter("kind = 'purchase'").groupBy("phrase", "product").agg(F.count("*").alias("n")))
    return out.withColumn("score", F.col("score").cast("long"))


@query(f"""WITH {CATALOGUE_SQL}, a AS (SELECT x.id AS q, y.id AS id, 1 AS prio FROM cat x JOIN cat y ON x.model = y.model AND x.id <> y.id),
b AS (SELECT x.id AS q, y.id AS id, 2 AS prio FROM cat x JOIN cat y ON x.brand = y.brand AND x.size = y.size AND x.spec = y.spec AND x.id <> y.id)
SELECT q, id, min(prio) AS source, count(*) AS n_sources FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY q, id""")
def candidate_union(spark, sf):
    """Candidates of several sources, one row a product, with the first source."""
    return R.candidate_pairs(catalogue(spark, sf))


@query(f"""WITH {ASKED_SQL}, w AS (SELECT request, unnest({CORE.format('phrase')}) AS w FROM asked), near AS (SELECT request, arg_min(name, (length(name), name)) AS name
  FROM asked JOIN names ON contains(lower(name), split_part(lower(phrase), ' ', 2)) GROUP BY request),
v AS (SELECT 'part' AS tier, 500 + request % 900 AS score, request, phrase, name FROM near JOIN asked USING (request))
SELECT request, name, score < {R.WEAK_BELOW} OR (len({CORE.format('phrase')}) BETWEEN 1 AND 2 AND len({CORE.format('name')}) - len({CORE.format('phrase')}) >= 2) AS weak FROM v""")
def weak_matches(spark, sf):
    c = catalogue(spark, sf)
    a = asked(c).withColumn("word", F.split_part(F.lower("phrase"), F.lit(" "), F.lit(2)))
    near = a.join(R.contained(a, c.select(F.col("product").alias("name")), forms=False), "word")
    near = near.groupBy("request", "phrase").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("name"))
    return near.select("request", "name", R.weak(F.lit("part"), 500 + F.col("request") % 900, F.col("phrase"), F.col("name")).alias("weak"))


@query(f"""WITH {EVIDENCE_SQL}, m AS (SELECT phrase, product, count(*) % 2 = 0 AS weak FROM ev GROUP BY ALL),
v AS (SELECT phrase, product, arg_max(kind = 'purchase', (ts, event_id)) AS ok FROM ev WHERE kind IN ('purchase', 'error') GROUP BY ALL)
SELECT m.phrase, m.product, m.weak, CASE WHEN NOT weak THEN 'kept' WHEN ok IS NULL THEN 'pending' WHEN ok THEN 'kept' ELSE 'placeholder' END AS state
FROM m LEFT JOIN v ON v.phrase = m.phrase AND v.product = m.product""")
def verdicts_applied(spark, sf):
    e = evidence(spark, sf)
    m = e.groupBy("phrase", "product").agg((F.count("*") % 2 == 0).alias("weak"))
    v = e.filter(F.col("kind").isin("purchase", "error")).withColumn("ok", F.col("kind") == "purchase")
    return R.judged(m, v, ["phrase", "product"])


@query(f"""WITH {CATALOGUE_SQL}, r AS (SELECT id AS request, CASE WHEN id % 3 = 0 THEN 'tray [C' || (id % 1100) || ']' ELSE 'tray' END AS phrase FROM cat),
k AS (SELECT request, regexp_extract(phrase, '.*\\[([^\\]\\[]{{2,40}})\\]', 1) AS code FROM r)
SELECT k.request, min(c.id) AS id, CASE WHEN code = '' THEN 'open' WHEN count(c.id) > 0 THEN 'model' ELSE 'placeholder' END AS state
FROM k LEFT JOIN cat c ON code <> '' AND lower(c.model) = lower(code) GROUP BY k.request, code""")
def explicit_code_gate(spark, sf):
    """A code in brackets must be a model of the catalogue; without one the line stays a placeholder."""
    c = catalogue(spark, sf)
    phrase = F.when(F.col("id") % 3 == 0, F.concat(F.lit("tray [C"), (F.col("id") % 1100).cast("string"), F.lit("]"))).otherwise("tray")
    code = F.nullif(F.regexp_extract(phrase, r".*\[([^\]\[]{2,40})\]", 1), F.lit(""))
    models = c.groupBy(F.lower("model").alias("key")).agg(F.min("id").alias("id"))
    rows = c.select(F.col("id").alias("request"), F.lower(code).alias("key")).join(models, "key", "left")
    return rows.select("request", "id", F.when(F.col("key").isNull(), "open").when(F.col("id").isNotNull(), "model").otherwise("placeholder").alias("state"))


@query(f"""WITH {ASKED_SQL}, s AS (SELECT request, phrase, (SELECT product FROM cat c WHERE c.id = (request * 7) % (SELECT count(*) FROM cat)) AS guess FROM asked),
h AS (SELECT request, guess, list_reverse({CORE.format('phrase')})[1:2] AS heads, {CORE.format('guess')} AS words FROM s)
SELECT request, guess, len(list_filter(heads, lambda h: len(list_filter(words, lambda b: contains(b, h) OR contains(h, b))) > 0)) > 0 AS related FROM h""")
def synonym_veto(spark, sf):
    """A guessed product is used only where one of the request's last two words and one of its words contain each other."""
    c = catalogue(spark, sf)
    rows = asked(c).join(F.broadcast(c.agg(F.count("*").alias("n"))), F.lit(True))
    rows = rows.withColumn("key", F.col("request") * 7 % F.col("n")).join(c.select(F.col("id").alias("key"), F.col("product").alias("guess")), "key", "left")
    heads, words = F.slice(F.reverse(R.core_words(F.col("phrase"))), 1, 2), R.core_words(F.col("guess"))
    return rows.select("request", "guess", F.exists(heads, lambda h: F.exists(words, lambda b: F.contains(b, h) | F.contains(h, b))).alias("related"))


# ---------------------------------------------------------------- text rules


@query(f"""WITH {CATALOGUE_SQL}, t AS (SELECT id, brand, brand || '-SM' || id || '-' || product || CASE WHEN id % 4 = 0 THEN '-50LTR Lid' ELSE '' END AS name FROM cat),
s AS (SELECT id, name, brand, list_filter(regexp_split_to_array(lower(name), '\\s*-\\s*'), lambda x: trim(x) <> '') AS l FROM t),
k AS (SELECT *, list_transform(l, lambda x: trim(x) = lower(trim(brand)) OR (regexp_matches(x, '[0-9]') AND NOT regexp_matches(trim(x), '\\s'))) AS drop_ FROM s)
SELECT id, array_to_string(l[coalesce(list_position(drop_, false), len(l)):], ' ') AS human FROM k""")
def human_names(spark, sf):
    c = catalogue(spark, sf)
    name = F.concat("brand", F.lit("-SM"), F.col("id").cast("string"), F.lit("-"), "product", F.when(F.col("id") % 4 == 0, "-50LTR Lid").otherwise(""))
    return c.select("id", R.human_name(name, F.col("brand")).alias("human"))


@query(rf"""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), m AS (SELECT doc_id, t,
  list_filter(list_transform(regexp_extract_all(t, '[a-z0-9][a-z0-9\-/.]+'), lambda w: regexp_replace(w, '[./-]+$', '')),
    lambda w: regexp_matches(w, '[0-9]') AND regexp_matches(w, '[a-z]') AND NOT regexp_matches(w, '{R.SIZE_TOKEN}')) AS models,
  array_to_string(regexp_extract_all(t, '{R.DIMENSIONS}'), '|') AS dims FROM t)
SELECT doc_id, array_to_string(models, ' ') AS models, array_to_string(list_filter(regexp_extract_all(t, '[0-9]{{3,}}'), lambda n: NOT contains(dims, n)), ' ') AS numbers,
  array_to_string(regexp_extract_all(t, '\b([0-9]{{6,8}})\b', 1), ' ') AS hsn FROM m""")
def code_tokens(spark, sf):
    models, numbers, hsn = R.code_tokens(F.coalesce("text", F.lit("")))
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(models, " ").alias("models"), F.array_join(numbers, " ").alias("numbers"), F.array_join(hsn, " ").alias("hsn"))


@query(rf"""WITH s AS (SELECT event_id, 'item ' || repeat('word ', 6 + event_id % 20) || (event_id % 9) || ' ltr deep ' || (event_id % 70 + 10) || 'x20 and ' || (event_id % 9) || ' ltr' AS t FROM events),
w AS (SELECT event_id, list_filter(regexp_split_to_array(lower(t), '[ \t\n\r]+'), lambda x: x <> '') AS l FROM s),
k AS (SELECT event_id, array_to_string(l[1:20], ' ') AS head, regexp_extract_all(array_to_string(l, ' '), '{R.SIZES}') AS sizes FROM w),
f AS (SELECT event_id, head, list_filter(list_filter(sizes, lambda x, i: list_position(sizes, x) = i), lambda x: NOT contains(head, x))[1:4] AS lost FROM k)
SELECT event_id, head || CASE WHEN len(lost) > 0 THEN ' ' || array_to_string(lost, ' ') ELSE '' END AS term FROM f""")
def term_with_sizes(spark, sf):
    i = F.col("event_id")
    s = lambda x: x.cast("string")
    size = F.concat(s(i % 9), F.lit(" ltr"))
    t = F.concat(F.lit("item "), F.call_function("repeat", F.lit("word "), (6 + i % 20).cast("int")), size, F.lit(" deep "), s(i % 70 + 10), F.lit("x20 and "), size)
    return table(spark, sf, "events").select("event_id", R.term_with_sizes(t).alias("term"))


@query(f"""WITH {CATALOGUE_SQL}, names AS (SELECT lower(product) AS name FROM cat UNION ALL SELECT lower(replace(product, ' ', '')) FROM cat WHERE file_name = 'file5'),
v AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(name, ' ')) AS w FROM names) GROUP BY w),
r AS (SELECT id AS request, split_part(lower(product), ' ', 1) AS a, split_part(lower(product), ' ', 2) AS b FROM cat WHERE file_name IN ('file5', 'file6')),
p AS (SELECT request, b, a, b || a AS j FROM r)
SELECT request, CASE WHEN n >= 2 AND NOT EXISTS (SELECT 1 FROM names WHERE name = b || ' ' || a) THEN j ELSE b || ' ' || a END AS phrase FROM p LEFT JOIN v ON w = j""")
def compound_words(spark, sf):
    c = catalogue(spark, sf)
    low, word = F.lower("product"), lambda i: F.split_part(F.lower("product"), F.lit(" "), F.lit(i))
    names = c.select(low.alias("name")).unionByName(c.filter("file_name = 'file5'").select(F.replace(low, F.lit(" "), F.lit("")).alias("name")))
    asks = c.filter("file_name in ('file5', 'file6')").select(F.col("id").alias("request"), F.concat_ws(" ", word(2), word(1)).alias("phrase"))
    return R.merge_compounds(asks, names)


@query(f"""WITH {CATALOGUE_SQL}, p AS (SELECT id, split_part(product, ' ', 2) AS head, product || ' ' || size || CASE WHEN id % 2 = 0 THEN ' CM' ELSE '.0cm' END AS name, size FROM cat),
r AS (SELECT id AS request, head, size FROM p WHERE id % 7 = 1)
SELECT r.request, p.id FROM r JOIN p USING (head) WHERE regexp_matches(replace(lower(name), ' ', ''), '(^|[^0-9.])' || r.size || '(\\.0)?cm')""")
def hard_qualifiers(spark, sf):
    """Candidates that carry every size and code that a request names."""
    c = catalogue(spark, sf)
    size = F.col("size").cast("string")
    p = c.select("id", F.split_part("product", F.lit(" "), F.lit(2)).alias("head"), F.concat("product", F.lit(" "), size, F.when(F.col("id") % 2 == 0, " CM").otherwise(".0cm")).alias("name"))
    r = c.filter("file_name = 'file1'").select(F.col("id").alias("request"), F.split_part("product", F.lit(" "), F.lit(2)).alias("head"), F.concat_ws(" ", "product", F.concat(size, F.lit("cm"))).alias("phrase"))
    return R.carrying(r, p)


@query(f"""WITH {CATALOGUE_SQL}, r AS (SELECT brand AS request, id, product || ' ' || size || 'cm' AS name, min(size) OVER (PARTITION BY brand) AS n FROM cat),
h AS (SELECT *, brand_hit FROM (SELECT request, id, regexp_matches(name, '(^|[^0-9.])' || (n + 1) || 'cm') AS brand_hit FROM r))
SELECT request, id FROM h QUALIFY brand_hit OR NOT bool_or(brand_hit) OVER (PARTITION BY request)""")
def soft_size_hint(spark, sf):
    c = catalogue(spark, sf)
    rows = c.select(F.col("brand").alias("request"), "id", F.concat_ws(" ", "product", F.concat(F.col("size").cast("string"), F.lit("cm"))).alias("name"))
    hint = c.groupBy(F.col("brand").alias("request")).agg(F.concat(F.lit("(^|[^0-9.])"), (F.min("size") + 1).cast("string"), F.lit("cm")).alias("pattern"))
    return R.soft_narrow(rows.join(hint, "request"), F.regexp_like("name", "pattern")).select("request", "id")


ONES = "[" + ",".join(f"'{x}'" for x in R._ONES) + "]"
TENS = "[" + ",".join(f"'{x}'" for x in R._TENS) + "]"
TWO = f"(CASE WHEN ({{0}}) < 20 THEN {ONES}[({{0}}) + 1] ELSE trim({TENS}[({{0}}) // 10 + 1] || ' ' || {ONES}[({{0}}) % 10 + 1]) END)"
THREE = f"trim(CASE WHEN ({{0}}) >= 100 THEN {ONES}[({{0}}) // 100 % 10 + 1] || ' hundred ' ELSE '' END || {TWO.format('({0}) % 100')})"
PART = "CASE WHEN {0} > 0 THEN {1} || ' {2} ' ELSE '' END"


@query(f"""WITH n AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n = 0 THEN 'zero' ELSE trim({PART.format('n // 10000000', THREE.format('n // 10000000'), 'crore')} || {PART.format('n % 10000000 // 100000', TWO.format('n % 10000000 // 100000'), 'lakh')}
  || {PART.format('n % 100000 // 1000', TWO.format('n % 100000 // 1000'), 'thousand')} || {THREE.format('n % 1000')}) END AS words FROM n""")
def amount_in_words(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", R.amount_words(F.col("o_totalprice") * 100).alias("words"))


@query("""WITH t AS (SELECT o_orderkey, 'Quote ' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '_V' || (o_orderkey % 12) END AS name FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(name, '_V[0-9]+$') THEN regexp_replace(name, '_V[0-9]+$', '') || '_V' || (CAST(regexp_extract(name, '_V([0-9]+)$', 1) AS INT) + 1) ELSE name || '_V2' END AS name FROM t""")
def version_bump(spark, sf):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("Quote "), F.col("o_custkey").cast("string"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("_V"), (k % 12).cast("string"))))
    return table(spark, sf, "orders").select("o_orderkey", R.bump_version(name).alias("name"))


@query(f"""WITH {CATALOGUE_SQL} SELECT id, substr(product, 1, 1) || substr(product, 3, 1) || substr(product, 2, 1) || substr(product, 4) AS typo,
  array_to_string(list_reverse(string_split(product, ' ')), ' ') AS shuffled, left(model, greatest(2, length(model) - 1)) AS code_prefix, size || 'cm' AS tight, size || ' cm' AS spaced FROM cat""")
def perturbations(spark, sf):
    """Requests made wrong on purpose, by fixed rules, for evaluation."""
    c, sub = catalogue(spark, sf), F.substring
    typo = F.concat(sub("product", 1, 1), sub("product", 3, 1), sub("product", 2, 1), F.substr("product", F.lit(4)))
    size = F.col("size").cast("string")
    return c.select(
        "id", typo.alias("typo"), F.array_join(F.reverse(F.split("product", " ")), " ").alias("shuffled"),
        F.left("model", F.greatest(F.lit(2), F.length("model") - 1)).alias("code_prefix"), F.concat(size, F.lit("cm")).alias("tight"), F.concat(size, F.lit(" cm")).alias("spaced"),
    )


@query(f"""WITH {CATALOGUE_SQL}, k AS (SELECT unnest(['widget', 'gear', 'cold', 'steel']) AS w), s AS (
  SELECT id, product, price, sum(CASE WHEN contains(lower(product), w) THEN 10 ELSE 0 END + CASE WHEN contains(lower(spec), w) OR contains(lower(brand), w) THEN 1 ELSE 0 END) AS score FROM cat, k GROUP BY ALL)
SELECT id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0 ORDER BY score DESC, price > 0 DESC, id LIMIT 30""")
def keyword_relevance(spark, sf):
    c = catalogue(spark, sf)
    words = ["widget", "gear", "cold", "steel"]
    one = lambda w: F.when(F.lower("product").contains(w), 10).otherwise(0) + F.when(F.lower("spec").contains(w) | F.lower("brand").contains(w), 1).otherwise(0)
    score = sum((one(w) for w in words[1:]), one(words[0])).cast("long")
    return c.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), (F.col("price") > 0).desc(), "id").limit(30).select("id", "score")


# ---------------------------------------------------------------- changes, alignment, history


@query(f"""WITH {CATALOGUE_SQL}, n AS (SELECT count(*) AS n FROM cat), e AS (SELECT user_id % n AS id, arg_max(user_id, (ts, event_id)) AS who, arg_max(CAST(value - 50 AS DECIMAL(18,2)), (ts, event_id)) AS after FROM events, n GROUP BY 1)
SELECT id, who, CAST(price AS DOUBLE) AS before, CAST(after AS DOUBLE) AS after, CASE WHEN after < 0 THEN 'refused' WHEN after IS NOT DISTINCT FROM price THEN 'same' ELSE 'changed' END AS state FROM e JOIN cat USING (id)""")
def price_edit_audit(spark, sf):
    c = catalogue(spark, sf)
    e = table(spark, sf, "events").join(F.broadcast(c.agg(F.count("*").alias("n"))), F.lit(True))
    e = e.select((F.col("user_id") % F.col("n")).alias("id"), F.col("user_id").alias("who"), (F.col("value") - 50).cast("decimal(18,2)").alias("price"), "ts", "event_id")
    return doubles(R.price_edits(c, e), "before", "after")


@query("""WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS pos, l_partkey AS part, l_suppkey AS supp FROM lineitem),
d AS (SELECT doc, pos, min(part) AS part, min(supp) AS supp FROM l GROUP BY doc, pos),
s AS (SELECT doc, pos, CASE WHEN doc % 3 <> 0 THEN doc || '-' || pos END AS key FROM d), a AS (SELECT doc, pos, part AS value, CASE WHEN doc % 3 <> 0 THEN doc || '-' || pos END AS key FROM d WHERE part % 4 <> 0 OR doc % 2 = 0),
so AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS at, count(*) OVER (PARTITION BY doc) AS n FROM s WHERE key IS NULL),
ao AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS at, count(*) OVER (PARTITION BY doc) AS n FROM a WHERE key IS NULL)
SELECT s.doc, s.pos, s.key, a.value, CASE WHEN a.value IS NULL THEN 'none' ELSE 'key' END AS how FROM s LEFT JOIN a ON a.key = s.key WHERE s.key IS NOT NULL
UNION ALL SELECT so.doc, so.pos, so.key, ao.value, CASE WHEN ao.value IS NULL THEN 'none' ELSE 'place' END FROM so LEFT JOIN ao ON ao.doc = so.doc AND ao.at = so.at AND ao.n = so.n""")
def aligned_answers(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos")).agg(F.min("l_partkey").alias("value"))
    d = d.withColumn("key", F.when(F.col("doc") % 3 != 0, F.concat_ws("-", F.col("doc").cast("string"), F.col("pos").cast("string"))))
    return R.aligned(d.drop("value"), d.filter("value % 4 <> 0 or doc % 2 = 0"))


@query()
def look_ahead_merge(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    d = d.groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("pos")).agg(F.min("p_name").alias("label"))
    answers = d.filter("(doc + pos) % 3 <> 0").withColumn("label", F.concat("label", F.lit(" ok")))
    return R.look_ahead(d.withColumn("side", F.lit(0)).unionByName(answers.withColumn("side", F.lit(1))))


@query(f"""WITH {CATALOGUE_SQL}, b AS (SELECT file_name, id, row_number() OVER (PARTITION BY file_name ORDER BY id) AS k FROM cat WHERE cost IS NULL),
i AS (SELECT file_name, id AS image, row_number() OVER (PARTITION BY file_name ORDER BY id) AS k FROM cat WHERE id % 9 = 4)
SELECT b.id, i.image FROM b LEFT JOIN i ON i.file_name = b.file_name AND i.k = b.k""")
def leftover_images(spark, sf):
    """Images that are left go to rows without one, in order, within a file."""
    c = catalogue(spark, sf)
    place = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy("file_name").orderBy("id")))
    images = place(c.filter("id % 9 = 4").select("file_name", "id")).withColumnRenamed("id", "image")
    return place(c.filter("cost is null").select("file_name", "id")).join(images, ["file_name", "k"], "left").select("id", "image")


@query(f"""WITH {LINES_SQL}, open_ AS (SELECT DISTINCT quote FROM lines WHERE section LIKE '_O')
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS quote, count(*) AS complete FROM orders WHERE o_orderkey NOT IN (SELECT quote FROM open_) GROUP BY o_custkey""")
def prior_quote(spark, sf):
    """Newest quote of each source that has nothing pending."""
    o = table(spark, sf, "orders")
    pending = quote_lines(spark, sf).filter(F.col("section").endswith("O")).select(F.col("quote").alias("o_orderkey")).distinct()
    rows = o.join(pending, "o_orderkey", "left_anti").groupBy("o_custkey")
    return rows.agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("quote"), F.count("*").alias("complete"))


@query(f"WITH {LINES_SQL}, {CATALOGUE_SQL} SELECT DISTINCT quote FROM lines WHERE part IN (SELECT id FROM cat WHERE model = 'C7')")
def basket_semi_join(spark, sf):
    picked = catalogue(spark, sf).filter("model = 'C7'").select(F.col("id").alias("part"))
    return quote_lines(spark, sf).join(picked, "part", "left_semi").select("quote").distinct()


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'c' || o_custkey || '@x.example' END AS email, upper(c_name) AS name FROM orders JOIN customer ON c_custkey = o_custkey),
p AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'c' || c_custkey || '@x.example' END AS email, c_name FROM customer WHERE c_custkey % 5 <> 0)
SELECT o_orderkey, coalesce(a.c_custkey, b.c_custkey) AS person FROM r LEFT JOIN p a ON a.email = r.email LEFT JOIN p b ON lower(b.c_name) = lower(r.name)""")
def sales_person(spark, sf):
    """A person by e-mail, else by name in any case."""
    c, mail = table(spark, sf, "customer"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.example"))
    r = table(spark, sf, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"))
    r = r.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, mail).alias("email"), F.lower(F.upper("c_name")).alias("name"))
    p = c.filter("c_custkey % 5 <> 0")
    by_mail, by_name = p.filter("c_custkey % 4 = 0").select(mail.alias("email"), F.col("c_custkey").alias("a")), p.select(F.lower("c_name").alias("name"), F.col("c_custkey").alias("b"))
    return r.join(by_mail, "email", "left").join(by_name, "name", "left").select("o_orderkey", F.coalesce("a", "b").alias("person"))


# ---------------------------------------------------------------- listings, projections, aggregates


@query(f"WITH {CATALOGUE_SQL} SELECT id, file_name, product, model FROM cat ORDER BY file_name, product, id")
def full_listing(spark, sf):
    return catalogue(spark, sf).select("id", "file_name", "product", "model").orderBy("file_name", "product", "id")


@query(f"WITH {CATALOGUE_SQL} SELECT id, product, model AS model_no, CAST(price AS DOUBLE) AS price, coalesce(gst, 18) AS tax FROM cat")
def result_projection(spark, sf):
    """Working keys (with a leading _) go, names are those of a result, a missing tax is 18 and zero stays."""
    c = catalogue(spark, sf).withColumns({"_score": F.lit(1), "_tier": F.lit("name")})
    c = c.select(*[x for x in c.columns if not x.startswith("_")])
    return doubles(c.select("id", "product", F.col("model").alias("model_no"), "price", F.coalesce("gst", F.lit(18)).alias("tax")), "price")


@query(f"""WITH {LINES_SQL} SELECT CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'draft' END AS bucket, count(*) AS quotes, count(*) FILTER (o_orderkey IN (SELECT quote FROM lines WHERE price > 50000)) AS client_priced FROM orders GROUP BY 1""")
def repository_split(spark, sf):
    priced = quote_lines(spark, sf).filter("price > 50000").select(F.col("quote").alias("o_orderkey"), F.lit(1).alias("p")).distinct()
    o = table(spark, sf, "orders").join(priced, "o_orderkey", "left")
    return o.groupBy(F.when(F.col("o_orderstatus") == "F", "approved").otherwise("draft").alias("bucket")).agg(F.count("*").alias("quotes"), F.count("p").alias("client_priced"))


@query("SELECT o_orderpriority AS file_name, count(*) AS n, CAST(max(o_orderdate) AS DATE) AS newest FROM orders GROUP BY 1 ORDER BY newest DESC, 1")
def imports_by_file(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("file_name")).agg(F.count("*").alias("n"), F.to_date(F.max("o_orderdate")).alias("newest"))
    return g.orderBy(F.desc("newest"), "file_name")


@query(f"WITH {CATALOGUE_SQL} SELECT brand, count(*) AS n FROM cat GROUP BY brand ORDER BY n DESC, brand LIMIT 6")
def top_groups(spark, sf):
    return catalogue(spark, sf).groupBy("brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "brand").limit(6)


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS t FROM events GROUP BY 1),
c AS (SELECT day, t * 3 AS cost, sum(t * 3) OVER (PARTITION BY date_trunc('month', day)) AS month_cost, sum(t * 3) OVER () AS lifetime FROM d)
SELECT day, CAST(cost AS BIGINT) AS cost, CAST(month_cost AS BIGINT) AS month_cost, CAST(lifetime AS BIGINT) AS lifetime, CAST(100000000 - month_cost AS BIGINT) AS remaining, round(month_cost * 100.0 / 100000000, 4) AS used FROM c""")
def usage_cost(spark, sf):
    """Cost a day, month and in all (in hundredths), what is left of a month's budget and its used percent."""
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) * 3).alias("cost"))
    month = d.groupBy(F.trunc("day", "month").alias("m")).agg(F.sum("cost").alias("month_cost"))
    rows = d.withColumn("m", F.trunc("day", "month")).join(month, "m").join(F.broadcast(d.agg(F.sum("cost").alias("lifetime"))), F.lit(True))
    return rows.select("day", "cost", "month_cost", "lifetime", (F.lit(100000000) - F.col("month_cost")).alias("remaining"), F.round(F.col("month_cost") * 100.0 / 100000000, 4).alias("used"))


@query(f"WITH {CATALOGUE_SQL} SELECT file_name, count(*) AS n, count(*) FILTER (trim(category) <> '') AS done, round(100.0 * count(*) FILTER (trim(category) <> '') / count(*), 4) AS percent FROM cat GROUP BY file_name")
def categorised_share(spark, sf):
    done = F.count_if(F.trim("category") != "")
    return catalogue(spark, sf).groupBy("file_name").agg(F.count("*").alias("n"), done.alias("done"), F.round(100.0 * done / F.count("*"), 4).alias("percent"))


@query(f"""WITH {CATALOGUE_SQL}, w AS (SELECT id, unnest(string_split(product, ' ')) AS family FROM cat), t AS (SELECT family, count(DISTINCT id) AS true_n FROM w GROUP BY family)
SELECT family, true_n, least(true_n, 50) AS shown FROM t WHERE least(true_n, 50) < 0.5 * true_n""")
def family_coverage(spark, sf):
    """Word families of which a list of 50 shows less than half."""
    w = catalogue(spark, sf).select("id", F.explode(F.split("product", " ")).alias("family"))
    t = w.groupBy("family").agg(F.countDistinct("id").alias("true_n")).withColumn("shown", F.least("true_n", F.lit(50).cast("long")))
    return t.filter("shown < 0.5 * true_n")


@query(f"""WITH {CATALOGUE_SQL}, best AS (SELECT lower(model) AS key, min(id) AS got FROM cat GROUP BY 1), s AS (
  SELECT 'plain' AS style, id, product, lower(model) AS code FROM cat UNION ALL SELECT 'signs', id, product, lower(replace(model, 'C', 'C-')) FROM cat UNION ALL SELECT 'cut', id, product, lower(left(model, 2)) FROM cat),
k AS (SELECT style, id, product, got FROM s LEFT JOIN best ON key = regexp_replace(code, '[^a-z0-9]', '', 'g'))
SELECT style, count(*) AS asked, count(*) FILTER (got = k.id) AS strict, count(*) FILTER (c.product = k.product) AS fair FROM k LEFT JOIN cat c ON c.id = got GROUP BY style""")
def accuracy_by_style(spark, sf):
    """Share of code requests that find their product (strict) or an equally named one (fair), by style of typing."""
    c = catalogue(spark, sf)
    styles = {"plain": F.col("model"), "signs": F.replace("model", F.lit("C"), F.lit("C-")), "cut": F.left("model", F.lit(2))}
    rows = c.select("id", "product", F.inline(F.array(*[F.struct(F.lit(n).alias("style"), match.X.norm_model(m).alias("key")) for n, m in styles.items()])))
    best = c.groupBy(match.X.norm_model(F.col("model")).alias("key")).agg(F.min("id").alias("got"))
    rows = rows.join(best, "key", "left").join(c.select(F.col("id").alias("got"), F.col("product").alias("name")), "got", "left")
    return rows.groupBy("style").agg(F.count("*").alias("asked"), F.count_if(F.col("got") == F.col("id")).alias("strict"), F.count_if(F.col("name") == F.col("product")).alias("fair"))


@query(f"WITH {CATALOGUE_SQL} SELECT file_name, count(*) AS n, count(*) FILTER (id % 3 = 0) AS exact, count(*) FILTER (id % 3 = 1) AS guessed, count(*) FILTER (id % 3 = 2) AS missing, count(*) FILTER (price > 0) AS priced FROM cat GROUP BY file_name")
def import_stats(spark, sf):
    image = F.element_at(F.array(F.lit("exact"), F.lit("guessed"), F.lit("missing")), (F.col("id") % 3 + 1).cast("int"))
    c = catalogue(spark, sf).withColumn("image", image)
    return c.groupBy("file_name").agg(F.count("*").alias("n"), *[F.count_if(F.col("image") == k).alias(k) for k in ("exact", "guessed", "missing")], F.count_if(F.col("price") > 0).alias("priced"))


@query(f"WITH {CATALOGUE_SQL} SELECT id FROM cat ORDER BY md5(CAST(id AS VARCHAR)) LIMIT 40")
def fixed_sample(spark, sf):
    """A sample that every run draws alike."""
    return catalogue(spark, sf).orderBy(F.md5(F.col("id").cast("string").cast("binary"))).limit(40).select("id")


@query(f"""WITH {CATALOGUE_SQL}, w AS (SELECT DISTINCT file_name, unnest(string_split(product, ' ')) AS w FROM cat)
SELECT w, 'both' AS kind FROM w WHERE file_name = 'file0' AND w IN (SELECT w FROM w WHERE file_name = 'file1') UNION ALL
SELECT w, 'first' FROM w WHERE file_name = 'file0' AND w NOT IN (SELECT w FROM w WHERE file_name = 'file1')""")
def term_sets(spark, sf):
    w = catalogue(spark, sf).select("file_name", F.explode(F.split("product", " ")).alias("w"))
    a, b = (w.filter(F.col("file_name") == f).select("w") for f in ("file0", "file1"))
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.subtract(b).withColumn("kind", F.lit("first")))


@query(f"WITH {LINES_SQL} SELECT section, min(quote * 10 + pos) AS first_at, row_number() OVER (ORDER BY min(quote * 10 + pos), section) AS place FROM lines GROUP BY section")
def sections_in_order(spark, sf):
    """Distinct sections in first-seen order."""
    g = quote_lines(spark, sf).groupBy("section").agg(F.min(F.col("quote") * 10 + F.col("pos")).alias("first_at"))
    return g.withColumn("place", F.row_number().over(Window.orderBy("first_at", "section")))  # a few distinct sections


@query(f"""WITH {PRICED_SQL}, b AS (SELECT brand, sum(amount) AS amount, CAST(right(brand, 1) AS INT) AS p FROM priced WHERE known GROUP BY brand)
SELECT count(*) AS brands, CAST(sum(amount) AS DOUBLE) AS amount, round(CAST(sum(amount * p) AS DOUBLE) / CAST(sum(amount) AS DOUBLE), 6) AS percent FROM b""")
def weighted_discount(spark, sf):
    """The percent off in all, weighed by the amounts of the brands."""
    rows = pricing.priced_lines(quote_lines(spark, sf), catalogue(spark, sf)).filter("known")
    b = rows.groupBy("brand").agg(F.sum("amount").alias("amount")).withColumn("p", F.right("brand", F.lit(1)).cast("int"))
    out = b.agg(F.count("*").alias("brands"), F.sum("amount").alias("amount"), F.sum(F.col("amount") * F.col("p")).alias("off"))
    return doubles(out, "amount", "off").select("brands", "amount", F.round(F.col("off") / F.col("amount"), 6).alias("percent"))


@query()
def tokens_covered(spark, sf):
    c = catalogue(spark, sf)
    return match.covering(asked(c).select(F.explode(F.split("phrase", " ")).alias("word")).distinct(), c)
