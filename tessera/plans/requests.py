"""Queries of request texts made from whole tables: units, price limits, sizes, and lists that are typed or pasted."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.plans.registry import query
from tessera.sources.catalogue import table

#: A text for each order; the same expression runs in both engines.
TEXT = """CASE o_orderkey % 17 WHEN 0 THEN 'Kettle ' || CAST(o_custkey % 9 + 1 AS STRING) || '.50 Litres' WHEN 1 THEN 'ice box ' || CAST(o_custkey % 40 AS STRING) || '.0 ltr'
  WHEN 2 THEN 'jug ' || CAST(o_custkey % 900 AS STRING) || ' ml, 5 oz' WHEN 3 THEN 'urn between 1,' || CAST(100 + o_custkey % 800 AS STRING) || ' and 2k' WHEN 4 THEN 'tray under rs. ' || CAST(o_custkey AS STRING)
  WHEN 5 THEN 'tray >= ' || CAST(o_custkey % 50 AS STRING) || 'k' WHEN 6 THEN 'half size food pan 2 ltrs ' || CAST(o_custkey % 90 AS STRING) || '.0 mm' WHEN 7 THEN 'box ' || CAST(10 + o_custkey % 900 AS STRING) || ' x 200 mm'
  WHEN 8 THEN 'crate 12 lt 30 cl ' || CAST(o_custkey % 40 AS STRING) || ' cm' WHEN 9 THEN 'plate ' || CAST(o_custkey % 12 + 1 AS STRING) || '.5 inch' WHEN 10 THEN 'Full Size Chafing Dish 9 Ltr'
  WHEN 11 THEN 'cups 200 to ' || CAST(o_custkey AS STRING) WHEN 12 THEN 'double walled bowl, a dozen, 6 ounces, max ' || CAST(o_custkey AS STRING) WHEN 13 THEN 'thunder ' || CAST(o_custkey AS STRING)
  WHEN 14 THEN 'scraper ' || CAST(o_custkey % 9 + 1 AS STRING) || '"' WHEN 15 THEN 'over 10 and under ' || CAST(o_custkey AS STRING) || ' plain' ELSE 'pan 2 qt 1.25 l quarter lid' END"""
_UNIT = r"regexp_replace(regexp_replace(s, '(\d+(?:\.\d+)?)\s*(litres?|liters?|ltrs?|lt)\b', '\1l', 'gi'), '(\d+)\.0\s*(l|ml|kw|w|v|hz|mm|cm|kg)\b', '\1\2', 'gi')"


def _fractions(s: str) -> str:
    for word, part in X.FRACTIONS.items():
        s = rf"regexp_replace({s}, '\b{word}[\s-]+size\b', '{part}', 'gi')"
    for word, part in list(X.FRACTIONS.items())[1:]:
        s = rf"regexp_replace({s}, '\b{word}\b', '{part}', 'gi')"
    return s


def texts(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(TEXT).alias("s"))


@query(rf"""WITH t AS (SELECT o_orderkey AS id, {TEXT} AS s FROM orders), u AS (SELECT id, {_UNIT} AS s FROM t),
p AS (SELECT id, CASE WHEN regexp_matches(s, '{X.PANS}') AND NOT regexp_matches(s, '{X.NO_PANS}') THEN {_fractions('s')} ELSE s END AS s FROM u)
SELECT id, regexp_replace(regexp_replace(regexp_replace(s, '\bdouble[\s-]*wall(?:ed)?\b', 'dw', 'gi'), '\bdozen\b', 'dz', 'gi'), '\bounces?\b', 'oz', 'gi') AS s FROM p""")
def unit_normalise(spark, sf):
    return texts(spark, sf).select("id", X.norm_units(F.col("s")).alias("s"))


def _number(pattern: str, group: int, s: str) -> str:
    x = lambda g: f"regexp_extract({s}, '(?i){pattern}', {g})"
    return f"TRY_CAST(nullif(replace({x(group)}, ',', ''), '') AS DOUBLE) * CASE WHEN {x(group + 1)} <> '' THEN 1000 ELSE 1 END"


def limits_sql(source: str) -> str:
    """CTEs from ``source`` (id, s) to limits (id, clean, low, high)."""
    a, b = X.RANGES
    got = lambda p, s="s": f"regexp_extract({s}, '(?i){p}', 0)"
    return f"""hits AS (SELECT *, CASE WHEN {got(a)} <> '' THEN {got(a)} ELSE {got(b)} END AS hit, coalesce({_number(a, 1, 's')}, {_number(b, 1, 's')}) AS x, coalesce({_number(a, 3, 's')}, {_number(b, 3, 's')}) AS y,
  CASE WHEN {got(X.AT_MOST)} <> '' THEN replace(s, {got(X.AT_MOST)}, ' ') ELSE s END AS rest FROM {source}),
limits AS (SELECT * EXCLUDE (hit, x, y, rest), trim(regexp_replace(CASE WHEN hit <> '' THEN replace(s, hit, ' ') WHEN {got(X.AT_LEAST, 'rest')} <> '' THEN replace(rest, {got(X.AT_LEAST, 'rest')}, ' ') ELSE rest END, '\\s+', ' ', 'g'), ' ,.-') AS clean,
  CASE WHEN hit <> '' THEN least(x, y) ELSE {_number(X.AT_LEAST, 1, 'rest')} END AS low, CASE WHEN hit <> '' THEN greatest(x, y) ELSE {_number(X.AT_MOST, 1, 's')} END AS high FROM hits)"""


@query(f"WITH t AS (SELECT o_orderkey AS id, {TEXT} AS s FROM orders), {limits_sql('t')} SELECT id, clean, low, high FROM limits")
def price_constraint(spark, sf):
    clean, low, high = X.price_limits(F.col("s"))
    return texts(spark, sf).select("id", clean.alias("clean"), low.alias("low"), high.alias("high"))


_ML = "CASE u " + " ".join(f"WHEN '{u}' THEN {v}" for u, v in X.CAPACITY.items()) + " END"


def facts_sql(name: str, source: str) -> str:
    """CTE ``name``: id and the sorted facts caps, lens, areas of ``source`` (id, s)."""
    inches = X.INCHES.replace("'", "''")
    # RE2 has no lookaround here; every pattern is the same text.
    each = lambda p, g: f"unnest(regexp_extract_all(lower(s), '{p}', {g}))"
    return f"""{name}_c AS (SELECT id, list_sort(list(DISTINCT round_even(v::double * {_ML}, 0)::bigint)) AS caps FROM (SELECT id, {each(X.CAPACITIES, 1)} AS v, {each(X.CAPACITIES, 2)} AS u FROM {source}) GROUP BY id),
{name}_l AS (SELECT id, list_sort(list(DISTINCT mm)) AS lens FROM (SELECT id, round_even(v::double * CASE WHEN u = 'cm' THEN 10 ELSE 1 END, 0)::bigint AS mm FROM (SELECT id, {each(X.LENGTHS, 1)} AS v, {each(X.LENGTHS, 2)} AS u FROM {source})
  UNION ALL SELECT id, round_even(v::double * 25.4, 0)::bigint FROM (SELECT id, {each(inches, 1)} AS v FROM {source})) GROUP BY id),
{name} AS (SELECT t.id, coalesce(caps, []) AS caps, coalesce(lens, []) AS lens, list_sort(list_distinct(regexp_extract_all(replace(lower(s), ' ', ''), '{X.AREAS}'))) AS areas
  FROM {source} t LEFT JOIN {name}_c USING (id) LEFT JOIN {name}_l USING (id))"""


_JOINED = "array_to_string(list_transform({0}, lambda x: x::varchar), ' ')"


@query(f"WITH t AS (SELECT o_orderkey AS id, {TEXT} AS s FROM orders), {facts_sql('f', 't')} SELECT id, {_JOINED.format('caps')} AS ml, {_JOINED.format('lens')} AS mm, array_to_string(areas, ' ') AS areas FROM f")
def size_facts(spark, sf):
    ml, mm, areas = X.size_facts(F.col("s"))
    return texts(spark, sf).select("id", *[F.array_join(x.cast("array<string>"), " ").alias(n) for x, n in ((ml, "ml"), (mm, "mm"), (areas, "areas"))])


#: What was asked and what was found, for each part.
ASKED = """CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS STRING) || ' ltr' WHEN 1 THEN CAST(p_size AS STRING) || ' cm' WHEN 2 THEN CAST(p_size * 10 AS STRING) || ' x 200' WHEN 3 THEN CAST(p_size AS STRING) || ' oz 19 mm' ELSE 'plain' END"""
FOUND = """CASE p_partkey % 5 WHEN 0 THEN CAST((p_size * 7) % 50 + 1 AS STRING) || ' Litre' WHEN 1 THEN CAST((p_size * 7) % 50 + 1 AS STRING) || '0 mm' WHEN 2 THEN CAST((p_size * 3) % 50 * 10 AS STRING) || 'x200'
  WHEN 3 THEN CAST((p_size * 30) AS STRING) || 'ml 21 cm' ELSE '5 ltr' END"""


def _apart(a: str, b: str, near: float) -> str:
    return f"(len({a}) > 0 AND len({b}) > 0 AND len(list_filter({a}, lambda x: len(list_filter({b}, lambda y: abs(x - y) <= greatest(x, y) * {near})) > 0)) = 0)"


def _class(x: str, low: int, high: int) -> str:
    return f"list_filter({x}, lambda v: v BETWEEN {low} AND {high})"


_PLAIN = "regexp_replace(({0})::varchar, '\\.0$', '')"
_LITRES = "lambda x: CASE WHEN x >= 1000 THEN " + _PLAIN.format("x / 1000.0::double") + " || ' L' ELSE x || ' ml' END"
_METRIC = "lambda x: CASE WHEN x >= 10 THEN " + _PLAIN.format("x / 10.0::double") + " || ' cm' ELSE x || ' mm' END"


def _said(a: str, b: str, how: str) -> str:
    return f"'client asked ' || array_to_string(list_transform({a}, {how}), ' / ') || ' — this is ' || array_to_string(list_transform({b}, {how}), ' / ')"


_NOTES = " ".join(
    f"WHEN {_apart(_class('a.lens', lo, hi), _class('b.lens', lo, hi), X.LENGTH_NEAR)} THEN {_said(_class('a.lens', lo, hi), _class('b.lens', lo, hi), _METRIC)}" for lo, hi in ((401, 10**12), (40, 400), (0, 39))
)


@query(f"""WITH ta AS (SELECT p_partkey AS id, {ASKED} AS s FROM part), tb AS (SELECT p_partkey AS id, {FOUND} AS s FROM part), {facts_sql('fa', 'ta')}, {facts_sql('fb', 'tb')}
SELECT a.id, CASE WHEN {_apart('a.caps', 'b.caps', X.CAPACITY_NEAR)} THEN {_said('a.caps', 'b.caps', _LITRES)} {_NOTES}
  WHEN len(a.areas) > 0 AND len(b.areas) > 0 AND len(list_intersect(a.areas, b.areas)) = 0 THEN 'client asked ' || a.areas[1] || ' — this is ' || b.areas[1] ELSE '' END AS note FROM fa a JOIN fb b USING (id)""")
def size_tolerance(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.size_note(F.expr(ASKED), F.expr(FOUND)).alias("note"))


# ---------------------------------------------------------------- prompts

_LINES = """o_orderkey % 6 AS style, l_linenumber AS n, l_partkey, CAST(l_quantity AS INT) AS qty, p_name"""
_LINE = """CASE style WHEN 0 THEN CAST(qty AS STRING) || ' ' || p_name WHEN 1 THEN p_name || ' ' || CAST(qty AS STRING) WHEN 2 THEN '"' || p_name || ' [C' || CAST(l_partkey % 900 AS STRING) || '-SS]  ' || CAST(qty AS STRING) || ' pcs"'
  WHEN 3 THEN p_name || ' under ' || CAST(qty AS STRING) || '00 x ' || CAST(n AS STRING) WHEN 4 THEN p_name || CASE WHEN l_partkey % 29 = 0 THEN ' for the hotel' ELSE ' 300 x 200 x 70' END ELSE CAST(1000000 + l_partkey AS STRING) END"""


def prompts(spark, sf):
    """(kind, id, s): a list for each order, in six styles, and what every turn of the conversations says."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.selectExpr("o_orderkey", *_LINES.split(", ")).select("o_orderkey", "style", "n", F.expr(_LINE).alias("line"))
    lines = rows.groupBy("o_orderkey", "style").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))
    text = F.when(F.col("style") == 0, F.array_join("lines", ", ")).otherwise(F.array_join("lines", "\n"))
    turns = table(spark, sf, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("s"))
    return lines.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), text.alias("s")).unionByName(turns)


_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_PROMPTS_SQL = f"""raw_ AS (SELECT {_LINES}, o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), typed AS (
  SELECT 'order' AS kind, o_orderkey AS id, CASE WHEN style = 0 THEN string_agg(line, ', ' ORDER BY n, line) ELSE array_to_string(list(line ORDER BY n, line), chr(10)) END AS s FROM (SELECT o_orderkey, style, n, {_LINE} AS line FROM raw_) GROUP BY o_orderkey, style
  UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations)"""
# A dimension that is already glued must not use up the number that the next one starts with.
_GLUE = r"regexp_replace({0}, '(\d\d)(?:\s+[x×*]\s*|\s*[x×*]\s+|[×*])(\d{{2,4}})\b', '\1x\2', 'gi')"
_LINE_SQL = X.LINE.removeprefix("(?i)")


@query(rf"""WITH {_PROMPTS_SQL}, p AS (SELECT kind, id, {_GLUE.format(_GLUE.format(f"trim(s, {_TRIM})"))} AS p FROM typed WHERE s IS NOT NULL),
whole AS (SELECT *, p <> '' AND length(p) <= {X.PROMPT_MOST} AS fits, regexp_matches(p, '^\d{{6,8}}(\s+\d{{1,5}})?$') AS coded, list_filter(list_transform(regexp_split_to_array(p, '\r\n|\n|\r'), lambda x: trim(trim(x, {_TRIM}), '"')), lambda x: x <> '') AS lines,
  list_filter(list_transform(regexp_split_to_array(p, '(?i),|;|\band\b'), lambda x: trim(x, {_TRIM})), lambda x: x <> '') AS pieces FROM p),
line0 AS (SELECT kind, id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS s FROM whole WHERE fits AND NOT coded), {limits_sql('line0')},
line1 AS (SELECT *, CASE WHEN low IS NOT NULL OR high IS NOT NULL THEN clean ELSE s END AS t FROM limits),
line2 AS (SELECT *, regexp_extract(t, '(?i){_LINE_SQL}', 1) AS name, coalesce(nullif(regexp_extract(t, '(?i){_LINE_SQL}', 2), ''), nullif(regexp_extract(t, '(?i){_LINE_SQL}', 3), ''), nullif(regexp_extract(t, '(?i){_LINE_SQL}', 4), ''))::int AS qty FROM line1),
line3 AS (SELECT *, length(s) <= {X.LINE_MOST} AND (NOT regexp_matches(s, '{X.PROSE}') OR regexp_matches(s, '\[[^\]\[]+\]')) AND name <> '' AND (regexp_matches(name, '[A-Za-z]') OR regexp_full_match(trim(name), '\d{{6,8}}')) AS ok FROM line2),
pasted AS (SELECT kind, id FROM line3 JOIN whole USING (kind, id) GROUP BY kind, id, lines HAVING bool_and(ok)
  AND NOT (len(lines) = 1 AND NOT regexp_matches(lines[1], '\[[^\]\[]+\]') AND (regexp_matches(lines[1], '(?i),|;|\band\b') OR regexp_matches(lines[1], '^\d')))),
piece0 AS (SELECT kind, id, generate_subscripts(pieces, 1) AS pos, unnest(pieces) AS piece FROM whole WHERE fits AND NOT coded AND NOT regexp_matches(p, '{X.PROSE}') AND len(pieces) BETWEEN 1 AND {X.PARTS_MOST}),
piece1 AS (SELECT *, regexp_extract(piece, '{X.PART}', 2) AS s, TRY_CAST(nullif(regexp_extract(piece, '{X.PART}', 1), '') AS INT) AS qty FROM piece0 WHERE (kind, id) NOT IN (SELECT (kind, id) FROM pasted)),
piece2 AS (SELECT kind, id FROM piece1 GROUP BY kind, id HAVING bool_and(coalesce(qty > 0 AND regexp_matches(trim(s, ' .'), '[A-Za-z]'), false))),
piece3 AS (SELECT piece1.* FROM piece1 JOIN piece2 USING (kind, id)), {limits_sql('piece3').replace('hits AS', 'hits2 AS').replace('FROM hits)', 'FROM hits2)').replace('limits AS', 'limits2 AS')}
SELECT kind, id, 1::bigint AS pos, regexp_extract(p, '^(\d{{6,8}})', 1) AS product, coalesce(TRY_CAST(nullif(regexp_extract(p, '^\d{{6,8}}\s+(\d{{1,5}})$', 1), '') AS INT), 1) AS qty, NULL::double AS low, NULL::double AS high FROM whole WHERE fits AND coded
UNION ALL SELECT kind, id, pos, trim(name, ' .-/'), coalesce(qty, 1), low, high FROM line3 JOIN pasted USING (kind, id)
UNION ALL SELECT kind, id, pos, CASE WHEN low IS NOT NULL OR high IS NOT NULL THEN clean ELSE trim(s, ' .') END, qty, low, high FROM limits2""")
def prompt_lines(spark, sf):
    """Items of the prompts that are lists in every part; the others have none."""
    rows = prompts(spark, sf).select("kind", "id", F.posexplode(X.prompt_items(F.col("s"))).alias("pos", "x"))
    return rows.select("kind", "id", (F.col("pos") + 1).cast("long").alias("pos"), "x.product", "x.qty", "x.low", "x.high")
