"""Queries of the whole resolver over a catalogue with branded names, codes, tax codes and sizes, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import cascade as C
from tessera.operators import match, sinks
from tessera.operators import rules as R
from tessera.plans.registry import query
from tessera.scratch import scratch_dir
from tessera.sources.catalogue import table

S = C.Scores()


def offers(spark, sf):
    """The parts as a catalogue of several suppliers: id, product, brand, model, spec, hsn, price, image, file_name."""
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string")
    brand = F.upper(F.translate(F.replace("p_brand", F.lit("#"), F.lit(" ")), "0123456789", "ABCDEFGHIJ"))
    model = F.concat(F.lit("C"), (k % 900).cast("string"), F.when(k % 3 == 0, "-SS").otherwise(""))
    product = (
        F.when(k % 5 == 0, name).when(k % 5 == 1, F.concat_ws("-", brand, model, name)).when(k % 5 == 2, F.concat(name, F.lit(" "), size, F.lit(" Ltr")))
        .when(k % 5 == 3, F.concat(brand, F.lit("-Casper-"), name)).otherwise(F.concat(name, F.lit(" lid")))
    )
    spec = F.concat(F.lower("p_type"), F.when(k % 4 == 0, " steel tray").when(k % 4 == 1, " glass cover").otherwise(" plain"), F.lit(" "), size, F.lit("cm"))
    file = F.when(k % 7 == 0, "Indigo price list.xlsx").when(k % 7 == 1, "Kutahya master.xlsx").otherwise(F.concat(F.lit("file"), (k % 7).cast("string")))
    return table(spark, sf, "part").select(
        k.alias("id"), product.alias("product"), F.when(k % 10 != 9, brand).alias("brand"), F.when(k % 6 != 5, model).alias("model"), spec.alias("spec"),
        F.concat((392410 + k % 40).cast("string"), F.when(k % 2 == 0, "10").otherwise("")).alias("hsn"), F.when(k % 8 != 0, F.col("p_retailprice").cast("decimal(18,2)")).alias("price"),
        (k % 4 == 0).alias("image"), file.alias("file_name"),
    )


def wanted(spark, sf):
    """A request for each supplier, in sixteen ways of asking for a part: request, phrase."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("s_suppkey"), "p_name", "p_type", "p_size", "p_brand")
    rows = table(spark, sf, "supplier").select("s_suppkey").join(p, "s_suppkey")
    k, size, a, b = F.col("s_suppkey"), F.col("p_size").cast("string"), F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    model = F.concat(F.lit("C"), (k % 900).cast("string"))
    brand = F.lower(F.translate(F.replace("p_brand", F.lit("#"), F.lit(" ")), "0123456789", "ABCDEFGHIJ"))
    ways = [
        F.col("p_name"), F.concat("p_name", F.lit("s")), F.concat(F.lit("need "), model, F.lit(" "), b, F.lit(" please")), b, F.concat_ws(" ", a, b, F.lower("p_type")),
        F.concat("p_name", F.lit(" heavy duty wall mounted grade")), (392410 + k % 40).cast("string"), F.concat_ws(" ", b, size, F.lit("ltr")), F.concat_ws(" ", brand, F.col("p_name")),
        F.concat(F.lit("indigo "), b), F.concat(b, F.lit(" gn")), F.concat(F.lower("p_type"), F.lit(" tray "), size, F.lit("cm")), model, F.lit("unknown thing"), F.concat(a, b),
        F.when(k % 3 == 0, F.concat(F.lit("only "), brand, F.lit(" items"))).otherwise(F.concat_ws(" ", a, b, F.lit("5"))),
    ]
    phrase = ways[-1]
    for i, way in enumerate(ways[:-1]):
        phrase = F.when(k % 16 == i, way).otherwise(phrase)
    return rows.select(k.alias("request"), phrase.alias("phrase"))


# ---------------------------------------------------------------- the same rules in SQL, every pair compared

_LIST = "('" + "','".join(R.UNITS) + "')"
_BRAND = "upper(translate(replace(p_brand, '#', ' '), '0123456789', 'ABCDEFGHIJ'))"
_MODEL = "'C' || (p_partkey % 900)"
_BOUND, _END = "(^|[^a-z0-9_])", "($|[^a-z0-9_])"
_OTHER = "CASE WHEN {0} LIKE '%s' AND length({0}) > 3 THEN {0}[:-2] ELSE {0} || 's' END"


def covers(w: str, text: str) -> str:
    """SQL: whether ``text`` has the word ``w``."""
    other = _OTHER.format(w)
    joined = lambda x: f"(length({x}) >= 5 AND regexp_matches({text}, '(^|[^a-z])' || regexp_replace({x}, '(.)', '\\1\\\\s*', 'g')))"
    return (
        f"(regexp_matches({text}, '{_BOUND}(' || {w} || '|' || {other} || '){_END}') OR {joined(w)} OR {joined(other)}"
        f" OR (length({w}) >= 4 AND regexp_matches({text}, '{_BOUND}' || {w} || '([a-z]{{2,5}}|s){_END}')))"
    )


def core_of(s: str) -> str:
    return f"list_filter(regexp_extract_all({s}, '[a-z]+'), lambda w: length(w) >= 3 AND w NOT IN {_LIST})"


_MINUS = "list_filter({0}, lambda w: NOT list_contains({1}, w))"
OFFERS_SQL = f"""offers AS (
  SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN {_BRAND} || '-' || {_MODEL} || CASE WHEN p_partkey % 3 = 0 THEN '-SS' ELSE '' END || '-' || p_name
      WHEN 2 THEN p_name || ' ' || p_size || ' Ltr' WHEN 3 THEN {_BRAND} || '-Casper-' || p_name ELSE p_name || ' lid' END AS product,
    CASE WHEN p_partkey % 10 <> 9 THEN {_BRAND} END AS brand, CASE WHEN p_partkey % 6 <> 5 THEN {_MODEL} || CASE WHEN p_partkey % 3 = 0 THEN '-SS' ELSE '' END END AS model,
    lower(p_type) || CASE p_partkey % 4 WHEN 0 THEN ' steel tray' WHEN 1 THEN ' glass cover' ELSE ' plain' END || ' ' || p_size || 'cm' AS spec,
    (392410 + p_partkey % 40)::varchar || CASE WHEN p_partkey % 2 = 0 THEN '10' ELSE '' END AS hsn,
    CASE WHEN p_partkey % 8 <> 0 THEN p_retailprice::decimal(18,2) END AS price, p_partkey % 4 = 0 AS image,
    CASE p_partkey % 7 WHEN 0 THEN 'Indigo price list.xlsx' WHEN 1 THEN 'Kutahya master.xlsx' ELSE 'file' || (p_partkey % 7) END AS file_name
  FROM part)"""
WANTED_SQL = f"""wanted AS (
  SELECT s_suppkey AS request, CASE s_suppkey % 16 WHEN 0 THEN p_name WHEN 1 THEN p_name || 's' WHEN 2 THEN 'need ' || {_MODEL} || ' ' || b || ' please' WHEN 3 THEN b
      WHEN 4 THEN p_name || ' ' || lower(p_type) WHEN 5 THEN p_name || ' heavy duty wall mounted grade' WHEN 6 THEN (392410 + s_suppkey % 40)::varchar WHEN 7 THEN b || ' ' || p_size || ' ltr'
      WHEN 8 THEN lower({_BRAND}) || ' ' || p_name WHEN 9 THEN 'indigo ' || b WHEN 10 THEN b || ' gn' WHEN 11 THEN lower(p_type) || ' tray ' || p_size || 'cm' WHEN 12 THEN {_MODEL}
      WHEN 13 THEN 'unknown thing' WHEN 14 THEN a || b ELSE CASE WHEN s_suppkey % 3 = 0 THEN 'only ' || lower({_BRAND}) || ' items' ELSE p_name || ' 5' END END AS phrase
  FROM (SELECT s_suppkey, part.*, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM supplier JOIN part ON p_partkey = s_suppkey))"""
#: Sizes, the only kind of qualifier besides codes that these requests have: number and unit, decimals apart.
_SPELL = {"l": "l litre liter ltr lt".split(), "cm": ["cm"]}
_NO_HISTORY = "past AS (SELECT '' AS t, '' AS name, '' AS m, 0 AS times WHERE false)"
RESOLVE_SQL = f"""WITH {OFFERS_SQL}, {WANTED_SQL}, {_NO_HISTORY}, q AS (
  SELECT DISTINCT trim(lower(phrase)) AS t FROM wanted
), req0 AS (
  SELECT t, list_filter(regexp_extract_all(t, '[a-z0-9]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN {_LIST}) AS core0,
    list_filter(list_transform(regexp_extract_all(t, '[a-z0-9][a-z0-9\\-/.]+'), lambda w: regexp_replace(w, '[./-]+$', '')),
      lambda w: regexp_matches(w, '[0-9]') AND regexp_matches(w, '[a-z]') AND NOT regexp_matches(w, '{R.SIZE_TOKEN}')) AS mtoks,
    regexp_extract_all(t, '[0-9]{{3,}}') AS numbers, regexp_extract_all(t, '\\b([0-9]{{6,8}})\\b', 1) AS hsns,
    list_filter(regexp_extract_all(t, '[a-z0-9]+'), lambda w: regexp_full_match(w, '[a-z]{{2}}') AND w NOT IN {_LIST}) AS short,
    regexp_matches(t, '[0-9]') AS digit, length(t) >= 4 AND regexp_matches(t, '[0-9]') AS codelike, trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')) AS tn
  FROM q
), req1 AS (SELECT *, len(mtoks) > 0 OR codelike OR regexp_matches(t, '[0-9]{{3}}') AS coded FROM req0
), p0 AS (
  SELECT *, lower(product) AS name, lower(coalesce(model, '')) AS m, lower(coalesce(spec, '')) AS s, trim(lower(coalesce(brand, ''))) AS b,
    list_filter(regexp_split_to_array(lower(product), '\\s*-\\s*'), lambda x: trim(x) <> '') AS segs FROM offers
), p1 AS (
  SELECT *, array_to_string(segs[coalesce(list_position(list_transform(segs, lambda x: trim(x) = b OR (regexp_matches(x, '[0-9]') AND NOT regexp_matches(trim(x), '\\s'))), false), len(segs)):], ' ') AS human,
    CASE WHEN trim(segs[1]) = b THEN segs[2:] ELSE segs END AS own FROM p0
), middles AS (SELECT unnest(list_filter(own[:-2], lambda x: NOT regexp_matches(x, '[0-9]'))) AS seg FROM p1
), collections AS (
  SELECT word FROM (SELECT unnest(regexp_extract_all(seg, '[a-z]{{3,}}')) AS word, 1 AS m, 0 AS n FROM middles UNION ALL SELECT unnest(regexp_extract_all(own[-1], '[a-z]{{3,}}')), 0, 1 FROM p1)
  GROUP BY word HAVING sum(m) >= 5 AND sum(n) < 5
), vocabulary AS (SELECT unnest(regexp_extract_all(name, '[a-z]{{3,}}')) AS word, count(*) AS n FROM p1 GROUP BY 1
), prod AS (
  SELECT *, {core_of('human')} AS hcore, list_filter({core_of('human')}, lambda w: NOT contains(b, w) AND NOT list_contains(lines_, w)) AS human_added,
    list_filter({core_of('s')}, lambda w: NOT contains(b, w) AND list_contains(vocab, w)) AS spec_added, regexp_replace(m, '[^a-z0-9]', '', 'g') AS code
  FROM p1, (SELECT coalesce(list(word), []) AS lines_ FROM collections), (SELECT list(word) AS vocab FROM vocabulary)
), brands AS (SELECT DISTINCT upper(trim(brand)) AS brand FROM offers WHERE regexp_matches(upper(trim(brand)), '^[A-Z][A-Z &.''-]+$') AND length(trim(brand)) >= 3
), common AS (SELECT x.brand FROM brands x JOIN p1 ON b <> '' AND NOT contains(upper(b), x.brand) AND regexp_matches(' ' || regexp_replace(upper(product), '[^A-Z0-9]+', ' ', 'g') || ' ', ' ' || x.brand || ' ') GROUP BY x.brand HAVING count(*) >= {C.COMMON}
), files AS (
  SELECT DISTINCT file_name, word FROM (SELECT file_name, unnest(regexp_extract_all(lower(file_name), '[a-z]{{4,}}')) AS word FROM offers)
  WHERE word NOT IN ('{"','".join(C.GENERIC_FILE_WORDS)}') AND word NOT IN (SELECT word FROM vocabulary WHERE n >= {C.COMMON})
), prefs AS (
  SELECT t, (SELECT list(brand) FROM brands WHERE brand NOT IN (SELECT brand FROM common) AND contains(' ' || upper(tn) || ' ', ' ' || brand || ' ')) AS brands,
    (SELECT list(DISTINCT file_name) FROM files WHERE contains(' ' || tn || ' ', ' ' || word || ' ')) AS files, (SELECT list(DISTINCT word) FROM files WHERE contains(' ' || tn || ' ', ' ' || word || ' ')) AS words FROM req1
), req AS (
  SELECT req1.*, coalesce(brands, []) AS brands, coalesce(files, []) AS files, {_MINUS.format("core0", "coalesce(words, [])")} AS core,
    coalesce(len(brands), 0) + coalesce(len(files), 0) > 0 AND len(regexp_extract_all(t, '[a-z]+')) > 0 AND len(list_filter(regexp_extract_all(t, '[a-z]+'), lambda w: length(w) > 2
      AND w NOT IN ('{"','".join(C.FILLER)}') AND NOT list_contains(string_split(lower(array_to_string(coalesce(brands, []), ' ')), ' '), w) AND NOT list_contains(coalesce(words, []), w))) = 0 AS context
  FROM req1 JOIN prefs USING (t)
), texts AS (SELECT DISTINCT name AS x FROM prod UNION SELECT s FROM prod
), asked AS (SELECT DISTINCT unnest(core) AS w FROM req
), cov AS (SELECT x, list(w) AS ws FROM texts JOIN asked ON {covers('w', 'x')} GROUP BY x
), held AS (SELECT DISTINCT unnest(list_concat(hcore, human_added, spec_added)) AS w FROM prod
), back AS (SELECT t, list(w) AS ws FROM req JOIN held ON {covers('w', 't')} GROUP BY t
), pairs AS (
  SELECT req.*, prod.*, coalesce(n.ws, []) AS nws, coalesce(e.ws, []) AS sws, coalesce(back.ws, []) AS tws, len(core) AS n,
    list_concat(mtoks, CASE WHEN codelike THEN [req.t] ELSE [] END, list_filter(numbers, lambda x: length(x) >= 5)) AS typed
  FROM req CROSS JOIN prod LEFT JOIN cov n ON n.x = prod.name LEFT JOIN cov e ON e.x = prod.s LEFT JOIN back ON back.t = req.t WHERE NOT context
), counted AS (
  SELECT *, len(list_filter(core, lambda w: list_contains(nws, w))) AS named, len(list_filter(core, lambda w: list_contains(sws, w))) AS specced,
    len(list_filter(core, lambda w: list_contains(nws, w) OR list_contains(sws, w))) AS both_, len({_MINUS.format('hcore', 'tws')}) = 0 AS within, len(short) > 0 OR digit AS forgiving FROM pairs
), tiers AS (
  SELECT *, CASE WHEN tn <> '' AND (tn = trim(regexp_replace(name, '[^a-z0-9]+', ' ', 'g')) OR tn = trim(regexp_replace(human, '[^a-z0-9]+', ' ', 'g'))) THEN 'exact'
    WHEN code <> '' AND len(list_filter(typed, lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g') = code)) > 0 THEN 'model' WHEN m <> '' AND len(list_filter(typed, lambda x: contains(m, x))) > 0 THEN 'model~'
    WHEN hsn <> '' AND len(list_filter(hsns, lambda h: starts_with(hsn, h))) > 0 THEN 'hsn' WHEN n > 0 AND named = n THEN 'name' WHEN n > 1 AND named > 0 AND both_ = n THEN 'name+spec'
    WHEN len(hcore) > 0 AND within AND (len(hcore) >= 2 OR n < 2) THEN 'rname' WHEN named > 0 AND named >= n * {S.part_share} THEN 'part'
    WHEN n > 0 AND specced >= 1 AND specced >= CASE WHEN forgiving THEN n - 1 ELSE n END AND ((specced = n AND n > 1) OR forgiving) THEN 'spec' END AS tier FROM counted
), based AS (
  SELECT *, CASE tier WHEN 'exact' THEN {S.exact} WHEN 'model' THEN {S.model} WHEN 'model~' THEN {S.within_model} WHEN 'hsn' THEN {S.hsn} WHEN 'name' THEN {S.name} - least(length(name), {S.name_most})
      WHEN 'name+spec' THEN {S.name_spec} - least(length(name), {S.name_most}) WHEN 'rname' THEN {S.reverse} + {S.reverse_word} * len(hcore) WHEN 'part' THEN {S.part} + {S.part_word} * named ELSE {S.spec} END
    + {S.short} * len(list_filter(short, lambda w: regexp_matches(name, '{_BOUND}' || w || '{_END}'))) + CASE WHEN len(list_filter(numbers, lambda x: contains(m, x))) > 0 THEN {S.number} ELSE 0 END
    + CASE WHEN price > 0 THEN {S.priced} ELSE 0 END + CASE WHEN image THEN {S.pictured} ELSE 0 END AS base,
    NOT coded AND (len(list_filter(brands, lambda x: b <> '' AND (contains(x, upper(b)) OR contains(upper(b), x)))) > 0 OR list_contains(files, file_name)) AS preferred,
    len({_MINUS.format('human_added', 'tws')}) + CASE WHEN tier IN ('name+spec', 'spec') THEN len({_MINUS.format('spec_added', 'tws')}) ELSE 0 END AS extra,
    replace(name || ' ' || m || ' ' || s, ' ', '') AS hay FROM tiers WHERE tier IS NOT NULL
), repeated AS (
  SELECT based.*, base + CASE WHEN preferred THEN {S.preferred} ELSE 0 END AS raised, coalesce(times, 0) AS times FROM based LEFT JOIN past ON past.t = based.t AND past.name = based.name AND past.m = based.m
), scored AS (
  SELECT t, id, tier, digit, price, extra, raised + CASE WHEN coded OR raised >= {S.model} OR times = 0 THEN 0 WHEN times >= 2 THEN {S.recurring} ELSE {S.once} END AS score, hay, mtoks,
    CASE WHEN NOT coded AND raised < {S.model} AND times > 0 THEN 'hist' WHEN preferred THEN 'brand' ELSE '' END AS boosted,
    list_transform(regexp_extract_all(t, '[0-9]+(?:\\.[0-9]+)?\\s*(?:litres?|liters?|ltrs?|lt|l|cm)\\b'), lambda x: [regexp_extract(x, '^[0-9.]+'), CASE WHEN x LIKE '%cm' THEN 'cm' ELSE 'l' END]) AS sizes FROM repeated
), fitted AS (
  SELECT *, score >= least(max(score) OVER (PARTITION BY t) * {S.cutoff_share}, {S.cutoff_most}.0) AS kept, len(sizes) + len(mtoks) > 0 AS sized,
    len(list_filter(sizes, lambda z: NOT regexp_matches(hay, '(^|[^0-9.])' || z[1] || '(\\.0)?' || CASE WHEN z[2] = 'cm' THEN 'cm' ELSE '({"|".join(_SPELL["l"])})' END))) = 0
      AND len(list_filter(mtoks, lambda x: NOT contains(hay, x))) = 0 AS fits FROM scored
), sized AS (SELECT * FROM (SELECT *, bool_or(kept AND fits) OVER (PARTITION BY t) AS found FROM fitted) WHERE CASE WHEN sized THEN fits AND (kept OR NOT found) ELSE kept END
), hinted AS (
  SELECT *, NOT sized AND len(list_filter(regexp_extract_all(t, '\\b([0-9]{{1,2}})\\b', 1), lambda x: regexp_matches(hay, '(^|[^0-9.])' || x || '("|''''|in|inch|cm|mm|l|ml|qt|ltr|oz|comp)'))) > 0 AS hint FROM sized
), narrowed AS (SELECT * FROM (SELECT *, bool_or(hint) OVER (PARTITION BY t) AS any_hint FROM hinted) WHERE hint OR NOT any_hint
), placed AS (
  SELECT *, row_number() OVER w AS place, first_value(tier) OVER w AS top, first_value(score) OVER w AS top_score, first_value(boosted) OVER w AS top_boosted, first_value(extra) OVER w AS top_extra FROM narrowed
  WINDOW w AS (PARTITION BY t ORDER BY score DESC, id)
), near AS (
  SELECT *, digit OR top IN ('model', 'model~') AS by_code, boosted = top_boosted AND tier = top AND top_score - score <= {S.band} AS near,
    top IN {tuple(C.COMPLETE)} AND tier IN {tuple(C.COMPLETE)} AND boosted = top_boosted AND extra <= top_extra AND place <= {S.members_of} AS member FROM placed
), banded AS (
  SELECT *, CASE WHEN top NOT IN {tuple(C.STRONG)} THEN 0 WHEN by_code THEN min(near::int) OVER (PARTITION BY t ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) ELSE member::int END AS band FROM near
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY band DESC, CASE WHEN band = 1 THEN CASE WHEN by_code AND top = 'hsn' THEN 0 ELSE extra END END, CASE WHEN band = 1 THEN coalesce(price, 0) <= 0 END,
    CASE WHEN band = 1 THEN coalesce(price, 0) END, place) AS rank FROM banded QUALIFY rank <= 15
)
SELECT w.request, ranked.id, coalesce(tier, CASE WHEN req.context THEN 'context' END, 'not_found') AS tier, score::bigint AS score, rank::int AS rank
FROM wanted w JOIN req ON req.t = trim(lower(w.phrase)) LEFT JOIN ranked ON ranked.t = req.t"""


@query(RESOLVE_SQL)
def resolve_full(spark, sf):
    """The whole cascade: candidates by equal keys, tiers, preferences, sizes and cheapest first."""
    return C.resolve(wanted(spark, sf), offers(spark, sf))


@query(f"""WITH {OFFERS_SQL}, {WANTED_SQL}, d AS (SELECT id, regexp_extract_all(lower(concat_ws(' ', product, model, spec, brand)), '[a-z0-9]+') AS w FROM offers), s AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d),
tf AS (SELECT id, term, count(*) AS tf, any_value(n) AS length FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY id, term),
a AS (SELECT request, list_distinct(regexp_extract_all(lower(phrase), '[a-z0-9]{{2,}}')) AS w FROM wanted),
asked AS (SELECT request, unnest(list_sort(list_distinct(list_concat(w, list_transform(list_filter(w, lambda x: x LIKE '%s' AND length(x) > 3), lambda x: x[:-2]))))[:24]) AS word FROM a),
hits AS (SELECT word, id, sum(tf) AS tf, any_value(length) AS length FROM (SELECT DISTINCT word FROM asked) JOIN tf ON term LIKE word || '%' GROUP BY word, id), df AS (SELECT word, count(*) AS df FROM hits GROUP BY word),
x AS (SELECT request, id, round(sum(CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM asked JOIN df USING (word) JOIN hits USING (word), s GROUP BY ALL)
SELECT request, id, score, row_number() OVER (PARTITION BY request ORDER BY score DESC, id) AS rank FROM x QUALIFY rank <= 220""")
def prefix_pool(spark, sf):
    """The best 220 rows of each request by words that start with its words."""
    docs = offers(spark, sf).select("id", F.concat_ws(" ", "product", "model", "spec", "brand").alias("text"))
    return match.prefix_pool(wanted(spark, sf), docs)


@query(f"""WITH {OFFERS_SQL}, {WANTED_SQL}, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(phrase), '[a-z]{{4,}}')) AS word FROM wanted), f AS (SELECT DISTINCT substr(word, 2) AS word FROM w WHERE length(word) >= 5 UNION SELECT word FROM w)
SELECT DISTINCT word, id FROM f JOIN offers ON product ILIKE '%' || word || '%' OR spec ILIKE '%' || word || '%' OR model ILIKE '%' || word || '%'""")
def glued_columns(spark, sf):
    """Rows that hold a request's word anywhere in name, specification or model."""
    w = wanted(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("phrase"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    w = w.unionByName(w.filter("length(word) >= 5").select(F.substr("word", F.lit(2)).alias("word")))
    return match.glued_rows(w, offers(spark, sf))


@query(f"""WITH {OFFERS_SQL}, {WANTED_SQL}, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(phrase), '[a-z]{{3,}}')) AS word FROM wanted), t AS (SELECT DISTINCT lower(product) AS text FROM offers UNION SELECT lower(spec) FROM offers)
SELECT word, text FROM w JOIN t ON {covers('word', 'text')}""")
def words_covered(spark, sf):
    """Which names and specifications cover which words: whole or in the other number, as the start of a word, joined."""
    words = wanted(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("phrase"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    return C.covering(words, offers(spark, sf).select(F.explode(F.array(F.lower("product"), F.lower("spec"))).alias("text")))


# ---------------------------------------------------------------- preferences


@query(f"""WITH {OFFERS_SQL}, {WANTED_SQL}, q AS (SELECT request, ' ' || trim(regexp_replace(lower(phrase), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM wanted), vocabulary AS (SELECT unnest(regexp_extract_all(lower(product), '[a-z]{{3,}}')) AS word, count(*) AS n FROM offers GROUP BY 1),
rows_ AS (SELECT ' ' || trim(regexp_replace(lower(product), '[^a-z0-9]+', ' ', 'g')) || ' ' AS n, upper(trim(coalesce(brand, ''))) AS own FROM offers),
b AS (SELECT DISTINCT upper(trim(brand)) AS brand, ' ' || trim(regexp_replace(lower(brand), '[^a-z0-9]+', ' ', 'g')) || ' ' AS key FROM offers WHERE regexp_matches(upper(trim(brand)), '^[A-Z][A-Z &.''-]+$') AND length(trim(brand)) >= 3),
keep AS (SELECT * FROM b WHERE (SELECT count(*) FROM rows_ WHERE own <> '' AND NOT contains(own, b.brand) AND contains(n, b.key)) < {C.COMMON}),
f AS (SELECT DISTINCT file_name, ' ' || word || ' ' AS key FROM (SELECT file_name, unnest(regexp_extract_all(lower(file_name), '[a-z]{{4,}}')) AS word FROM offers) WHERE word NOT IN ('{"','".join(C.GENERIC_FILE_WORDS)}') AND word NOT IN (SELECT word FROM vocabulary WHERE n >= {C.COMMON}))
SELECT DISTINCT request, 'brand' AS kind, brand AS name FROM q JOIN keep ON contains(t, key) UNION ALL SELECT DISTINCT request, 'file', file_name FROM q JOIN f ON contains(t, key)""")
def request_preferences(spark, sf):
    """Brands and catalogue files that a request names."""
    asks = wanted(spark, sf)
    req = C.requests_of(asks)
    rows = C.preferences(req, offers(spark, sf)).join(req.select("r", "t"), "r").join(asks.select("request", F.trim(F.lower("phrase")).alias("t")), "t")
    return rows.select("request", F.explode(F.col("brands")).alias("name")).select("request", F.lit("brand").alias("kind"), "name").unionByName(
        rows.select("request", F.lit("file").alias("kind"), F.explode("files").alias("name"))
    )


_HISTORY_SQL = """past AS (SELECT t, lower(trim(product)) AS name, lower(coalesce(model, '')) AS m, count(*) AS times FROM (
  SELECT trim(lower(phrase)) AS t, product, model FROM wanted JOIN lineitem ON l_suppkey = request JOIN offers ON id = l_partkey WHERE l_returnflag = 'R' AND l_quantity >= 48) GROUP BY ALL)"""


@query(RESOLVE_SQL.replace(_NO_HISTORY, _HISTORY_SQL))
def resolve_with_history(spark, sf):
    """The cascade with what was chosen before for the same phrase (here: large returned lines of the supplier), by product and model."""
    asks, goods = wanted(spark, sf), offers(spark, sf)
    lines = table(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 48").select(F.col("l_suppkey").alias("request"), F.col("l_partkey").alias("id"))
    past = asks.join(lines, "request").join(goods, "id").groupBy("phrase", "product", "model").agg(F.count("*").alias("times"))
    return C.resolve(asks, goods, history=past)


# ---------------------------------------------------------------- evaluation


STYLES = {"name": "p_name", "plural": "p_name || 's'", "shuffled": "split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)", "code": f"'find ' || {_MODEL} || '-SS'", "size": "p_name || ' ' || p_size || ' litre'"}
_STYLED_SQL = "wanted AS (" + " UNION ALL ".join(f"SELECT s_suppkey * 10 + {i} AS request, {x} AS phrase FROM supplier JOIN part ON p_partkey = s_suppkey" for i, x in enumerate(STYLES.values())) + ")"


def styled(spark, sf):
    """Requests for each supplier's part in every style: request (part * 10 + number of the style), phrase, style, part."""
    p = table(spark, sf, "supplier").join(table(spark, sf, "part"), F.col("s_suppkey") == F.col("p_partkey"))
    code = F.concat(F.lit("find C"), (F.col("p_partkey") % 900).cast("string"), F.lit("-SS"))
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    ways = [F.col("p_name"), F.concat("p_name", F.lit("s")), F.concat_ws(" ", b, a), code, F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.lit("litre"))]
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("style"), way.alias("phrase")) for i, (name, way) in enumerate(zip(STYLES, ways, strict=True))])
    rows = p.select(F.col("s_suppkey").alias("part"), F.inline(each))
    return rows.select((F.col("part") * 10 + F.col("i")).alias("request"), "phrase", "style", "part")


def accuracy(results, truth):
    """(style, n, strict, fair, found): requests whose first row is the part; that list it; that have any row."""
    first = F.max(((F.col("rank") == 1) & (F.col("id") == F.col("part"))).cast("int")).alias("strict")
    listed = F.max((F.col("id") == F.col("part")).cast("int")).alias("fair")
    per = truth.join(results, "request").groupBy("style", "request").agg(first, listed, F.max(F.col("id").isNotNull().cast("int")).alias("found"))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return per.groupBy("style").agg(F.count("*").alias("n"), total("strict"), total("fair"), total("found"))


@query(f"""WITH res AS ({RESOLVE_SQL.replace(WANTED_SQL, _STYLED_SQL)}), per AS (SELECT request, request % 10 AS s, max(CASE WHEN rank = 1 AND id = request // 10 THEN 1 ELSE 0 END) AS strict,
  max(CASE WHEN id = request // 10 THEN 1 ELSE 0 END) AS fair, max(CASE WHEN id IS NOT NULL THEN 1 ELSE 0 END) AS found FROM res GROUP BY request)
SELECT ['{"', '".join(STYLES)}'][s + 1] AS style, count(*) AS n, sum(strict)::bigint AS strict, sum(fair)::bigint AS fair, sum(found)::bigint AS found FROM per GROUP BY s""")
def style_accuracy(spark, sf):
    """Strict and fair accuracy of the resolver by style of request."""
    rows = styled(spark, sf)
    return accuracy(C.resolve(rows.select("request", "phrase"), offers(spark, sf)), rows.select("request", "style", "part"))


#: The catalogue after an edit: one file is gone, another is cheaper.
_EDITED_SQL = OFFERS_SQL.replace("offers AS (", "every AS (") + ", offers AS (SELECT * REPLACE (CASE WHEN file_name = 'file4' THEN (price / 2)::decimal(18,2) ELSE price END AS price) FROM every WHERE file_name <> 'file3')"


def edited(spark, sf):
    half = (F.col("price") / 2).cast("decimal(18,2)")
    return offers(spark, sf).filter("file_name <> 'file3'").withColumn("price", F.when(F.col("file_name") == "file4", half).otherwise(F.col("price")))


@query(f"""WITH a AS ({RESOLVE_SQL}), b AS ({RESOLVE_SQL.replace(OFFERS_SQL, _EDITED_SQL)}), x AS (SELECT request, id FROM a WHERE rank = 1 OR rank IS NULL), y AS (SELECT request, id FROM b WHERE rank = 1 OR rank IS NULL)
SELECT x.request, CASE WHEN x.id IS NOT DISTINCT FROM y.id THEN 'same' WHEN x.id IS NULL THEN 'found' WHEN y.id IS NULL THEN 'lost' WHEN b.rank IS NOT NULL THEN 'moved' ELSE 'gone' END AS state, x.id AS old_id, y.id AS new_id, b.rank AS rank_now
FROM x JOIN y USING (request) LEFT JOIN b ON b.request = x.request AND b.id = x.id""")
def resolver_diff(spark, sf):
    """What an edit of the catalogue does to the first row of each request: two snapshots, compared."""
    path, asks = f"{scratch_dir(spark)}/snapshots-{uuid.uuid4().hex}", wanted(spark, sf)
    for version, goods in enumerate((offers(spark, sf), edited(spark, sf))):
        sinks.keep_snapshot(C.resolve(asks, goods), path, version)
    return sinks.snapshot_diff(*[spark.read.parquet(f"{path}/version={v}") for v in (0, 1)])


# Words that name no family.
FAMILY_STOP = "and with for the set pcs size small large medium big mini new done list price".split()
_STOP = "('" + "','".join(FAMILY_STOP) + "')"
_FAMILY_SQL = f"""toks AS (SELECT id, list_filter(regexp_extract_all(lower(product), '[a-z]{{4,}}'), lambda w: w NOT IN {_STOP}) AS w FROM offers),
single AS (SELECT term FROM (SELECT id, unnest(list_distinct(w)) AS term FROM toks) GROUP BY term HAVING count(*) >= 30 ORDER BY count(*) DESC, term LIMIT 60),
double_ AS (SELECT term FROM (SELECT w[k] || ' ' || w[k + 1] AS term FROM (SELECT w, unnest(range(1, len(w))) AS k FROM toks) WHERE w[k] <> w[k + 1]) GROUP BY term HAVING count(*) >= 15 ORDER BY count(*) DESC, term LIMIT 80),
family AS (SELECT term, (SELECT count(*) FROM offers WHERE len(list_filter(string_split(term, ' '), lambda x: NOT contains(lower(product), x))) = 0) AS truth FROM (SELECT term FROM single UNION ALL SELECT term FROM double_)),
wanted AS (SELECT term AS request, term AS phrase FROM family WHERE truth >= 8)"""


@query(f"""WITH {OFFERS_SQL}, {_FAMILY_SQL}, res AS ({RESOLVE_SQL.replace(WANTED_SQL, _FAMILY_SQL).replace('rank <= 15', 'rank <= 500')}), got AS (SELECT request, count(id) AS shown FROM res GROUP BY request)
SELECT term, shown::bigint AS shown, truth::bigint AS truth, shown < 0.5 * truth AS suspect FROM family JOIN got ON got.request = term""")
def families_shown(spark, sf):
    """How much of each family of names (frequent words and pairs of words) a search for it shows; below a half is suspect."""
    goods = offers(spark, sf)
    w = F.filter(F.regexp_extract_all(F.lower("product"), F.lit("[a-z]{4,}"), F.lit(0)), lambda x: ~x.isin(FAMILY_STOP))
    toks = goods.select(F.lower("product").alias("name"), w.alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.element_at("w", i).alias("a"), F.element_at("w", i + 1).alias("b"))))
    single = toks.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").count().filter("count >= 30").orderBy(F.desc("count"), "term").limit(60)
    double = toks.select(F.inline(pairs)).filter("a <> b").select(F.concat_ws(" ", "a", "b").alias("term")).groupBy("term").count().filter("count >= 15").orderBy(F.desc("count"), "term").limit(80)
    terms = single.unionByName(double).select("term")
    # Names are matched by any part of a word, so the terms (140 at most) meet the distinct names by their words' trigrams.
    words = terms.select("term", F.explode(F.split("term", " ")).alias("word"))
    hits = words.join(R.contained(words.select("word"), goods.select(F.col("product").alias("name")), forms=False), "word").filter(F.contains(F.lower("name"), F.col("word")))
    whole = hits.groupBy("term", "name").agg(F.count("*").alias("k")).filter(F.col("k") == F.size(F.split("term", " ")))
    truth = whole.join(goods.select(F.col("product").alias("name")), "name").groupBy("term").agg(F.count("*").alias("truth")).filter("truth >= 8")
    shown = C.resolve(truth.select(F.col("term").alias("request"), F.col("term").alias("phrase")), goods, 500).groupBy(F.col("request").alias("term")).agg(F.count("id").alias("shown"))
    return truth.join(shown, "term").select("term", "shown", "truth", (F.col("shown") < 0.5 * F.col("truth")).alias("suspect"))


_MISSES = """CASE l_orderkey % 7 WHEN 0 THEN p_name || ' (model C' || CAST(l_partkey % 900 AS STRING) || ' not in master)' WHEN 1 THEN p_name || ' (under ₹' || CAST(l_linenumber AS STRING) || '00)' WHEN 2 THEN p_name || ' (₹ limit)'
  WHEN 3 THEN p_name || ' (large)' WHEN 4 THEN 'Not In Master: ' || p_name WHEN 5 THEN p_name || ' (between 5 and ₹9)' ELSE p_name END"""
_REASON = r"""CASE WHEN regexp_matches(s, '(?i)model .*not in master|not in master') THEN 'model' WHEN regexp_matches(s, '(?i)\((?:over|under|upto|max|between).*₹|₹.*\)') THEN 'price' WHEN contains(s, '(') AND contains(s, ')') THEN 'other' ELSE 'bare' END"""


@query(f"""WITH m AS (SELECT {_MISSES} AS s FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT {_REASON} AS reason, count(*) AS n FROM m GROUP BY 1)
SELECT reason, n, (100 * n // sum(n) OVER ())::bigint AS percent FROM c""")
def miss_reasons(spark, sf):
    """Why lines were not found, by what their note says."""
    s = F.expr(_MISSES)
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(s.alias("s"))
    reason = (
        F.when(F.col("s").rlike("(?i)model .*not in master|not in master"), "model").when(F.col("s").rlike(r"(?i)\((?:over|under|upto|max|between).*₹|₹.*\)"), "price")
        .when(F.contains("s", F.lit("(")) & F.contains("s", F.lit(")")), "other").otherwise("bare")
    )
    per = rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))  # four rows
    total = per.agg(F.sum("n").alias("all"))
    return per.join(F.broadcast(total), F.lit(True)).select("reason", "n", F.floor(F.col("n") * 100 / F.col("all")).cast("long").alias("percent"))


# ---------------------------------------------------------------- repairs of words


_SAFE = "('" + "','".join([*X.UNIT_SAFE, *X.UNIT_WORDS]) + "')"
_FIRST = "QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, near) = 1"
_LEADING = "(SELECT word, near, n, lead(n) OVER o AS next, row_number() OVER o AS at_ FROM (SELECT word, near, max(n) AS n FROM {0} GROUP BY ALL) WINDOW o AS (PARTITION BY word ORDER BY n DESC, near)) WHERE at_ = 1 AND (next IS NULL OR n >= 3 * next)"


@query(f"""WITH seen AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS word FROM documents) GROUP BY word),
typed AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS word FROM conversations) WHERE word NOT IN {_SAFE}),
w AS (SELECT t.word, a.n IS NULL AS unseen, coalesce(a.n, b.n, 0) AS known FROM typed t LEFT JOIN seen a ON a.word = t.word LEFT JOIN seen b ON b.word = regexp_replace(t.word, 's+$', '')), rare AS (SELECT * FROM w WHERE known <= 2), unseen AS (SELECT word FROM rare WHERE unseen),
near AS (SELECT word AS near, n FROM seen), skeletons AS (SELECT left(near, 1) || regexp_replace(substr(near, 2), '[aeiou]', '', 'g') AS skeleton, near, n FROM near WHERE n >= 2 AND length(near) >= 4),
best AS (SELECT * FROM skeletons WHERE skeleton <> near QUALIFY row_number() OVER (PARTITION BY skeleton ORDER BY n DESC, near) = 1), short AS (SELECT word FROM unseen WHERE length(word) BETWEEN 3 AND 6),
starts AS (SELECT near, n, left(skeleton, k) AS word FROM (SELECT near, n, skeleton, unnest(range(3, least(length(skeleton), 6) + 1)) AS k FROM best) UNION ALL SELECT near, n, left(near, k) FROM (SELECT near, n, unnest(range(3, least(length(near) - 2, 6) + 1)) AS k FROM near WHERE n >= 2)),
s0 AS (SELECT word, near FROM short JOIN best ON word = skeleton), s1 AS (SELECT word, near FROM {_LEADING.format('short JOIN starts USING (word)')}),
s2 AS (SELECT u.word, near FROM unseen u JOIN (VALUES ('sq', 'square'), ('sm', 'small'), ('lg', 'large')) AS t(word, near) USING (word) JOIN near USING (near) WHERE n >= 2),
cut AS (SELECT word, left(word, k) AS near FROM (SELECT word, unnest(range(3, length(word) - 2)) AS k FROM unseen WHERE length(word) >= 6)), s3 AS (SELECT word, near FROM {_LEADING.format('(SELECT word, near, n FROM cut JOIN near USING (near) WHERE n >= 3)')}),
s4 AS (SELECT word, near FROM rare JOIN near ON left(word, 1) = left(near, 1) AND length(word) BETWEEN length(near) - 1 AND length(near) + 1 AND n > known AND n >= 25 * known AND near <> word AND length(word) >= 4 AND damerau_levenshtein(word, near) <= 1 {_FIRST}),
every AS (SELECT *, 0 AS step FROM s0 UNION ALL SELECT *, 1 FROM s1 UNION ALL SELECT *, 2 FROM s2 UNION ALL SELECT *, 3 FROM s3 UNION ALL SELECT *, 4 FROM s4)
SELECT word, arg_min(near, step) AS near FROM every GROUP BY word""")
def word_repairs(spark, sf):
    """What words of the conversations stand for among the words of the documents: abbreviations, cut words, typing errors."""
    words = lambda t, least: table(spark, sf, t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z]{{{least},}}"), F.lit(0))).alias("word"))
    return match.repairs(words("conversations", 2), words("documents", 3).groupBy("word").agg(F.count("*").alias("n")))


def typed(spark, sf):
    """Requests for each supplier's part, mistyped by fixed rules: request (part * 10 + number of the style), phrase, style, part."""
    p = table(spark, sf, "supplier").join(table(spark, sf, "part"), F.col("s_suppkey") == F.col("p_partkey"))
    a, b, n = F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.length("p_name")
    swapped = F.concat(F.substring(b, 1, 1), F.substring(b, 3, 1), F.substring(b, 2, 1), F.substr(b, F.lit(4)))
    skeleton = F.concat(F.substring(b, 1, 1), F.regexp_replace(F.substring(b, 2, 100), "[aeiou]", ""))
    ways = {"swap": F.concat_ws(" ", a, swapped), "skeleton": F.concat_ws(" ", a, skeleton), "longer": F.concat(a, F.lit(" "), b, F.lit("xyz")), "doubled": F.concat(a, F.lit(" "), F.substring(b, 1, 2), F.substr(b, F.lit(2), n))}
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(style).alias("style"), way.alias("phrase")) for i, (style, way) in enumerate(ways.items())])
    rows = p.select(F.col("s_suppkey").alias("part"), F.inline(each))
    return rows.select((F.col("part") * 10 + F.col("i")).alias("request"), "phrase", "style", "part")


@query()
def resolve_typed(spark, sf):
    """Mistyped requests, prepared and resolved."""
    goods = offers(spark, sf)
    return C.resolve(C.prepared(typed(spark, sf).select("request", "phrase"), goods), goods)
