"""One request line against the whole catalogue: candidates, tiers, preferences, boosts, sizes, and the cheapest first.

Candidates come by equal keys only, and every row that has a tier is among them, without a cap:

* exact names, models and tax codes by their normalised form, models that contain a typed code by grams of three;
* covered words by a prefix filter. A row counts only if it covers 60 % of the request's words, so it
  covers one of the rarest words that make up more than 40 % of them; postings of the others are not read.
  Rows that complete the request in their specification cover its rarest word in either text;
* names that stand inside the request by their rarest word alone;
* rows of like meaning, where a table of similarities is given.

Which words which texts cover is told once for each different word and text (see ``covering``); a pair is
then judged on arrays of words. Requests are
resolved once for each different phrase and label, so a phrase may be a third of all rows.

Rows that a phrase can't tell apart by words are one class (see ``class_candidates``): names that cover the same asked words, with
specifications that do. A phrase meets classes, and of the best ones only as many rows are judged as can be among its first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import match
from tessera.operators import rules as R
from tessera.scratch import materialize

#: Letters and words that a joined word is compared over.
JOINED_LETTERS, JOINED_WORDS = 60, 30
#: Pairs of request and product that one task judges.
PAIRS_A_TASK = 50_000


@dataclass(frozen=True)
class Scores:
    """Base scores of the tiers, what is added, the cutoff and the bands of equal goods."""

    exact: int = 2000
    model: int = 1500
    hsn: int = 1400
    within_model: int = 1000
    name: int = 600
    name_spec: int = 500
    reverse: int = 400
    reverse_word: int = 20
    part: int = 200
    part_word: int = 10
    part_share: float = 0.6
    spec: int = 120
    name_most: int = 120
    like_least: float = 0.62
    like_rate: int = 600
    like_only: float = 0.74
    like_base: int = 150
    like_only_rate: int = 1200
    like_anchor: float = 0.72
    preferred: int = 1600
    short: int = 100
    number: int = 300
    priced: int = 30
    pictured: int = 5
    recurring: int = 1650
    once: int = 400
    cutoff_share: float = 0.6
    cutoff_most: int = 420
    band: int = 120
    band_like: float = 0.06
    members_like: float = 0.10
    members_of: int = 80


STRONG = ["exact", "model", "model~", "hsn", "name", "name+spec", "rname"]
COMPLETE = ["exact", "name", "name+spec"]
WORDY = ["name", "name+spec", "rname", "part", "spec", "sem"]
#: Words of file names that name no catalogue, and words around a preference.
GENERIC_FILE_WORDS = (
    "price list lists pricelist master final done copy part items item table preview quotation compressed digital added from boq products professional collection series"
).split()
FILLER = "only items item products product all from brand brands everything things stuff pls plz please give want need needed".split()
#: A brand or file word that so many other names use is an ordinary word.
COMMON = 25


# ---------------------------------------------------------------- words


def normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def tokens(s: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def starts(s: Column) -> Column:
    """What follows each start of a letter run, blanks left out, up to the next sign or digit."""
    words = lambda x: F.split(F.trim(x), r"\s+")
    joined = lambda x, i: F.substr(F.array_join(F.slice(words(x), i, F.lit(JOINED_WORDS)), ""), F.lit(1), F.lit(JOINED_LETTERS))
    runs = F.filter(F.split(s, r"[^a-z\s]+"), lambda x: F.trim(x) != "")
    return F.array_distinct(F.flatten(F.transform(runs, lambda x: F.transform(F.sequence(F.lit(1), F.size(words(x))), lambda i: joined(x, i)))))


def other_number(w: Column) -> Column:
    return F.when(w.endswith("s") & (F.length(w) > 3), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(F.concat(w, F.lit("s")))


def covered(w: Column, have: Column, after: Column) -> Column:
    """Whether a text (its ``tokens`` and ``starts``) has a word: itself or its other number, as the start of a word of two to five
    letters more (from four letters on), or as the start of joined words (from five on)."""
    other = other_number(w)
    rest = lambda t: F.substr(t, F.length(w) + 1, F.length(t))
    longer = (F.length(w) >= 4) & F.exists(have, lambda t: t.startswith(w) & rest(t).rlike("^([a-z]{2,5}|s)$"))
    joined = F.exists(after, lambda s: ((F.length(w) >= 5) & s.startswith(w)) | ((F.length(other) >= 5) & s.startswith(other)))
    return F.array_contains(have, w) | F.array_contains(have, other) | longer | joined


def _asked_keys(w: Column) -> Column:
    other = other_number(w)
    key = lambda kind, x, n, least: F.when(F.length(x) >= least, F.concat(F.lit(kind), F.substr(x, F.lit(1), F.lit(n))))
    return F.array_distinct(F.array_compact(F.array(key("=", w, 999, 1), key("=", other, 999, 1), key("4", w, 4, 4), key("5", w, 5, 5), key("5", other, 5, 5))))


def _held_keys(have: Column, after: Column) -> Column:
    long = lambda xs, n, least, kind: F.transform(F.filter(xs, lambda x: F.length(x) >= least), lambda x: F.concat(F.lit(kind), F.substr(x, F.lit(1), F.lit(n))))
    return F.array_distinct(F.concat(F.transform(have, lambda t: F.concat(F.lit("="), t)), long(have, 4, 5, "4"), long(after, 5, 5, "5")))


def covering(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(word, text) for every distinct word and text where the text covers the word: equal keys, then the exact test."""
    asked = words.select("word").distinct().select("word", F.explode(_asked_keys(F.col("word"))).alias("key"))
    held = texts.select("text").distinct().select("text", tokens(F.col("text")).alias("have"), starts(F.col("text")).alias("after"))
    held = held.select("text", "have", "after", F.explode(_held_keys(F.col("have"), F.col("after"))).alias("key"))
    return asked.join(held, "key").filter(covered(F.col("word"), F.col("have"), F.col("after"))).select("word", "text").distinct()


# ---------------------------------------------------------------- both sides


def plain_words(s: Column) -> Column:
    """Words of three letters on that are no units, digits apart, repeats kept."""
    return F.filter(F.regexp_extract_all(s, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(R.UNITS))


def requests_of(requests: DataFrame) -> DataFrame:
    """A row for each different (phrase, label): what the cascade reads from a request."""
    label = F.col("label") if "label" in requests.columns else F.lit(None).cast("string")
    t = F.trim(F.lower("phrase"))
    rows = requests.select(F.coalesce(t, F.lit("")).alias("t"), F.trim(F.lower(label)).alias("label")).distinct()
    models, numbers, hsn = R.code_tokens(F.col("t"))
    digit = F.col("t").rlike("[0-9]")
    own = F.array_distinct(R.core_words(F.coalesce("label", F.lit(""))))
    rows = rows.select(
        F.xxhash64("t", "label").alias("r"), "t", "label", plain_words(F.col("t")).alias("core"), models.alias("mtoks"), numbers.alias("numbers"), hsn.alias("hsns"),
        F.filter(F.regexp_extract_all("t", F.lit("[a-z0-9]+"), F.lit(0)), lambda w: w.rlike("^[a-z]{2}$") & ~w.isin(R.UNITS)).alias("short"),
        digit.alias("digit"), ((F.length("t") >= 4) & digit).alias("codelike"), normal(F.col("t")).alias("tn"),
        # A label that equals the phrase, or none, anchors nothing.
        F.when(F.col("label").isNotNull() & (F.col("label") != F.col("t")), own).otherwise(F.array().cast("array<string>")).alias("anchor"),
    )
    none, long = F.array().cast("array<string>"), F.filter("numbers", lambda x: F.length(x) >= 5)
    typed = F.array_distinct(F.concat("mtoks", F.when(F.col("codelike"), F.array("t")).otherwise(none), long))
    rows = rows.withColumn("typed", typed).withColumn("stripped", F.transform("typed", lambda x: F.regexp_replace(x, "[^a-z0-9]", "")))
    rows = rows.withColumns({"groups": R.qualifier_groups(F.col("t")), "small": F.regexp_extract_all("t", F.lit(r"\b([0-9]{1,2})\b"), F.lit(1))})
    return rows.withColumn("coded", (F.size("mtoks") > 0) | F.col("codelike") | F.col("t").rlike("[0-9]{3}"))


def collection_words(products: DataFrame) -> DataFrame:
    """(word): names of lines of goods, which stand in five or more middle segments and in fewer than five last ones."""
    parts = F.filter(F.split(F.lower("product"), r"\s*-\s*"), lambda s: F.trim(s) != "")
    parts = F.when(F.trim(parts[0]) == F.lower(F.trim(F.coalesce("brand", F.lit("")))), F.slice(parts, 2, 999)).otherwise(parts)
    words = lambda s: F.filter(F.regexp_extract_all(s, F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    rows = products.groupBy("product", "brand").agg(F.count("*").alias("rows")).select("rows", parts.alias("p")).filter(F.size("p") > 0)
    middle = F.flatten(F.transform(F.filter(F.slice("p", 1, F.size("p") - 1), lambda s: ~s.rlike("[0-9]")), words))
    zero = F.lit(0).cast("long")
    middle = rows.filter(F.size("p") > 1).select("rows", F.explode(middle).alias("word")).groupBy("word").agg(F.sum("rows").alias("m"), zero.alias("n"))
    last = rows.select("rows", F.explode(words(F.element_at("p", -1))).alias("word")).groupBy("word").agg(zero.alias("m"), F.sum("rows").alias("n"))
    return middle.unionByName(last).groupBy("word").agg(F.sum("m").alias("m"), F.sum("n").alias("n")).filter("m >= 5 and n < 5").select("word")


def products_of(products: DataFrame) -> DataFrame:
    """What the cascade reads from a product; words that add nothing to a name are taken out of ``added``.

    Texts are read once for each different name and brand, and specification and brand.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rows = products.select("id", "price", "image", "file_name", low("product").alias("name"), low("model").alias("model"), low("spec").alias("spec"), F.trim(F.coalesce("hsn", F.lit(""))).alias("hsn"), F.trim(low("brand")).alias("brand"), F.col("product").isNull().alias("unnamed"))
    human = F.coalesce(R.human_name(F.when(~F.col("unnamed"), F.col("name")), F.col("brand")), F.lit(""))
    names = materialize(rows.select("name", "brand", "unnamed").distinct().withColumn("human", human), "cascade-texts")
    specs = rows.select("spec", "brand").distinct()
    vocabulary = names.select(F.explode(F.regexp_extract_all("name", F.lit("[a-z]{3,}"), F.lit(0))).alias("word")).distinct()

    def kept(texts, column, keep, how):
        """Words of a text that pass a join, for each different text (and brand)."""
        w = texts.select("brand", column).distinct().withColumn("word", F.explode(R.core_words(F.col(column)))).filter(~F.contains("brand", F.col("word")))
        w = w.join(keep, "word", how).groupBy("brand", column).agg(F.collect_list("word").alias(f"{column}_added"))
        return texts.join(w, ["brand", column], "left").withColumn(f"{column}_added", F.coalesce(f"{column}_added", F.array().cast("array<string>")))

    names = kept(names, "human", collection_words(products), "left_anti")
    names = names.withColumns({"ntoks": tokens(F.col("name")), "hcore": R.core_words(F.col("human")), "name_key": normal(F.col("name")), "human_key": normal(F.col("human"))})
    specs = kept(specs, "spec", vocabulary, "left_semi")
    rows = rows.withColumn("code", F.regexp_replace("model", "[^a-z0-9]", ""))
    return rows.hint("merge").join(names, ["name", "brand", "unnamed"]).hint("merge").join(specs, ["spec", "brand"]).drop("unnamed")  # a small file may hold many rows


# ---------------------------------------------------------------- candidates


def _grams(s: Column, n: int) -> Column:
    return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substr(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def covered_words(req: DataFrame, prod: DataFrame) -> dict[str, DataFrame]:
    """By side, (word, text, rows): which of the requests' words each different name and specification covers, and how many products have it."""
    words = req.select(F.explode(F.concat("core", "anchor")).alias("word"))
    out = {}
    for side in ("name", "spec"):
        texts = prod.groupBy(side).agg(F.count("*").alias("rows")).withColumnRenamed(side, "text").filter("text <> ''")
        out[side] = materialize(covering(words, texts).join(texts, "text"), f"cascade-{side}")
    return out


def _with_words(rows: DataFrame, column: str, hits: DataFrame, name: str) -> DataFrame:
    """``rows`` with the words that the text in ``column`` covers: at most a form or a start of each of its own."""
    lists = hits.groupBy(F.col("text").alias(column)).agg(F.collect_set("word").alias(name))
    return rows.join(lists, column, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def _picked(req: DataFrame, hits: dict[str, DataFrame], share: float) -> tuple[DataFrame, dict[str, Column]]:
    """The words of each request with their places by rarity, and by side which of them the postings are read for."""
    words = req.select("r", F.size("core").alias("n"), (F.size("short") > 0).alias("short"), "digit", F.explode("core").alias("word"))
    words = words.groupBy("r", "word").agg(F.max("n").alias("n"), F.max("short").alias("short"), F.max("digit").alias("digit"), F.count("*").alias("times"))
    rows = {side: x.groupBy("word").agg(F.sum("rows").alias(f"{side}_rows")) for side, x in hits.items()}
    zero = {f"{s}_rows": F.coalesce(f"{s}_rows", F.lit(0)) for s in rows}
    words = words.join(rows["name"], "word", "left").join(rows["spec"], "word", "left").withColumns(zero)
    order = lambda by: Window.partitionBy("r").orderBy(by, "word")
    words = words.withColumns({
        # Words before this one, rarest first: once they make up over 1 - share of the request, no other is needed.
        "before": F.coalesce(F.sum("times").over(order("name_rows").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "either": F.row_number().over(order(F.col("name_rows") + F.col("spec_rows"))), "scarce": F.row_number().over(order("spec_rows")),
    })
    words = materialize(words, "cascade-words")
    forgiving = F.col("short") | F.col("digit")
    picks = {
        "name": (F.col("before") <= F.col("n") * (1 - share)) | (F.col("either") == 1),
        "spec": ((F.col("either") == 1) & (F.col("n") > 1)) | ((F.col("scarce") == 1) & ((F.col("n") > 1) | forgiving)) | ((F.col("scarce") == 2) & forgiving),
    }
    return words, picks


def word_candidates(req: DataFrame, prod: DataFrame, share: float = Scores.part_share, hits: dict[str, DataFrame] | None = None) -> DataFrame:
    """(r, id) of the rows that can cover enough of a request's words, by its rarest words."""
    hits = hits or covered_words(req, prod)
    words, picks = _picked(req, hits, share)
    out = None
    for side, keep in picks.items():
        some = words.filter(keep).select("r", "word").join(hits[side], "word").select("r", F.col("text").alias(side)).distinct()
        some = some.join(prod.select("id", side), side).select("r", "id")
        out = some if out is None else out.unionByName(some)
    return out


def reverse_candidates(req: DataFrame, prod: DataFrame) -> DataFrame:
    """(r, id) of the rows whose rarest name word the request covers."""
    names = prod.filter(F.size("hcore") > 0).groupBy("human").agg(F.first("hcore").alias("hcore"), F.count("*").alias("rows"))
    words = names.select("human", "rows", F.explode(F.array_distinct("hcore")).alias("word"))
    rare = words.groupBy("word").agg(F.sum("rows").alias("n"))
    rare = words.join(rare, "word").groupBy("human").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    hits = covering(rare, req.select(F.col("t").alias("text")))
    return rare.join(hits, "word").join(req.select("r", F.col("t").alias("text")), "text").join(prod.select("id", "human"), "human").select("r", "id")


def name_candidates(req: DataFrame, prod: DataFrame) -> DataFrame:
    """(r, id) by equal names."""
    names = prod.select("id", F.explode(F.array_distinct(F.array("name_key", "human_key"))).alias("key"))
    return req.filter("tn <> ''").select("r", F.col("tn").alias("key")).join(names, "key").select("r", "id")


def code_candidates(req: DataFrame, prod: DataFrame) -> DataFrame:
    """(r, id) by models and tax codes: equal, or a model that contains a typed code or number."""
    codes = req.select("r", F.explode(F.array_distinct(F.concat("typed", "numbers"))).alias("x")).filter("length(x) >= 2")
    equal = req.select("r", F.explode("stripped").alias("code")).filter("code <> ''").join(prod.select("id", "code").hint("merge"), "code")
    models = prod.filter("model <> ''").select("model").distinct()
    grams = models.select("model", F.explode(F.array_distinct(F.concat(_grams(F.col("model"), 2), _grams(F.col("model"), 3)))).alias("gram"))
    inside = codes.withColumn("gram", F.substring("x", 1, 3)).join(grams, "gram").filter(F.contains("model", F.col("x"))).select("r", "model").distinct()
    inside = inside.join(prod.select("id", "model").hint("merge"), "model")
    taxes = prod.filter("hsn <> ''").select("id", F.explode(F.array_distinct(F.concat(F.array("hsn"), *[F.array(F.substring("hsn", 1, n)) for n in (6, 7, 8)]))).alias("key"))
    tax = req.select("r", F.explode("hsns").alias("key")).join(taxes.hint("merge"), "key")
    return equal.select("r", "id").unionByName(inside.select("r", "id")).unionByName(tax.select("r", "id"))


def preferences(req: DataFrame, products: DataFrame) -> DataFrame:
    """(r, brands, files, words): brands and catalogue files that a request names, signs taken as blanks.

    A brand counts if fewer than COMMON rows of other brands have it in their name, a word of a file name if fewer than COMMON
    names use it. Runs of up to four words of a request meet the names of brands by equal keys.
    """
    name, brand = F.upper("product"), F.trim(F.upper(F.coalesce("brand", F.lit(""))))
    rows = products.select(name.alias("name"), brand.alias("brand"), "file_name")
    brands = rows.filter(F.col("brand").rlike(r"^[A-Z][A-Z &.'-]+$") & (F.length("brand") >= 3)).select("brand").distinct()
    brands = brands.withColumn("key", normal(F.col("brand"))).filter("key <> ''")
    runs = lambda s: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.array_join(F.slice(s, i, n), " ")))))
    split = lambda c: F.split(normal(c), " ")
    named = rows.filter("brand <> '' and name is not null").groupBy("name", "brand").agg(F.count("*").alias("rows"))
    named = named.select("rows", F.col("brand").alias("own"), F.explode(runs(split(F.col("name")))).alias("key")).join(brands, "key")
    common = named.filter(~F.contains("own", F.col("brand"))).groupBy("brand").agg(F.sum("rows").alias("n")).filter(F.col("n") >= COMMON).select("brand")
    brands = brands.join(common, "brand", "left_anti")
    used = products.select(F.explode(F.regexp_extract_all(F.lower("product"), F.lit("[a-z]{3,}"), F.lit(0))).alias("key")).groupBy("key").count().filter(F.col("count") >= COMMON).select("key")
    files = products.select("file_name").distinct().select("file_name", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("file_name"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("key"))
    files = files.filter(~F.col("key").isin(GENERIC_FILE_WORDS)).join(used, "key", "left_anti")
    keys = req.select("r", F.explode(runs(split(F.col("t")))).alias("key"))
    found = keys.join(brands, "key").groupBy("r").agg(F.collect_set("brand").alias("brands"), F.collect_set("key").alias("phrases"))
    filed = keys.join(files, "key").groupBy("r").agg(F.collect_set("file_name").alias("files"), F.collect_set("key").alias("words"))
    return found.join(filed, "r", "full")


def context_lines(req: DataFrame, prefs: DataFrame) -> DataFrame:
    """(r) of the lines that only name a brand or file: all their words are filler or theirs."""
    none = F.array().cast("array<string>")
    rows = req.select("r", "t").join(prefs, "r")
    own = F.concat(F.flatten(F.transform(F.coalesce("phrases", none), lambda p: F.split(p, " "))), F.coalesce("words", none))
    words = F.regexp_extract_all("t", F.lit("[a-z]+"), F.lit(0))
    open_ = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(FILLER))
    return rows.filter((F.size(words) > 0) & (F.size(F.array_except(open_, own)) == 0)).select("r")


# ---------------------------------------------------------------- classes of rows


def _key(*columns: str | Column) -> Column:
    """128 bits that stand for the values of ``columns``."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))


def classed(prod: DataFrame, req: DataFrame, hits: dict[str, DataFrame], s: Scores) -> DataFrame:
    """``prod`` with the asked words of its texts, and with the classes of its name (``nc``) and specification (``sc``).

    Rows of one class cover the same asked words, have names of one length and add the same words; a name that some request
    equals has a class of its own. ``flag`` is what price and picture add to a score.
    """
    first = lambda *columns: F.first(F.struct(*columns)).alias("x")
    names = prod.groupBy("name", "brand").agg(first("ntoks", "hcore", "human_added", "name_key", "human_key")).select("name", "brand", "x.*")
    specs = prod.groupBy("spec", "brand").agg(first("spec_added")).select("spec", "brand", "x.*")
    names, specs = _with_words(names, "name", hits["name"], "nwords"), _with_words(specs, "spec", hits["spec"], "swords")
    asked = req.filter("tn <> ''").select("tn").distinct()
    for key in ("name_key", "human_key"):
        names = names.join(asked.select(F.col("tn").alias(key), F.col("tn").alias(f"{key}_asked")), key, "left")
    short = req.select(F.explode("short").alias("w")).agg(F.collect_set("w").alias("asked_short"))  # words of two letters
    names = names.join(F.broadcast(short), F.lit(True)).withColumn("nshort", F.array_sort(F.array_intersect("ntoks", "asked_short")))
    names = names.withColumns({"long": F.least(F.length("name"), F.lit(s.name_most)), **{c: F.array_sort(c) for c in ("nwords", "hcore", "human_added")}})
    names = names.withColumn("nc", _key("nwords", "nshort", "long", "hcore", "human_added", "name_key_asked", "human_key_asked"))
    names = names.select("name", "brand", "nwords", "nshort", "long", "name_key_asked", "human_key_asked", "nc")
    specs = specs.withColumn("swords", F.array_sort("swords")).select("spec", "brand", "swords", _key("swords", F.array_sort("spec_added")).alias("sc"))
    flag = F.when(F.col("price") > 0, s.priced).otherwise(0) + F.when(F.col("image"), s.pictured).otherwise(0)
    return prod.hint("merge").join(names, ["name", "brand"]).hint("merge").join(specs, ["spec", "brand"]).withColumn("flag", flag)


def _scopes(asks: DataFrame, prod: DataFrame, s: Scores) -> DataFrame:
    """(r, kind, scope, bonus): all rows, and those of the brands and files that a request without a code prefers."""
    open_ = asks.filter("not coded")
    own = prod.select(F.upper("brand").alias("own")).distinct().filter("own <> ''")
    named = open_.select("r", F.explode("brands").alias("b")).join(own, F.contains("b", F.col("own")) | F.contains("own", F.col("b")))
    parts = [asks.select("r", F.lit("a").alias("kind"), F.lit("").alias("scope")), named.select("r", F.lit("b").alias("kind"), F.concat(F.lit("b"), "own").alias("scope")).distinct()]
    parts.append(open_.select("r", F.lit("f").alias("kind"), F.explode(F.transform("files", lambda x: F.concat(F.lit("f"), x))).alias("scope")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("bonus", F.when(F.col("kind") == "a", 0).otherwise(s.preferred))


def _members(prod: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows of every scope with their places in their classes by id: of one name, of one name and specification, of one specification."""
    wanted = F.broadcast(scopes.select("scope").distinct())
    rows = prod.select("id", "nc", "sc", "nshort", "flag", F.explode(F.array_compact(F.array(F.lit(""), F.concat(F.lit("b"), F.upper("brand")), F.concat(F.lit("f"), "file_name")))).alias("scope"))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys, "scope", "flag").orderBy("id"))
    return rows.join(wanted, "scope", "left_semi").withColumns({"at1": place("nc"), "at2": place("nc", "sc"), "at3": place("sc", "nshort")})


def _floor(rows: DataFrame, asks: DataFrame, s: Scores) -> DataFrame:
    """(r, floor): the score that the first ``need`` rows of a request reach at least, by classes (r, kind, low, n); rows of one kind are
    counted once. Requests whose band of equal goods is sorted by price (``wide``) also get what lies within the band."""
    run = Window.partitionBy("r", "kind").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = rows.groupBy("r", "kind", "low").agg(F.sum("n").alias("n")).withColumn("n", F.sum("n").over(run))
    per = per.join(asks.select("r", "need", "wide"), "r").groupBy("r", "wide").agg(F.max(F.when(F.col("n") >= F.col("need"), F.col("low"))).alias("floor"), F.max("low").alias("top"))
    floor = F.coalesce("floor", F.lit(0))
    return per.select("r", F.when(F.col("wide"), F.least(floor, F.col("top") - s.band)).otherwise(floor).alias("floor"))


def class_candidates(asks: DataFrame, prod: DataFrame, hits: dict[str, DataFrame], s: Scores, most: int, past: DataFrame | None = None) -> DataFrame:
    """(r, id) of the rows that can be among the first ``most`` of a request by words and names, and of all that carry its sizes.

    A row's score by words follows from its class: from that of its name alone, or with that of its specification where the name
    leaves words open. Codes, tax codes, numbers, past choices and likeness only raise a row, so the first rows of a class by id
    stand for it. Past choices (t, name, model) are candidates where their class is met; the others are made elsewhere. A request without digits needs its first ``most`` rows. One with sizes or codes
    is narrowed to the rows that carry them, of which all are candidates, and needs its best score otherwise. One with other
    digits gets every row of the classes within the band of the best, for these may be sorted by price.
    """
    c = F.col
    sized = F.size("groups") > 0
    asks = asks.withColumns({"need": F.when(sized, 1).otherwise(most), "wide": c("digit") & ~sized})
    full = F.struct("nwords", "nshort", "long", "hcore", "name_key_asked", "human_key_asked")
    names = materialize(prod.groupBy("nc").agg(F.first(full).alias("x"), F.count("*").alias("rows")).select("nc", "rows", "x.*"), "cascade-names")
    specs = materialize(prod.groupBy("sc").agg(F.first("swords").alias("swords")), "cascade-specs")
    scopes = materialize(_scopes(asks, prod, s), "cascade-scopes")
    members = materialize(_members(prod, scopes), "cascade-members")
    sizes = {keys: materialize(members.groupBy(*keys).agg(F.count("*").alias("n")), "cascade-sizes") for keys in (("nc", "scope"), ("nc", "scope", "flag"), ("nc", "sc", "scope", "flag"), ("sc", "nshort", "scope", "flag"))}

    # Names that a request meets by its rarest words, by their own rarest word, or by equality.
    words, picks = _picked(asks, hits, s.part_share)
    by_name = words.filter(picks["name"]).select("r", "word").join(names.select("nc", F.explode("nwords").alias("word")), "word").select("r", "nc")
    by_spec = words.filter(picks["spec"]).join(specs.select("sc", F.explode("swords").alias("word")), "word")
    asked = asks.select("r", "core", "short", "digit", "tn", "twords", F.size("core").alias("n"))
    # A specification that has the rarest word needs a name with what it lacks.
    lacks = by_spec.filter("either = 1 and n > 1").select("r", "sc").distinct().join(asked.select("r", "core"), "r").join(specs, "sc")
    lacks = lacks.select("r", "sc", "core", F.array_except("core", "swords").alias("lacks")).join(sizes["nc", "sc", "scope", "flag"].select("nc", "sc").distinct(), "sc")
    lacks = lacks.join(names.select("nc", "nwords"), "nc").filter((F.size(F.array_except("lacks", "nwords")) == 0) & F.arrays_overlap("core", "nwords")).select("r", "nc")
    own = names.select("nc", "rows", F.explode(F.array_distinct("hcore")).alias("word"))
    own = own.join(own.groupBy("word").agg(F.sum("rows").alias("n")), "word").groupBy("nc").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    reverse = asks.select("r", F.explode("twords").alias("word")).join(own, "word").select("r", "nc")
    equal = names.select("nc", F.explode(F.array_compact(F.array("name_key_asked", "human_key_asked"))).alias("tn")).join(asks.select("r", "tn"), "tn").select("r", "nc")
    met = by_name.unionByName(lacks).unionByName(reverse).unionByName(equal).distinct().join(names, "nc").join(asked, "r")

    n, in_name = c("n"), lambda w: F.array_contains("nwords", w)
    met = _fixed(met, F.size(F.filter("core", in_name)).alias("named"), (s.short * F.size(F.filter("short", lambda w: F.array_contains("nshort", w)))).alias("added"))
    exact = (c("tn") != "") & (F.coalesce(c("tn") == c("name_key_asked"), F.lit(False)) | F.coalesce(c("tn") == c("human_key_asked"), F.lit(False)))
    met = _fixed(met, exact.alias("exact"), ((c("named") == n) & (n > 0)).alias("settled"))
    within = (F.size("hcore") > 0) & ((F.size("hcore") >= 2) | (n < 2)) & F.forall("hcore", lambda w: F.array_contains("twords", w))
    base = (
        F.when(c("exact"), s.exact).when(c("settled"), F.lit(s.name) - c("long")).when(within, F.lit(s.reverse) + s.reverse_word * F.size("hcore"))
        .when((c("named") > 0) & (c("named") >= n * s.part_share), F.lit(s.part) + s.part_word * c("named"))
    )
    met = _fixed(met, base.alias("base"), (~c("exact") & ~c("settled") & (n > 1) & (c("named") > 0)).alias("open"), (F.lit(s.name_spec) - c("long")).alias("whole"))
    # A code would not raise a row whose name alone scores as much.
    deep = c("digit") & ~c("exact") & (c("base") >= s.within_model)
    low = F.when(deep | c("base").isNull(), F.lit(None).cast("int")).when(c("open"), F.least("base", "whole")).otherwise(c("base"))
    high = F.when(c("open"), F.greatest("base", "whole")).otherwise(c("base"))
    met = met.select("r", "nc", "open", F.coalesce(deep, F.lit(False)).alias("deep"), (c("base") + c("added")).alias("base"), (c("whole") + c("added")).alias("whole"), (low + c("added")).alias("low"), (high + c("added")).alias("high"))
    met = materialize(met.filter("high is not null"), "cascade-met")
    specced = by_spec.select("r", "sc").distinct().join(specs, "sc").join(asked, "r").withColumn("k", F.size(F.filter("core", lambda w: F.array_contains("swords", w))))
    forgiving = (F.size("short") > 0) | c("digit")
    specced = specced.filter((c("k") >= 1) & (c("k") >= F.when(forgiving, n - 1).otherwise(n)) & (((c("k") == n) & (n > 1)) | forgiving))
    specced = materialize(specced.select("r", "sc", "short"), "cascade-specced")

    # Classes that can reach the floor, then the classes at it.
    lows = met.filter("low is not null").join(scopes, "r").join(sizes["nc", "scope"], ["nc", "scope"]).select("r", "kind", (c("low") + c("bonus")).alias("low"), "n")
    first = materialize(_floor(lows, asks, s), "cascade-floor")
    reach = lambda rows, high: rows.join(scopes, "r").join(first, "r", "left").filter(high + c("bonus") + (s.priced + s.pictured) >= F.coalesce("floor", F.lit(0)))
    kept = materialize(reach(met, c("high")).drop("floor", "low", "high"), "cascade-kept")
    none = lambda kind: F.lit(None).cast(kind)
    columns = ["r", "kind", "scope", "flag", "n", "deep", "nc"]
    one = kept.filter("not open").join(sizes["nc", "scope", "flag"], ["nc", "scope"])
    one = one.select(*columns, none("binary").alias("sc"), none("array<string>").alias("nshort"), (c("base") + c("bonus") + c("flag")).alias("low"), F.lit(1).alias("way"))
    two = kept.filter("open").join(sizes["nc", "sc", "scope", "flag"], ["nc", "scope"]).join(names.select("nc", "nwords"), "nc").join(specs, "sc").join(asks.select("r", "core"), "r")
    complete = F.size(F.array_except("core", F.concat("nwords", "swords"))) == 0
    two = two.select(*columns, "sc", none("array<string>").alias("nshort"), (F.when(complete, c("whole")).otherwise(c("base")) + c("bonus") + c("flag")).alias("low"), F.lit(2).alias("way"))
    three = specced.join(sizes["sc", "nshort", "scope", "flag"], "sc").withColumn("base", F.lit(s.spec) + s.short * F.size(F.array_intersect("short", "nshort")))
    three = three.join(scopes, ["r", "scope"]).select("r", F.concat("kind", F.lit("s")).alias("kind"), "scope", "flag", "n", F.lit(False).alias("deep"), none("binary").alias("nc"), "sc", "nshort", (c("base") + c("bonus") + c("flag")).alias("low"), F.lit(3).alias("way"))
    three = three.join(first, "r", "left").filter(c("low") >= F.coalesce("floor", F.lit(0))).drop("floor")
    classes = materialize(one.unionByName(two.filter("low is not null")).unionByName(three), "cascade-classes")
    chosen = classes.join(_floor(classes.filter("not deep"), asks, s), "r", "left").filter(c("low") >= F.coalesce("floor", F.lit(0)))
    chosen = chosen.join(asks.select("r", "need", "wide"), "r").withColumn("last", F.when(c("wide") | c("deep"), 1 << 62).otherwise(c("need"))).drop("kind", "floor", "n")
    chosen = materialize(chosen, "cascade-chosen")
    out = fitting(asks, prod, met, specced)
    for way, keys in ((1, ["nc"]), (2, ["nc", "sc"]), (3, ["sc", "nshort"])):
        some = chosen.filter(c("way") == way).select("r", *keys, "scope", "flag", "last").join(members.hint("merge"), [*keys, "scope", "flag"])
        out = out.unionByName(some.filter(c(f"at{way}") <= c("last")).select("r", "id"))
    if past is not None:
        again = past.join(asks.filter("not coded").select("r", "t"), "t").join(prod.select("id", "name", "model", "nc", "sc").hint("merge"), ["name", "model"])
        again = again.join(met.select("r", "nc", F.lit(True).alias("named")), ["r", "nc"], "left").join(specced.select("r", "sc", F.lit(True).alias("specced")), ["r", "sc"], "left")
        out = out.unionByName(again.filter("named or specced").select("r", "id"))
    return out


def fitting(asks: DataFrame, prod: DataFrame, names: DataFrame, specs: DataFrame) -> DataFrame:
    """(r, id) of the rows that carry the sizes and codes of a request, or its small numbers before a unit, in the classes it meets.

    Different sizes meet rows by equal runs of digits, then the exact test.
    """
    none = F.array().cast("array<string>")
    asks = asks.select("r", "groups", F.when(F.size("groups") > 0, none).otherwise(F.array_distinct("small")).alias("small")).filter("size(groups) > 0 or size(small) > 0")
    asks = materialize(asks.withColumn("q", _key("groups", "small")), "cascade-sizes-asked")
    # The first run of a group is whole in the text where a sign follows it, else it starts one.
    first = F.get(F.get("groups", F.lit(0)), F.lit(0))
    run = F.concat(F.when(first.rlike("[0-9][^0-9]"), "=").otherwise("~"), F.regexp_extract(first, "[0-9]+", 0))
    keys = F.when(F.size("groups") > 0, F.array(run)).otherwise(F.transform("small", lambda x: F.concat(F.lit("="), x)))
    kinds = asks.dropDuplicates(["q"]).select("q", "groups", "small", F.explode(keys).alias("key"))
    rows = prod.select("id", "nc", "sc", F.concat_ws(" ", "name", "model", "spec").alias("hay")).withColumn("runs", F.array_distinct(F.regexp_extract_all(squeezed(F.col("hay")), F.lit("[0-9]+"), F.lit(0))))
    starts_ = F.flatten(F.transform("runs", lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.lit("~"), F.substr(x, F.lit(1), i)))))
    rows = rows.withColumn("key", F.explode(F.array_distinct(F.concat(F.transform("runs", lambda x: F.concat(F.lit("="), x)), starts_)))).drop("runs")
    fit = F.when(F.size("groups") > 0, R.qualified(F.col("groups"), F.col("hay"))).otherwise(hinted(F.col("small"), F.col("hay")))
    rows = materialize(kinds.join(rows, "key").filter(fit).select("q", "id", "nc", "sc").distinct(), "cascade-fitting")
    asks = asks.select("r", "q")
    by_name = asks.join(names.select("r", "nc"), "r").join(rows.hint("merge"), ["q", "nc"]).select("r", "id")
    return by_name.unionByName(asks.join(specs.select("r", "sc"), "r").join(rows.hint("merge"), ["q", "sc"]).select("r", "id"))


# ---------------------------------------------------------------- the cascade


def squeezed(hay: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(hay, " ", ""), r"[*×]", "x")


def hinted(small: Column, hay: Column) -> Column:
    """Whether a text has one of the small numbers before a unit."""
    units = F.array(*map(F.lit, ('"', "''", *"in cm mm l ml qt oz comp".split())))  # inch and ltr start with a shorter one
    seen = lambda h, x: F.exists(units, lambda u: F.contains(h, F.concat(F.lit(R.MARK), x, u)))
    return F.exists(F.array(R.marked(squeezed(hay))), lambda h: F.exists(small, lambda x: seen(h, x)))


def _fixed(rows: DataFrame, *columns: Column) -> DataFrame:
    """``rows`` with ``columns``, each computed once a row: as the output of a generator they are not written out again into filters and later columns."""
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def _judged(pairs: DataFrame, s: Scores) -> DataFrame:
    """Pairs with a tier: tier, score, extra (words the request did not ask for), boosted."""
    c = F.col
    in_name = lambda w: F.array_contains("nwords", w)
    in_spec = lambda w: F.array_contains("swords", w)
    in_request = lambda w: F.array_contains("twords", w)
    none = F.array().cast("array<string>")
    rows = _fixed(pairs.withColumn("like", F.coalesce("like", F.lit(0.0))), F.size("core").alias("n"), F.size(F.filter("core", in_name)).alias("named"))
    # The specification and the reverse test are only looked at where the name doesn't settle it.
    settled = (c("named") == c("n")) & (c("n") > 0)
    rows = _fixed(
        rows, settled.alias("settled"), F.when(settled, 0).otherwise(F.size(F.filter("core", in_spec))).alias("specced"),
        F.when(settled, True).otherwise(F.forall("core", lambda w: in_name(w) | in_spec(w))).alias("whole"), F.when(settled, False).otherwise(F.forall("hcore", in_request)).alias("within"),
    )
    same = (c("code") != "") & F.array_contains("stripped", c("code"))
    inside = (c("model") != "") & F.exists("typed", lambda x: F.contains(c("model"), x))
    tax = (c("hsn") != "") & F.exists("hsns", lambda h: c("hsn").startswith(h))
    forgiving = (F.size("short") > 0) | c("digit")
    n, named, specced = c("n"), c("named"), c("specced")
    enough = (specced >= 1) & (specced >= F.when(forgiving, n - 1).otherwise(n)) & (((specced == n) & (n > 1)) | forgiving)
    tier = (
        F.when((c("tn") != "") & ((c("tn") == c("name_key")) | (c("tn") == c("human_key"))), "exact").when(same, "model").when(inside, "model~").when(tax, "hsn")
        .when((n > 0) & (named == n), "name").when((n > 1) & ((named > 0) | (c("like") >= s.like_anchor)) & c("whole"), "name+spec")
        .when((F.size("hcore") > 0) & c("within") & ((F.size("hcore") >= 2) | (n < 2)), "rname").when((named > 0) & (named >= n * s.part_share), "part")
        .when((n > 0) & enough, "spec").when(c("like") >= s.like_only, "sem")
    )
    rows = _fixed(rows, tier.alias("tier")).filter("tier is not null")
    length = F.least(F.length("name"), F.lit(s.name_most))
    base = (
        F.when(c("tier") == "exact", s.exact).when(c("tier") == "model", s.model).when(c("tier") == "model~", s.within_model).when(c("tier") == "hsn", s.hsn)
        .when(c("tier") == "name", F.lit(s.name) - length).when(c("tier") == "name+spec", F.lit(s.name_spec) - length)
        .when(c("tier") == "rname", F.lit(s.reverse) + s.reverse_word * F.size("hcore")).when(c("tier") == "part", F.lit(s.part) + s.part_word * named).when(c("tier") == "spec", s.spec)
        .otherwise(F.lit(s.like_base) + F.floor((c("like") - s.like_only) * s.like_only_rate))
    )
    more = F.when((c("tier") != "sem") & (c("like") > s.like_least), F.floor((c("like") - s.like_least) * s.like_rate)).otherwise(0)
    # Rows of a weak tier must hold a word of the line's own label; those of the weakest its longest word, or most words.
    held = F.filter("anchor", lambda w: in_name(w) | in_spec(w))
    most = F.array_max(F.transform("anchor", F.length))
    key = F.exists("anchor", lambda w: (F.length(w) == most) & in_name(w))
    anchored = (F.exists("anchor", in_name) | (c("like") >= s.like_anchor)) & (~c("tier").isin("spec", "sem") | (F.size(held) > F.floor(F.size("anchor") / 2)) | key)
    open_ = ~c("coded")
    brand = F.upper("brand")
    own = F.exists(F.coalesce("brands", none), lambda b: (brand != "") & (F.contains(b, brand) | F.contains(brand, b)))
    preferred = open_ & (own | F.array_contains(F.coalesce("files", none), c("file_name")))
    whole_word = lambda w: F.array_contains("ntoks", w)
    extra = F.size(F.filter("human_added", lambda w: ~in_request(w))) + F.when(c("tier").isin("name+spec", "spec"), F.size(F.filter("spec_added", lambda w: ~in_request(w)))).otherwise(0)
    rows = rows.filter((F.size("anchor") == 0) | ~c("tier").isin(WORDY) | anchored)
    rows = rows.withColumn("score", (base + more).cast("long") + F.when(preferred, s.preferred).otherwise(0))
    rows = rows.withColumn("boosted", F.when(preferred, "brand").otherwise(""))
    added = s.short * F.size(F.filter("short", whole_word)) + F.when(F.exists("numbers", lambda x: F.contains(c("model"), x)), s.number).otherwise(0)
    added = added + F.when(c("price") > 0, s.priced).otherwise(0) + F.when(c("image"), s.pictured).otherwise(0)
    rows = rows.withColumn("score", c("score") + added)
    again = open_ & (c("score") < s.model) & (F.coalesce(c("times"), F.lit(0)) > 0)
    rows = rows.withColumns({
        "score": c("score") + F.when(again & (c("times") >= 2), s.recurring).when(again, s.once).otherwise(0), "boosted": F.when(again, "hist").otherwise(c("boosted")), "extra": extra,
    })
    return rows.select("r", "id", "groups", "small", "tier", "score", "extra", "boosted", "like", "price", "digit", F.concat_ws(" ", "name", "model", "spec").alias("hay"))


def _narrowed(rows: DataFrame, s: Scores) -> DataFrame:
    """Rows at the cutoff; where the request names sizes, of all rows those that carry every one, first of the kept, else of the rest."""
    by = Window.partitionBy("r")
    cut = F.least(F.max("score").over(by) * s.cutoff_share, F.lit(float(s.cutoff_most)))
    sizes = F.size("groups") > 0
    rows = rows.withColumns({"kept": F.col("score") >= cut, "sized": sizes, "fits": F.when(sizes, R.qualified(F.col("groups"), F.col("hay"))).otherwise(True)})
    rows = rows.withColumn("any", F.max((F.col("kept") & F.col("fits")).cast("int")).over(by))
    sized = F.col("fits") & (F.col("kept") | (F.col("any") == 0))
    rows = rows.filter(F.when(F.col("sized"), sized).otherwise(F.col("kept")))
    # A small number without a unit narrows to rows that carry it before a unit, if any do.
    rows = rows.withColumn("hint", ~F.col("sized") & hinted(F.col("small"), F.col("hay")))
    return rows.withColumn("any", F.max(F.col("hint").cast("int")).over(by)).filter((F.col("any") == 0) | F.col("hint"))


def _cheapest_first(rows: DataFrame, s: Scores) -> DataFrame:
    """Among the rows that are the same goods as the first, fewer added words, then priced, then cheaper ones go first."""
    c = F.col
    by = Window.partitionBy("r").orderBy(F.desc("score"), "id")
    to_here = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = lambda x: F.first(x).over(to_here)
    rows = rows.withColumns({"at": F.row_number().over(by), **{f"top_{x}": top(x) for x in ("tier", "score", "boosted", "like", "extra")}})
    close = F.abs(c("like") - c("top_like"))
    coded = c("digit") | c("top_tier").isin("model", "model~")
    same = c("boosted") == c("top_boosted")
    near = same & (c("tier") == c("top_tier")) & (c("top_score") - c("score") <= s.band) & (c("top_tier").isin("exact", "model", "hsn") | (close <= s.band_like))
    member = c("top_tier").isin(COMPLETE) & c("tier").isin(COMPLETE) & same & (c("extra") <= c("top_extra")) & (close <= s.members_like) & (c("at") <= s.members_of)
    rows = rows.withColumn("near", near.cast("int")).withColumn("band", F.when(coded, F.min("near").over(to_here)).otherwise(member.cast("int")))
    rows = rows.withColumn("band", F.when(c("top_tier").isin(STRONG), c("band")).otherwise(0))
    extra = F.when(coded & (c("top_tier") == "hsn"), 0).otherwise(c("extra"))
    inside = c("band") == 1
    last = Window.partitionBy("r").orderBy(
        F.desc("band"), F.when(inside, extra), F.when(inside, F.coalesce(c("price"), F.lit(0)) <= 0), F.when(inside, F.coalesce(c("price"), F.lit(0))), "at"
    )
    return rows.withColumn("rank", F.row_number().over(last))


def resolve(requests: DataFrame, products: DataFrame, k: int = 15, history: DataFrame | None = None, similar: DataFrame | None = None, scores: Scores | None = None) -> DataFrame:
    """Rows of each request, best first: request, id, tier, score, rank; requests without any keep a row with null id (not_found).

    requests: request, phrase and perhaps label, the client's own name of a line whose specification is part of the phrase.
    products: id, product, brand, model, spec, hsn, price, image, file_name. history: phrase, product, model, times.
    similar: phrase, id, like (0 to 1). Lines that only name a brand or catalogue keep one row of tier ``context``.
    """
    s = scores or Scores()
    req = materialize(requests_of(requests).withColumn("r", F.monotonically_increasing_id()), "cascade-requests")
    prod = materialize(products_of(products), "cascade-products")
    prefs = materialize(preferences(req, products), "cascade-preferences")
    lines = context_lines(req, prefs)
    hits = covered_words(req, prod)
    prod = materialize(classed(prod, req, hits, s), "cascade-offers")
    own = prod.select(F.explode(F.array_distinct(F.concat("hcore", "human_added", "spec_added"))).alias("word"))
    back = materialize(covering(own, req.select(F.col("t").alias("text"))), "cascade-back")
    # The word of a preferred catalogue has done its job.
    asks = _without_file_words(req, prefs).join(prefs.select("r", "brands", "files"), "r", "left").join(lines, "r", "left_anti")
    asks = materialize(_with_words(asks, "t", back, "twords"), "cascade-asks")
    past = None
    if history is not None:
        past = history.select(F.trim(F.lower("phrase")).alias("t"), F.trim(F.lower("product")).alias("name"), F.trim(F.lower(F.coalesce("model", F.lit("")))).alias("model"), "times")
        past = materialize(past.groupBy("t", "name", "model").agg(F.sum("times").alias("times")), "cascade-past")
    pairs = code_candidates(asks, prod).unionByName(class_candidates(asks.filter("size(anchor) = 0"), prod, hits, s, max(s.members_of, k), past))
    if "label" in requests.columns:  # a label is looked for in each row
        held = materialize(asks.filter("size(anchor) > 0"), "cascade-labelled")
        pairs = pairs.unionByName(word_candidates(held, prod, s.part_share, hits)).unionByName(reverse_candidates(held, prod)).unionByName(name_candidates(held, prod))
    like = None
    if similar is not None:
        like = asks.select("r", "t").join(similar.select(F.trim(F.lower("phrase")).alias("t"), "id", "like"), "t").groupBy("r", "id").agg(F.max("like").alias("like"))
        pairs = pairs.unionByName(like.select("r", "id"))
    pairs = materialize(pairs.distinct(), "cascade-pairs")
    # Judging a pair costs more than its bytes tell, so it is dealt by numbers of pairs.
    lanes = -(-pairs.count() // PAIRS_A_TASK) or 1
    pairs = pairs.join(like, ["r", "id"], "left") if like is not None else pairs.withColumn("like", F.lit(0.0))
    # Pairs are narrow while they meet the products, the larger side.
    rows = pairs.repartition(lanes, "id").join(prod.hint("merge"), "id").join(asks, "r")
    if past is not None:
        rows = rows.join(past, ["t", "name", "model"], "left")
    else:
        rows = rows.withColumn("times", F.lit(0))
    judged = materialize(_judged(rows, s), "cascade-judged")
    ranked = _cheapest_first(_narrowed(judged, s), s).filter(F.col("rank") <= k)
    found = ranked.select("r", "id", "tier", "score", "rank")
    label = F.col("label") if "label" in requests.columns else F.lit(None).cast("string")
    asked = requests.select("request", F.coalesce(F.trim(F.lower("phrase")), F.lit("")).alias("phrase_"), F.trim(F.lower(label)).alias("label_"))
    asked = asked.join(req.select("r", "t", "label"), F.col("phrase_").eqNullSafe(F.col("t")) & F.col("label_").eqNullSafe(F.col("label"))).select("request", "r")
    rows = asked.join(lines.withColumn("context", F.lit(True)), "r", "left").join(found, "r", "left")
    return rows.select("request", "id", F.coalesce("tier", F.when(F.col("context"), "context"), F.lit("not_found")).alias("tier"), "score", "rank")


def _without_file_words(req: DataFrame, prefs: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = req.join(prefs.select("r", "words"), "r", "left")
    return rows.withColumn("core", F.filter("core", lambda w: ~F.array_contains(F.coalesce(F.col("words"), none), w))).drop("words")


# ---------------------------------------------------------------- before the cascade


def corrected(requests: DataFrame, products: DataFrame) -> DataFrame:
    """``requests`` with their words repaired: abbreviations, cut words and typing errors of words of the products; the rest stays as typed."""
    seen = products.select(F.explode(F.regexp_extract_all(F.lower("product"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    pieces = F.regexp_extract_all(F.lower("phrase"), F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    rows = requests.select("phrase").distinct().select("phrase", F.posexplode(pieces).alias("at", "word"))
    found = match.repairs(rows.filter("word rlike '^[a-z]{2,}$'").select("word"), materialize(seen, "corrected-words"))
    rows = rows.join(found, "word", "left").groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("near", "word").alias("word")))).alias("words"))
    texts = rows.select("phrase", F.array_join("words.word", "").alias("_text"))
    return requests.join(texts, "phrase", "left").withColumn("phrase", F.coalesce("_text", "phrase")).drop("_text").select(*requests.columns)


def prepared(requests: DataFrame, products: DataFrame) -> DataFrame:
    """``requests`` as the cascade should read them: one spelling of units, joined words that the catalogue joins, repaired words."""
    rows = requests.withColumn("phrase", X.norm_units(F.coalesce("phrase", F.lit(""))))
    texts = rows.select(F.col("phrase").alias("request"), "phrase").distinct()
    joined = R.merge_compounds(texts, products.select(F.col("product").alias("name")).distinct()).select(F.col("request").alias("phrase"), F.col("phrase").alias("_text"))
    rows = rows.join(joined, "phrase", "left").withColumn("phrase", F.coalesce("_text", "phrase")).drop("_text").select(*requests.columns)
    return corrected(rows, products)
