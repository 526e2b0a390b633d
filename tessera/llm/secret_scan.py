"""Secret scan: fixed patterns plus character Markov models, in DataFrame functions only.

``base`` spans come from three patterns. Further spans (kind ``markov``) are runs of
token characters whose bigram log-likelihood ratio between a model of random strings
and a model of ordinary identifiers exceeds a threshold. Both models are first-order
Markov chains over 64 token characters (and "other"), counted from labelled samples: digests
and keys in several alphabets and lengths against words of the corpus, identifiers made of them
(snake, kebab and camel case, paths, capitals, numbered names) and strings of digits (card and
phone numbers, dates). Half of the samples train; the threshold comes from the other half.

Positions: a text is split by a pattern, and the lengths of pieces and matches add up
to code point offsets, so no row function is needed. Everything is a projection: no
shuffle but for the (bounded) model.

Defined results: null text counts as empty (no spans); equal rows get equal results;
markov spans never overlap base spans; further columns are untouched; an empty table
gives an empty result, and a model without samples scores 0 everywhere (no spans).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh

# The patterns of the contract. The least lengths of access and hex are part of
# the pattern, which is the same as dropping shorter matches: a match fills its run of characters.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}

#: Characters of the Markov models; index 0 stands for any other.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
STATES = len(ALPHABET) + 1
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
#: Shares of the held-out samples that set the threshold on the mean log-likelihood ratio per bigram.
ORDINARY_BELOW, RANDOM_ABOVE = 0.998, 0.02
#: Weight of a character's own frequency against its frequency after the one before.
BACK_OFF = 5.0
#: Bounds of the labelled samples: documents whose words make ordinary identifiers, and strings of each label that are made up.
SAMPLE_DOCS = 100
SAMPLE_STRINGS = 3000


def _located(pieces: Column, matches: Column) -> Column:
    """array<struct<s,e,m>> of the matches, with code point offsets; the arguments are plain columns."""
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def step(acc, i):
        s = acc["at"] + F.length(F.element_at(pieces, i))
        e = s + F.length(F.element_at(matches, i))
        span = F.struct(s.alias("s"), e.alias("e"), F.element_at(matches, i).alias("m"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    run = F.aggregate(F.sequence(F.lit(1), F.size(matches)), start, step, lambda acc: acc["out"])
    return F.when(F.size(matches) > 0, run).otherwise(empty)


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def _states(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(ALPHABET), c)))


def _bigrams(states: Column) -> Column:
    """array<int> of STATES * a + b over neighbouring states."""
    n = F.size(states) - 1
    return F.zip_with(F.slice(states, 1, n), F.slice(states, 2, n), lambda a, b: a * STATES + b)


def default_samples(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(text, label, part): label 1 random strings, 0 ordinary ones; part 0 trains, 1 is held out.

    At most SAMPLE_DOCS documents, chosen by hash of their ids, whose words are all used, and
    SAMPLE_STRINGS made-up strings of each label.
    """
    spark = docs.sparkSession
    ids = [r[0] for r in docs.select(id_col).filter(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_DOCS).collect()]
    i = F.col("id")
    key, long = F.sha2(i.cast("string"), 256), F.sha2((-i - 1).cast("string"), 512)
    plain64 = F.regexp_replace(F.base64(F.unhex(long)), "[+/=]", "")
    size = (F.lit(16) + i % 29).cast("int")
    forms = [F.md5(i.cast("string")), F.substring(long, F.lit(1), size), F.base64(F.unhex(key)), F.substring(plain64, F.lit(1), size), F.substring(F.upper(plain64), F.lit(1), size)]
    pick = lambda of, n: F.element_at(F.array(*of), (n % len(of) + 1).cast("int"))
    digits = F.substring(F.regexp_replace(long, "[a-f]", ""), F.lit(1), (F.lit(12) + i % 11).cast("int"))
    made = spark.range(SAMPLE_STRINGS)
    samples = made.select(pick(forms, i).alias("text"), F.lit(1).alias("label"), (i / len(forms) % 2).cast("int").alias("part"))
    samples = samples.unionByName(made.select(digits.alias("text"), F.lit(0).alias("label"), (i % 2).cast("int").alias("part")))
    if not ids:
        return samples
    rows = docs.filter(F.col(id_col).isin(ids)).select(F.filter(F.split(F.col(text), r"[^A-Za-z]+"), lambda w: F.length(w) >= 3).alias("w"))

    def identifier(n):
        a, b, c = (F.element_at("w", n + k) for k in range(3))
        camel = F.concat(a, F.initcap(b), F.initcap(c))
        number = F.pmod(F.xxhash64(a, n), F.lit(10000)).cast("string")
        return pick([a, F.concat_ws("_", a, b, c), F.concat_ws("-", a, b, c), camel, F.concat_ws("/", a, b, c), F.upper(F.concat_ws("_", a, b, c)), F.concat_ws("_", a, b, number), F.upper(a)], n)

    names = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda n: F.struct(identifier(n).alias("text"), F.lit(0).alias("label"), (F.floor(n / 8) % 2).cast("int").alias("part")))
    return samples.unionByName(rows.filter(F.size("w") > 2).select(F.inline(names)))


def train_markov(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each bigram (STATES * a + b): at most STATES^2 numbers reach the driver."""
    counted = (
        samples.filter(F.length("text") > 1)
        .select("label", F.explode(_bigrams(_states(F.col("text")))).alias("b"))
        .groupBy("label", "b")
        .count()
        .collect()
    )
    if not counted:
        return [0.0] * STATES**2
    model = {}
    for label in (0, 1):
        n = [0.0] * STATES**2
        for own, b, count in counted:
            if own == label:
                n[b] += count
        into = [sum(n[b::STATES]) + 1 for b in range(STATES)]
        all_, row = sum(into), [sum(n[a * STATES : (a + 1) * STATES]) for a in range(STATES)]
        model[label] = [(n[i] + BACK_OFF * into[i % STATES] / all_) / (row[i // STATES] + BACK_OFF) for i in range(STATES**2)]
    return [math.log(model[1][i] / model[0][i]) for i in range(STATES**2)]


def token_score(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per bigram of a token (null for fewer than two characters)."""
    llr = F.lit([float(x) for x in model])
    b = _bigrams(_states(token))
    total = F.aggregate(b, F.lit(0.0), lambda acc, x: acc + F.element_at(llr, x + 1))
    return F.when(F.length(token) > 1, total / (F.length(token) - 1))


def held_out(samples: DataFrame, model: list[float]) -> tuple[float, float, float]:
    """Threshold from held-out samples that are long enough to be tokens, and precision and recall of those at it."""
    rows = samples.filter(F.col("text").rlike(f"^{TOKEN}$")).select("label", token_score(F.col("text"), model).alias("s"))
    s = lambda label, q: F.percentile(F.when(F.col("label") == label, F.col("s")), F.lit(q))
    low, high = rows.agg(s(0, ORDINARY_BELOW), s(1, RANDOM_ABOVE)).first()
    if low is None or high is None:
        return math.inf, 0.0, 0.0
    cut = max(low, (low + high) / 2)
    right, found, all_ = rows.agg(F.count_if((F.col("label") == 1) & (F.col("s") > cut)), F.count_if(F.col("s") > cut), F.count_if(F.col("label") == 1)).first()
    return cut, right / max(1, found), right / max(1, all_)


def scan_secrets(docs: DataFrame, model: list[float], text: str = "text", threshold: float = 0.0) -> DataFrame:
    """``docs`` plus n_assign, n_access, n_hex, base_sha256 and spans (clashing names are replaced)."""
    new = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    docs = docs.select([c for c in docs.columns if c.lower() not in new])
    (body,) = fresh(docs, "_body")
    patterns = KINDS | {"token": TOKEN}
    m = {k: fresh(docs, f"_m_{k}")[0] for k in patterns}
    p = {k: fresh(docs, f"_p_{k}")[0] for k in patterns}
    at = {k: fresh(docs, f"_s_{k}")[0] for k in patterns}
    base, inner = fresh(docs, "_base", "_inner")
    # One projection a step: each array is computed once and then only referred to.
    rows = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumns({m[k]: F.regexp_extract_all(body, F.lit(x), F.lit(0)) for k, x in patterns.items()})
    rows = rows.withColumns(
        {p[k]: F.when(F.size(m[k]) > 0, F.split(body, x, -1)) for k, x in patterns.items()}
        | {inner: F.when(F.size(m["assign"]) > 0, F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2)))}
    )
    rows = rows.withColumns({at[k]: _located(F.col(p[k]), F.col(m[k])) for k in patterns})
    secret = F.col(inner)
    kept = {k: F.col(at[k]) for k in KINDS}
    kept["assign"] = F.filter(kept["assign"], lambda x, i: F.length(F.element_at(secret, i + 1)) >= ASSIGN_LEAST)

    def tagged(spans, kind, order):
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))

    rows = rows.withColumns({at[k]: tagged(kept[k], k, i) for i, k in enumerate(KINDS)})
    rows = rows.withColumn(base, F.concat(*[at[k] for k in KINDS]))
    apart = F.filter(at["token"], lambda t: ~F.exists(base, lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    random = F.filter(apart, lambda t: token_score(t["m"], model) > threshold)
    rows = rows.withColumn(inner, F.concat(base, tagged(random, "markov", len(KINDS))))
    return rows.select(
        *docs.columns,
        *[F.size(at[k]).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.col(base)).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col(inner)).alias("spans"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    samples = default_samples(docs)
    model = train_markov(samples.filter("part = 0"))
    return scan_secrets(docs, model, threshold=held_out(samples.filter("part = 1"), model)[0]).drop("text")
