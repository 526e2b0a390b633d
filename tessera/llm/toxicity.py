"""Toxicity classifier with a counterfactual penalty on identity terms.

A word is a run of letters (A-Z lower-cased). Its features are the hashes of its first 4 to 8 bytes
and of the whole word, so stems count as well as words. Executors count, over the labelled
documents of the training side, in how many of label 1 a feature occurs, and, for the CANDIDATES that
occur in most, in how many of label 0; the FEATURES that exceed their expected share of label 1 most,
and those of the identity terms, make up the model. The value of a
feature that occurs c times among n words is log(1 + 200 c / (200 + n)): presence in short texts, density in
long ones. A logistic output is fitted by full-batch Adam.

Counterfactuals: in labelled sentences that hold an identity term, the term is swapped for every other
term of its group, the neutral one included; in others (one a document) a term is inserted in place of
the neutral one. The square of the change of the sentence's score is penalised, so a mention of a
group alone moves no score, though toxic sentences may hold more of them.

Bounds: at most TRAIN_DOCS labelled documents (smallest hash of the id) are used, and PAIRS sentences
of them (smallest hash); of each document its features of the model reach the driver, of each sentence those
of identity terms. Scoring reads every whole text in one projection without a shuffle.

Defined results: null and empty text score as a text without words; rows with a null doc_id count as
training side but have no label; several labels of one id use the smallest; without both labels the score
is the share of label 1 (0.5 without labels); equal texts get equal scores; an empty table gives an
empty result; further columns pass through (clashing names are replaced).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import CHUNK, LOWER, U64, arrow_batches, by_value, materialize, mix, prefix_hash, slices, span_hash, word_spans

by_value(__name__)

CUT = 0.5
TRAIN_DOCS, PAIRS, CANDIDATES, FEATURES, LEAST_DOCS = 8000, 4000, 1 << 16, 2048, 3
PREFIXES = (4, 5, 6, 7, 8)
LENGTH = 200.0
COUNTERFACTUAL = 1000.0
#: Groups of terms that a sentence can swap; the first of each is the neutral one.
IDENTITY = (
    ("person", "woman", "man", "girl", "boy"),
    ("people", "women", "men", "girls", "boys"),
    ("people", "christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("religious", "christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("people", "gays", "lesbians", "bisexuals", "heterosexuals"),
    ("any", "gay", "lesbian", "bisexual", "transgender", "heterosexual", "queer"),
    ("any", "black", "white", "asian", "african", "latino", "arab", "indigenous"),
    ("people", "immigrants", "refugees", "foreigners", "natives"),
    ("any", "disabled", "blind", "deaf", "autistic"),
    ("any", "old", "young", "elderly", "teenage"),
)

_WORD_SALT = U64(0x5851F42D4C957F2D)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_LETTER[128:] = True
_SPACED = np.where(_LETTER, LOWER, np.uint8(0x20)).astype(np.uint8)
_END = np.zeros(256, dtype=bool)
_END[list(b".!?\n")] = True


def parts(column: pa.Array):
    """(first row, data, offsets) by slices; a text beyond 4 CHUNK comes in parts that end between words."""
    for first, data, offsets in slices(column):
        at, end = 0, len(data)
        while len(offsets) == 2 and end - at > 4 * CHUNK:
            to = at + CHUNK
            while to < end:  # on to the next sign that is no letter
                gap = np.flatnonzero(~_LETTER[data[to : to + CHUNK]])
                if len(gap):
                    to += int(gap[0])
                    break
                to += CHUNK
            to = min(to, end)
            yield first, data[at:to], np.array([0, to - at])
            at = to
        yield first, data[at:], offsets if at == 0 else np.array([0, end - at])


def features(h: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(hashes, word number) by length of prefix, then of whole words; ``h``: prefix hashes of the text."""
    for k in PREFIXES:
        own = np.flatnonzero(ends - starts >= k)
        yield span_hash(h, starts[own], starts[own] + k), own
    yield mix(span_hash(h, starts, ends) ^ _WORD_SALT), np.arange(len(starts))


def term_features(term: str) -> np.ndarray:
    data = np.frombuffer(term.encode(), np.uint8)
    return np.concatenate([f for f, _ in features(prefix_hash(data), np.array([0]), np.array([len(data)]))])


def counts(column: pa.Array, known: np.ndarray):
    """(first row, number of words by row, row of each count, feature, count) for the features ``known`` (sorted hashes)."""
    for first, data, offsets in parts(column):
        low = _SPACED[data]
        starts, ends, bound = word_spans(low, offsets)
        rows = len(offsets) - 1
        doc = np.repeat(np.arange(rows), np.diff(bound))
        keys = [np.zeros(0, np.int64)]
        for h, word in features(prefix_hash(low), starts, ends):
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            hit = np.flatnonzero(known[at] == h) if len(known) else np.zeros(0, np.int64)
            keys.append(doc[word[hit]] * len(known) + at[hit])
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        yield first, np.diff(bound), key // max(len(known), 1), key % max(len(known), 1), n


def gathered(column: pa.Array, known: np.ndarray):
    """As ``counts``, over all rows of ``column``; the parts of a text are summed."""
    words, keys, sizes = np.zeros(len(column), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, n, row, feature, c in counts(column, known):
        words[first : first + len(n)] += n
        keys.append((row + first) * len(known) + feature)
        sizes.append(c)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.bincount(back, weights=np.concatenate(sizes), minlength=len(key))
    return words, key // max(len(known), 1), key % max(len(known), 1), c


def value(count, words):
    return np.log1p(count * LENGTH / (LENGTH + words))


# ---------------------------------------------------------------- model


def fit(x: np.ndarray, y: np.ndarray, change: np.ndarray, moved: np.ndarray, weight: float = COUNTERFACTUAL, steps: int = 300, rate: float = 0.05, decay: float = 1e-4):
    """(weights, bias) of least log loss plus ``weight`` times v' change v with v = weights[moved], the mean square change of a score.

    Adam takes the steps of the loss, and after each the penalty is followed exactly (a proximal step), so it may be steep.
    """
    settle = np.linalg.inv(np.eye(len(moved)) + 2 * rate * weight * change).astype(np.float32)
    theta, mom, var = (np.zeros(x.shape[1] + 1, np.float32) for _ in range(3))
    theta[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    for t in range(1, steps + 1):
        r = ((1 / (1 + np.exp(-(x @ theta[:-1] + theta[-1])))) - y).astype(np.float32) / np.float32(len(y))
        g = np.append(x.T @ r + np.float32(decay) * theta[:-1], r.sum())
        mom, var = 0.9 * mom + 0.1 * g, 0.999 * var + 0.001 * g * g
        theta = (theta - rate * (mom / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        theta[moved] = settle @ theta[moved]
    return theta[:-1].astype(np.float64), float(theta[-1])


def fold(id_col: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % k


def _terms(identity):
    terms = [(g, t) for g, group in enumerate(identity) for t in group]
    return terms, [term_features(t) for _, t in terms]


def _sentences(column: pa.Array, words_of: dict[int, list[int]], special: np.ndarray):
    """(hash, words, term or -1, features, counts) of the sentences with a term, or of one a document without any.

    ``words_of``: hash of a term -> its numbers; ``special``: sorted hashes of the terms' features.
    """
    heads = np.array(sorted(words_of), np.uint64)
    for _, data, offsets in parts(column):
        low = _SPACED[data]
        starts, ends, bound = word_spans(low, offsets)
        hashed = prefix_hash(low)
        whole = mix(span_hash(hashed, starts, ends) ^ _WORD_SALT)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bound))
        stop = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_END[data], out=stop[1:])
        number = stop[starts] + doc  # grows with every end of a sentence and of a text
        at = np.minimum(np.searchsorted(heads, whole), len(heads) - 1)
        named = np.flatnonzero(heads[at] == whole)
        plain = np.setdiff1d(bound[:-1][np.diff(bound) > 0], bound[:-1][np.unique(doc[named])])
        for word in np.concatenate([named, plain]).tolist():
            a, b = np.searchsorted(number, [number[word], number[word] + 1]).tolist()
            key = int(mix(np.array([np.bitwise_xor.reduce(mix(whole[a:b] + np.arange(b - a, dtype=np.uint64)))], np.uint64))[0])
            found = [h[np.isin(h, special)] for h, _ in features(hashed, starts[a:b], ends[a:b])]
            own, n = np.unique(np.searchsorted(special, np.concatenate(found)), return_counts=True)
            for term in words_of[int(whole[word])] if heads[np.minimum(np.searchsorted(heads, whole[word]), len(heads) - 1)] == whole[word] else [-1]:
                yield key >> 1, b - a, term, own.tolist(), n.tolist()


def changes_of(sentences, identity, special: np.ndarray) -> tuple[np.ndarray, int]:
    """Mean outer product of the changes of the values of the features ``special`` over all swaps, and their number."""
    terms, hashes = _terms(identity)
    of = [np.bincount(np.searchsorted(special, h), minlength=len(special)) for h in hashes]
    first = {g: min(i for i, (x, _) in enumerate(terms) if x == g) for g in range(len(identity))}
    total, number = np.zeros((len(special), len(special))), 0
    alike = Counter((n, term, tuple(feature), tuple(count)) for n, term, feature, count in sentences)
    for (n, term, feature, count), times in alike.items():
        base = np.zeros(len(special))
        base[list(feature)] = count
        if term < 0:
            swaps = [(first[g], i, base + of[first[g]], n + 1) for i, (g, _) in enumerate(terms) if i != first[g]]
        else:
            swaps = [(term, i, base, n) for i, (g, _) in enumerate(terms) if g == terms[term][0] and i != term]
        if swaps:
            change = np.array([value(now - of[a] + of[b], words) - value(now, words) for a, b, now, words in swaps])
            total += times * (change.T @ change)
            number += times * len(swaps)
    return total / max(number, 1), number


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS, weight: float = COUNTERFACTUAL, identity=IDENTITY) -> dict:
    """Model learned from labelled documents on the training side; the bound is ``train_docs``."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    chosen = materialize(own.join(F.broadcast(picked), "doc_id"), "toxicity-train")  # at most train_docs ids
    total, toxic = chosen.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not total or toxic in (0, total):
        return {"prior": toxic / total if total else 0.5}

    def occurring(batches):
        for b in batches:
            found = [np.zeros(0, np.uint64)]
            for i in range(b.num_rows):
                each = [np.zeros(0, np.uint64)]
                for _, data, offsets in parts(b.column("text").slice(i, 1)):
                    low = _SPACED[data]
                    starts, ends, _ = word_spans(low, offsets)
                    each += [np.unique(h) for h, _ in features(prefix_hash(low), starts, ends)]
                found.append(np.unique(np.concatenate(each)))
            f, n = np.unique(np.concatenate(found), return_counts=True)
            for at in range(0, len(f), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(f[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000])], names=["f", "n"])

    found = chosen.filter("toxic > 0").select("text").mapInArrow(occurring, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    found = found.filter(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "f").limit(CANDIDATES).collect()
    found = sorted((r[0] & ((1 << 64) - 1), r[1]) for r in found)
    candidates, ones = np.array([f for f, _ in found], np.uint64), np.array([n for _, n in found], np.float64)

    def beside(batches):
        n = np.zeros(len(candidates), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                n += np.bincount(gathered(b.column("text").slice(at, 64), candidates)[2], minlength=len(n))
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own])], names=["i", "n"])

    zeros = np.zeros(len(candidates))
    if len(candidates):
        for r in chosen.filter("toxic <= 0").select("text").mapInArrow(beside, "i int, n long").groupBy("i").agg(F.sum("n")).collect():
            zeros[r[0]] = r[1]
    expected = (ones + zeros) * (toxic / total)
    best = candidates[np.lexsort((candidates, -(ones - expected) / np.sqrt(expected)))[:FEATURES]]
    terms, hashes = _terms(identity)
    special = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
    model = np.union1d(best, special)
    words_of: dict[int, list[int]] = {}
    for i, h in enumerate(hashes):
        words_of.setdefault(int(h[-1]), []).append(i)

    def encode(batches):
        for b in batches:
            words, row, feature, count = gathered(b.column("text"), model)
            cut = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (feature.astype(np.int32), count)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("toxic"), pa.array(words), *lists], names=["key", "toxic", "words", "f", "c"])

    def sentences(batches):
        for b in batches:
            out = list(_sentences(b.column("text"), words_of, special))
            names, types = ["key", "words", "term", "f", "c"], [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)

    coded = chosen.select(F.xxhash64("doc_id", "text").alias("key"), "toxic", "text").mapInArrow(encode, "key long, toxic int, words long, f array<int>, c array<double>")
    rows = coded.orderBy("key", "toxic").limit(train_docs).toArrow()  # ids may repeat
    pairs = []
    if words_of:
        spoken = chosen.select("text").mapInArrow(sentences, "key long, words long, term int, f array<int>, c array<long>")
        pairs = spoken.orderBy((F.col("term") < 0).cast("int"), "key", "term").limit(PAIRS).collect()
    x = np.zeros((rows.num_rows, len(model)), np.float32)
    for i, (n, f, c) in enumerate(zip(*(rows.column(k).to_pylist() for k in ("words", "f", "c")), strict=True)):
        x[i, f] = value(np.array(c), n)
    change, swaps = changes_of([(r["words"], r["term"], r["f"], r["c"]) for r in pairs], identity, special)
    theta, bias = fit(x, rows.column("toxic").to_numpy().astype(np.float32), change, np.searchsorted(model, special), weight)
    return {"known": model, "theta": theta, "bias": bias, "swaps": swaps}


def predict(model: dict, column: pa.Array) -> np.ndarray:
    if "prior" in model:
        return np.full(len(column), float(model["prior"]))
    words, row, feature, count = gathered(column, model["known"])
    s = np.bincount(row, weights=model["theta"][feature] * value(count, words[row]), minlength=len(column)) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def score_toxicity(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` plus the score, 0 to 1."""
    docs = docs.select([c for c in docs.columns if c.lower() != name.lower()])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(predict(model, b.column(text)))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
