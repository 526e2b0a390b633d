"""Quality classifier: attention-based multiple-instance learning over passages.

Each document is a bag of passages of PASSAGE_WORDS words. A passage is encoded by its
own text alone (character classes, word shapes, repetition, hashed character pairs).
Gated attention a_k = softmax(w . (tanh(V h_k) * sigmoid(U h_k))) weighs the passages,
and a logistic output on the weighted representation gives the score. The parameters are
learned by full-batch Adam from document labels.

The model is fitted on at most TRAIN_DOCS labelled documents (those with the smallest
hash of their id), encoded on the executors; encodings of all passages of this bounded
sample reach the driver. Scoring reads every passage of every whole text, in one projection
without a shuffle.

Defined results: null or empty text is one empty passage and gets a score as any other;
rows with null doc_id count as training side (crc32 of the empty text) but have no label;
several labels of one id use the smallest; without both labels the score is the share of
label 1 (0.5 without labels); equal texts get equal scores; an empty table gives an empty
result; further columns pass through (clashing names are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import BLANK, LOWER, U64, arrow_batches, by_value, prefix_hash, slices, span_hash, word_spans

by_value(__name__)

PASSAGE_WORDS = 96
TRAIN_DOCS = 4000
CUT = 0.3
PAIRS = 32
FEATURES = 24 + PAIRS
HIDDEN = 12

_CLASS = np.zeros(256, dtype=np.int64)  # 0 other ASCII sign
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASS[list(b"0123456789")] = 3
_CLASS[BLANK] = 4
_CLASS[list(b".,")] = 5
_CLASS[list(b"!?;:'\"()-")] = 6
_CLASS[128:192] = 7
_CLASS[192:] = 8
_CLASS[list(b"|#$%&*<>{}[]~^\\/=+_@")] = 9
_CLASS[0x0A] = 10
CLASSES = 11


def passages(column: pa.Array):
    """(first row, encodings [passages, FEATURES], first passage of each row and the end) by slices of rows."""
    for first, data, offsets in slices(column):
        rows = len(offsets) - 1
        starts, ends, bound = word_spans(data, offsets)
        n_words = np.diff(bound)
        n_pass = np.maximum(1, -(-n_words // PASSAGE_WORDS))
        p_at = np.concatenate([[0], np.cumsum(n_pass)])
        doc_of_word = np.repeat(np.arange(rows), n_words)
        pas = p_at[doc_of_word] + (np.arange(len(starts)) - bound[doc_of_word]) // PASSAGE_WORDS
        total = int(p_at[-1])
        # Bytes belong to the passage of the last word that starts at or before them.
        owner = np.repeat(p_at[:-1], np.diff(offsets))
        if len(starts):
            step = np.zeros(len(data), np.int64)
            step[starts] = 1
            nth = np.cumsum(step) - 1
            doc_of_byte = np.repeat(np.arange(rows), np.diff(offsets))
            has = nth >= bound[doc_of_byte]
            owner[has] = pas[nth[has]]
        count = np.bincount(owner * CLASSES + _CLASS[data], minlength=total * CLASSES).reshape(total, CLASSES).astype(np.float64)
        n = np.maximum(count.sum(1), 1.0)
        low = LOWER[data]
        pair = ((low[:-1].astype(np.int64) * 31 + low[1:]) * 2654435761 >> 7) % PAIRS if len(data) > 1 else np.zeros(0, np.int64)
        same = owner[:-1] == owner[1:]
        pairs = np.bincount(owner[:-1][same] * PAIRS + pair[same], minlength=total * PAIRS).reshape(total, PAIRS)
        repeat = np.bincount(owner[1:][same & (low[1:] == low[:-1])], minlength=total)
        h = span_hash(prefix_hash(low), starts, ends)
        length = (ends - starts).astype(np.float64)
        w = np.bincount(pas, minlength=total).astype(np.float64)
        w1 = np.maximum(w, 1.0)
        mean = np.bincount(pas, weights=length, minlength=total) / w1
        square = np.bincount(pas, weights=length**2, minlength=total) / w1
        key = np.sort(mixed(pas, h))
        fresh_word = np.ones(len(key), bool)
        fresh_word[1:] = key[1:] != key[:-1]
        distinct = np.bincount((key[fresh_word] >> U64(40)).astype(np.int64), minlength=total)[:total] if len(key) else np.zeros(total)
        upper = _CLASS[data]
        last, head = (upper[ends - 1], upper[starts]) if len(starts) else (np.zeros(0), np.zeros(0))
        of = lambda m: np.bincount(pas[m], minlength=total) / w1
        second = upper[np.minimum(starts + 1, ends - 1)] if len(starts) else head
        next_same = np.zeros(len(h), bool)
        next_same[1:] = (h[1:] == h[:-1]) & (pas[1:] == pas[:-1])
        own = [
            *(count / n[:, None]).T,
            np.log1p(n), np.log1p(w), mean / 10, np.sqrt(np.maximum(square - mean**2, 0)) / 10,
            distinct / w1, of(next_same), of((head == 2) & (second == 2) & (length > 1)), of(head == 2), of(last == 5),
            of(last == 6) , of(last == 9), of(length > 14), repeat / n,
        ]
        x = np.column_stack([*own, pairs / n[:, None] * PAIRS / 4])
        yield first, x, p_at


def mixed(pas: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Passage in the high 24 bits, word hash in the low 40."""
    return (pas.astype(np.uint64) << U64(40)) | (h & U64((1 << 40) - 1))


def _forward(x, rows, n, m):
    """Scores of bags; rows: bag of each passage (sorted)."""
    t, g = np.tanh(x @ m["V"].T), 1 / (1 + np.exp(-(x @ m["U"].T)))
    e = (t * g) @ m["w"]
    first = np.searchsorted(rows, np.arange(n))  # every bag has a passage
    a = np.exp(e - np.maximum.reduceat(e, first)[rows])
    a /= np.bincount(rows, weights=a, minlength=n)[rows]
    z = np.add.reduceat(a[:, None] * x, first, axis=0)
    s = z @ m["c"] + m["b"][0]
    return s, a, z, t, g


def fit_attention(x: np.ndarray, rows: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.05, decay: float = 1e-4) -> dict:
    """Gated attention model by full-batch Adam on log loss; features are standardised inside."""
    n, d = len(y), x.shape[1]
    if n == 0 or y.min() == y.max():
        return {"prior": float(y.mean()) if n else 0.5}
    mu, sd = x.mean(0), x.std(0) + 1e-3
    x = np.clip((x - mu) / sd, -6, 6)
    r = np.random.default_rng(3)
    m = {"V": r.normal(0, 0.1, (HIDDEN, d)), "U": r.normal(0, 0.1, (HIDDEN, d)), "w": r.normal(0, 0.1, HIDDEN), "c": np.zeros(d), "b": np.zeros(1)}
    mom, var = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    for step in range(1, steps + 1):
        s, a, z, t, g = _forward(x, rows, n, m)
        ds = (1 / (1 + np.exp(-s)) - y) / n
        dz = ds[:, None] * m["c"]
        da = (dz[rows] * x).sum(1)
        de = a * (da - np.bincount(rows, weights=a * da, minlength=n)[rows])
        dt, dg = (de[:, None] * m["w"]) * g * (1 - t**2), (de[:, None] * m["w"]) * t * g * (1 - g)
        grad = {"V": dt.T @ x, "U": dg.T @ x, "w": (t * g).T @ de, "c": z.T @ ds, "b": np.array([ds.sum()])}
        for k in m:
            gk = grad[k] + (decay * m[k] if k != "b" else 0)
            mom[k] = 0.9 * mom[k] + 0.1 * gk
            var[k] = 0.999 * var[k] + 0.001 * gk**2
            m[k] = m[k] - rate * (mom[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    return m | {"mu": mu, "sd": sd}


def predict(model: dict, column: pa.Array) -> np.ndarray:
    if "prior" in model:
        return np.full(len(column), model["prior"])
    out = np.zeros(len(column))
    for first, x, p_at in passages(column):
        n = len(p_at) - 1
        rows = np.repeat(np.arange(n), np.diff(p_at))
        s = _forward(np.clip((x - model["mu"]) / model["sd"], -6, 6), rows, n, model)[0]
        out[first : first + n] = 1 / (1 + np.exp(-s))
    return out


def fold(id_col: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % k


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS) -> dict:
    """Model learned from labelled documents on the training side; the bound is ``train_docs``."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).collect()
    label = {int(r[0]): int(r[1]) for r in picked}
    if not label:
        return {"prior": 0.5}
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isin(list(label)))

    def encode(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for first, x, p_at in passages(b.column("text")):
                for i in range(len(p_at) - 1):
                    own = x[p_at[i] : p_at[i + 1]]
                    yield pa.RecordBatch.from_pydict({"doc_id": [ids[first + i]], "x": [own.astype("<f4").tobytes()]})

    bags = chosen.mapInArrow(encode, "doc_id long, x binary").collect()
    bags = sorted((int(r[0]), bytes(r[1])) for r in bags)
    xs = [np.frombuffer(v, "<f4").reshape(-1, FEATURES).astype(np.float64) for _, v in bags]
    if not xs:
        return {"prior": 0.5}
    rows = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    return fit_attention(np.concatenate(xs), rows, np.array([label[k] for k, _ in bags], dtype=np.float64))


def score_quality(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` plus the score, 0 to 1."""
    docs = docs.select([c for c in docs.columns if c.lower() != name.lower()])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(predict(model, b.column(text)))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model)
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
