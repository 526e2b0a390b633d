"""Held-out accuracy, scores and penalty by plain Python, fewer false positives on neutral mentions, edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tests.llm import data

LETTERS = re.compile(rb"[a-z\x80-\xff]+")


def words(text):
    return LETTERS.findall((text or "").translate(data.LOWER).encode())


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    held = docs.join(labels, "doc_id").filter(toxicity.fold(F.col("doc_id"), 5) == 0)
    rows = toxicity.score_toxicity(held, model).select("toxic", "score").collect()
    found = sum(r["score"] >= 0.5 and r["toxic"] == 1 for r in rows)
    assert found / sum(r["score"] >= 0.5 for r in rows) > 0.97 and found / sum(r["toxic"] for r in rows) > 0.9
    ranked = sorted(rows, key=lambda r: r["score"])
    k = sum(r["toxic"] for r in rows)
    auc = (sum(i for i, r in enumerate(ranked) if r["toxic"]) - k * (k - 1) / 2) / (k * (len(rows) - k))
    assert auc > 0.95 and model["swaps"] > 0


def test_scores_by_plain_python():
    """Counts of words, of features and the score, also of a text in several parts, with words of megabytes and runs of blanks."""
    r = random.Random(3)
    texts = [t for _, t, *_ in data.rows()]
    texts += [(data.prose(r, 9000) + "!? ") * 90, "x" * 5_000_000, " " * 1_000_000, "a " * 700_000 + "b" * 3_000_000 + " end"]
    some = [t or "" for t in texts[:30]]
    known = set()
    for t in some:
        for w in words(t)[:20]:
            known.update(toxicity.term_features(w.decode(errors="surrogateescape")) if w.isascii() else [])
    known = np.array(sorted(known), np.uint64)
    model = {"known": known, "theta": np.linspace(-1, 1, len(known)), "bias": -0.5}
    got = toxicity.predict(model, pa.array(texts))
    cache = {}
    for t, score in zip(texts, got, strict=True):
        w = Counter(words(t))
        n, c = sum(w.values()), Counter()
        for x, k in w.items():
            if len(x) < 1000 and x not in cache:
                h = [int(f) for f in _features(x)]
                cache[x] = [int(i) for f in h if (i := np.searchsorted(known, np.uint64(f))) < len(known) and known[i] == np.uint64(f)]
            for i in cache.get(x, []):
                c[i] += k
        s = sum(model["theta"][i] * math.log1p(k * 200 / (200 + n)) for i, k in c.items()) - 0.5
        assert abs(score - 1 / (1 + math.exp(-s))) < 1e-9


def _features(word):
    from tessera.llm.common import prefix_hash

    d = np.frombuffer(word, np.uint8)
    return np.concatenate([f for f, _ in toxicity.features(prefix_hash(d), np.array([0]), np.array([len(d)]))])


def test_parts_end_between_words():
    text = ("alpha, beta " * 600_000) + "z" * 2_500_000 + " tail"
    pieces = [bytes(d) for _, d, _ in toxicity.parts(pa.array([text]))]
    assert b"".join(pieces) == text.encode() and len(pieces) > 3
    for a, b in zip(pieces, pieces[1:]):
        assert not (a[-1:].isalpha() and b[:1].isalpha())


def test_penalty_by_plain_python():
    identity = (("people", "women", "men"), ("any", "old"))
    special = np.unique(np.concatenate([toxicity.term_features(t) for g in identity for t in g]))
    texts = ["These women and women here. Plain words. An old one", "nothing of it", "", None, "the Men? the people"]
    words_of = {int(toxicity.term_features(t)[-1]): [i] for i, t in enumerate(t for g in identity for t in g)}
    rows = [(n, t, f, c) for _, n, t, f, c in toxicity._sentences(pa.array(texts), words_of, special)]
    assert sorted((n, t) for n, t, *_ in rows) == [(2, 0), (2, 2), (3, -1), (3, 4), (5, 1), (5, 1)]
    got, number = toxicity.changes_of(rows, identity, special)
    total, n = np.zeros_like(got), 0
    terms = [t for g in identity for t in g]

    def vector(ws):
        v = np.zeros(len(special))
        for w in ws:
            for f in toxicity.term_features(w):
                if f in special:
                    v[np.searchsorted(special, f)] += 1
        return np.log1p(v * 200 / (200 + len(ws)))

    for sentence, at in (("these women and women here", 1), ("these women and women here", 3), ("an old one", 1), ("the men", 1), ("the people", 1), ("X nothing of it", 0)):
        ws = sentence.split()
        for group in identity:
            if ws[at] in group or ws[at] == "X":
                own = group[0] if ws[at] == "X" else ws[at]
                for other in group:
                    if other != own:
                        d = vector([*ws[:at], other, *ws[at + 1 :]]) - vector([*ws[:at], own, *ws[at + 1 :]])
                        total, n = total + np.outer(d, d), n + 1
    assert n == number and np.allclose(got, total / n) and len(terms) == 5


def test_neutral_mentions(spark):
    """Where toxic texts name a group more often, the penalty keeps neutral mentions of it low, and still finds the toxic ones."""
    r = random.Random(8)
    plain = ["".join(r.choice("bcdfg") + r.choice("aeiou") for _ in range(3)) for _ in range(200)]
    insult = ["scumlike", "vermin", "worthless"]
    rows, labels = [], []
    for i in range(1200):
        toxic = r.random() < 0.3
        w = r.choices(plain, k=r.randint(8, 25))
        if toxic and r.random() < 0.75:  # some toxic ones use no known insult: the group is all that shows
            w[r.randrange(len(w))] = r.choice(insult)
        if r.random() < (0.8 if toxic else 0.03):
            w[r.randrange(len(w))] = r.choice(["women", "muslims"])
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(toxic), 0))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    around = [(r.choices(plain, k=6), r.choices(plain, k=6)) for _ in range(200)]
    neutral = pa.array([" ".join([*a, ("women", "muslims", "men", "hindus")[i % 4], *b]) for i, (a, b) in enumerate(around)])
    without = pa.array([" ".join([*a, "people", *b]) for a, b in around])
    bad = pa.array([" ".join([*r.choices(plain, k=6), x, *r.choices(plain, k=6)]) for x in insult for _ in range(50)])
    free, held = (toxicity.fit_toxicity(docs, marks, weight=w) for w in (0.0, toxicity.COUNTERFACTUAL))
    rate = lambda m, x: float((toxicity.predict(m, x) >= 0.5).mean())
    # What the mention itself adds to the share of false positives.
    assert rate(free, neutral) - rate(free, without) > 0.2
    assert rate(held, neutral) - rate(held, without) < 0.03 and rate(held, neutral) < rate(free, neutral) / 2
    assert rate(held, bad) > 0.9
    swap = [toxicity.predict(held, pa.array([f"{plain[0]} {g} {plain[1]}"]))[0] for g in ("people", "women", "muslims", "jews")]
    assert max(swap) - min(swap) < 0.05


def test_edges(spark):
    docs = data.docs(spark)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)] + [(None, 1), (5, None), (3, 0)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert len(got) == len(data.rows()) and all(0 <= r["score"] <= 1 for r in got)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).collect()} == {0.5}
    same = labels.withColumn("toxic", F.lit(0))
    assert {r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, same)).collect()} == {0.0}
    assert toxicity.score_toxicity(data.empty(spark), toxicity.fit_toxicity(data.empty(spark), labels)).count() == 0
    assert toxicity.fit_toxicity(docs, labels, identity=())["swaps"] == 0
