"""Operators against brute force, round trips and held-out accuracy; edge cases of every operator."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, lattice_lm, line_dedup, mixing, near_dedup, packing, quality, registry, secret_scan, substring_dedup
from tessera.llm import webp_lossless as webp
from tessera.llm.common import materialize
from tests.llm import data


@pytest.fixture(scope="module")
def docs(spark):
    df = data.docs(spark).cache()
    df.count()
    return df


def by_text(df, *names):
    return {(r["doc_id"], r["text"]): tuple(r[n] for n in names) for r in df.collect()}


def test_exact(spark, docs):
    got = by_text(exact_dedup.exact_dedup(docs), "keep_id", "group_size", "kept")
    groups = defaultdict(list)
    for i, t, *_ in data.rows():
        groups[(t or "").translate(data.LOWER)].append(i)
    for (i, t), (keep, n, kept) in got.items():
        ids = groups[(t or "").translate(data.LOWER)]
        want = max((x for x in ids if x is not None), default=None)
        assert (keep, n, kept) == (want, len(ids), i == want), i
    assert exact_dedup.exact_dedup(data.empty(spark)).count() == 0


def test_secrets(spark, docs):
    model = secret_scan.train_markov(secret_scan.default_samples(docs))
    got = by_text(secret_scan.scan_secrets(docs, model), "n_assign", "n_access", "n_hex", "base_sha256")
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for (_, t), (a, k, h, digest) in got.items():
        t = t or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want = ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(spans))
        assert (a, k, h) == tuple(sum(x[1] == i for x in spans) for i in range(3)) and digest == hashlib.sha256(want.encode()).hexdigest()
    assert secret_scan.scan_secrets(data.empty(spark), model).count() == 0


def test_markov_held_out(spark):
    r = random.Random(5)
    texts = [("_".join(r.choice(["page", "count", "user", "index", "value", "total", "name"]) for _ in range(4)), 0) for _ in range(400)]
    texts += [("".join(r.choice(secret_scan.ALPHABET[:62]) for _ in range(24)), 1) for _ in range(400)]
    model = secret_scan.train_markov(spark.createDataFrame(texts[::2], "text string, label int"))
    _, precision, recall = secret_scan.held_out(spark.createDataFrame(texts[1::2], "text string, label int"), model)
    assert precision > 0.97 and recall > 0.97


def test_markov_spans(spark):
    """Keys are reported, and words, paths and card numbers are not."""
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    samples = secret_scan.default_samples(docs_)
    model = secret_scan.train_markov(samples.filter("part = 0"))
    cut, precision, recall = secret_scan.held_out(samples.filter("part = 1"), model)
    assert precision > 0.98 and recall > 0.9
    r = random.Random(2)
    keys = ["".join(r.choice(secret_scan.ALPHABET[:62]) for _ in range(36)) for _ in range(30)]
    plain = ["".join(r.choice("0123456789") for _ in range(16)) for _ in range(30)] + ["/usr/local/share/there/andtion/", "THE_GREAT_ANDERER_TION", "ofthstthereandtion"]
    texts = [(i, f"see {x} here") for i, x in enumerate(keys + plain)]
    got = {x["doc_id"]: x["spans"] for x in secret_scan.scan_secrets(spark.createDataFrame(texts, "doc_id long, text string"), model, threshold=cut).collect()}
    assert sum(got[i] == "markov:4:40" for i in range(30)) >= 28 and not any(got[i] for i in range(30, len(texts)))


def test_substrings(spark, docs):
    got = by_text(substring_dedup.remove_repeats(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    count = Counter()
    for _, t, *_ in data.rows():
        b = (t or "").encode()
        count.update(b[i : i + 200] for i in range(len(b) - 199))
    for (_, t), (n, removed, spans, digest) in got.items():
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                hit[i : i + 200] = True
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        assert (n, removed, spans, digest) == (len(b), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest())
    assert substring_dedup.remove_repeats(data.empty(spark)).count() == 0


def test_substrings_by_shards(spark, docs, monkeypatch):
    want = by_text(substring_dedup.remove_repeats(docs), "n_removed", "kept_sha256")
    monkeypatch.setattr(substring_dedup, "INDEX_BLOCKS", 1)  # every mixed anchor is cut into shards, down to whole windows
    assert by_text(substring_dedup.remove_repeats(docs), "n_removed", "kept_sha256") == want


def test_substrings_of_texts_that_share_an_id(spark, docs, monkeypatch):
    want = by_text(substring_dedup.remove_repeats(docs), "n_removed", "kept_sha256")
    monkeypatch.setattr(substring_dedup, "text_id", lambda body: F.octet_length(body).cast("long") % 5)
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", 1)  # and blocks with copies are joined apart
    assert by_text(substring_dedup.remove_repeats(docs), "n_removed", "kept_sha256") == want


def test_matching_statistics():
    r = random.Random(2)
    for _ in range(30):
        blocks = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 6))]
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
        index = substring_dedup.RunIndex(np.frombuffer(b"".join(blocks), np.uint8), offsets)
        got = index.statistics(0, int(offsets[-1]))
        assert index.lengths.sum() == offsets[-1] and len(index.heads) == len(index.lengths) and len(index.at) <= 2 * len(index.heads)
        starts = [(k, i) for k, b in enumerate(blocks) for i in range(len(b))]
        for p, (k, i) in enumerate(starts):
            best = 0
            for m, j in starts:
                if (m, j) != (k, i):
                    x, y = blocks[k][i:], blocks[m][j:]
                    n = next((q for q in range(min(len(x), len(y))) if x[q] != y[q]), min(len(x), len(y)))
                    best = max(best, n)
            assert got[p] == best


def components(sets):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in sets}


def shingles(t):
    w = data.words(t)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def test_near(spark, docs):
    got = by_text(near_dedup.near_dedup(docs), "n_shingles", "component_id", "kept")
    rows = [(i, t) for i, t, *_ in data.rows() if i is not None]
    want = components({i: shingles(t) for i, t in rows})
    for (i, t), (n, comp, kept) in got.items():
        assert n == len(shingles(t))
        if i is not None:
            assert (comp, kept) == (want[i], i == want[i])
    assert near_dedup.near_dedup(data.empty(spark)).count() == 0


def test_near_group_of_variants(spark):
    r = random.Random(8)
    base = data.prose(r, 60).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = data.prose(r, 1) + str(r.randint(0, 9))
        rows.append((i, " ".join(w)))
    want = components({i: shingles(t) for i, t in rows})
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def test_near_id_with_three_texts(spark):
    r = random.Random(8)
    texts = [data.prose(r, 40) for _ in range(5)]
    rows = [(9, t) for t in texts] + [(i + 1, t) for i, t in enumerate(texts)] + [(20, data.prose(r, 40))]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["component_id"]) for x in got} == {(i, 1) for i in (1, 2, 3, 4, 5, 9)} | {(20, 20)}


def test_sketch_estimates():
    r = np.random.default_rng(1)
    for share in (0.2, 0.75, 0.95):
        both, own = int(400 * share), int(400 * (1 - share) / 2)
        x = r.integers(1, 2**63, both + 2 * own).astype(np.uint64)
        a, b = near_dedup.sketch(x[: both + own]), near_dedup.sketch(np.concatenate([x[:both], x[both + own :]]))
        assert abs((a == b).mean() - share) < 0.17
    small = near_dedup.sketch(np.array([7], np.uint64))
    assert len(small) == near_dedup.COORDS and (small == near_dedup.sketch(np.array([7], np.uint64))).all()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("hot, least", [(64, (8, 16)), (1, (8, 16)), (64, (0, 0))])
def test_lines(spark, monkeypatch, hot, least):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "LEAST", least)
    r = random.Random(4)
    base = [data.prose(r, 6) for _ in range(8)] + ["short", "short", "a fair bit", "twelve chars", "no"]
    rows = []
    for i in range(40):
        own = []
        for _ in range(4):
            s = list(r.choice(base))
            for _ in range(r.randint(0, 2)):
                k = r.randrange(len(s))
                s[k : k + 1] = r.choice([[], ["q"], [s[k], "z"]])
            own.append("".join(s))
        rows.append((i, "\n".join(own)))
    lines = sorted({x for _, t in rows for x in t.split("\n") if x.strip()})
    group = {x: x for x in lines}
    for a in lines:
        for b in lines:
            if a < b and edits(a, b) <= sum(min(len(a), len(b)) >= n for n in line_dedup.LEAST):
                x, y = group[a], group[b]
                group = {k: x if v == y else v for k, v in group.items()}
    seen, want = set(), {}
    for i, t in rows:
        want[i] = [p for p, x in enumerate(t.split("\n")) if x.strip() and (group[x] in seen or seen.add(group[x]))]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: list(x["dropped"]) for x in got} == want
    for x in got:
        assert x["kept_text"] == "\n".join(s for p, s in enumerate(x["text"].split("\n")) if p not in want[x["doc_id"]])


def test_within_edits(spark):
    r, rows = random.Random(6), []
    for i in range(400):
        a = "".join(r.choice("abé") for _ in range(r.choice([0, 1, 5, 40, 90, 200])))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 1)] = r.choice([[], ["a"], ["x"]])
        rows.append((i, a, "".join(b), r.randint(0, 2)))
    got = line_dedup.within_edits(spark.createDataFrame(rows, "i int, x string, y string, most int")).collect()
    assert {x["i"] for x in got} == {i for i, a, b, most in rows if edits(a, b) <= most}


def line_result(rows):
    """(doc_id, text) -> dropped line numbers, by brute force."""
    docs_ = sorted({(i is not None, i or 0, i, t or "") for i, t in rows}, key=lambda x: x[:2])
    lines = sorted({x for *_, t in docs_ for x in t.split("\n") if x.strip(" ")})
    group = {x: x for x in lines}
    for k, a in enumerate(lines):
        for b in lines[k + 1 :]:
            most = sum(min(len(a), len(b)) >= n for n in line_dedup.LEAST)
            if abs(len(a) - len(b)) <= most and sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values()) <= 2 * most and edits(a, b) <= most:
                x, y = group[a], group[b]
                group = {q: x if v == y else v for q, v in group.items()}
    seen, out = set(), {}
    for *_, i, t in docs_:
        out[(i, t)] = [p for p, x in enumerate(t.split("\n")) if x.strip(" ") and (group[x] in seen or seen.add(group[x]))]
    return out


def test_lines_edges(spark, docs):
    got = line_dedup.dedup_lines(docs).collect()
    # Rows of one id with several texts go by text hash: which of them stays first is not told here.
    want = line_result([(i, t) for i, t, *_ in data.rows()])
    assert Counter((x["doc_id"], x["text"], tuple(x["dropped"])) for x in got) == Counter((i, t, tuple(want[(i, t or "")])) for i, t, *_ in data.rows())
    assert {c for c in docs.columns} <= set(got[0].asDict()) and [x["n_lines"] for x in got if x["text"] is None] == [0]
    assert line_dedup.dedup_lines(data.empty(spark)).count() == 0


def test_lattice(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    got = lattice_lm.lattice_scores(spark.read.parquet(str(tmp_path / "d"))).collect()
    rows = [(i, t) for i, t, *_ in data.rows()]
    assert len(got) == len(rows)
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    c = Counter(w for t in train for w in data.words(t))
    ends = len(train)
    n, v = sum(c.values()) + ends, len(c) + 1
    base = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    want = Counter()
    sp, pieces = lattice_lm._vocabulary(None)
    used = Counter()
    for w, k in c.items():
        for p in sp.encode(w):
            used[p] += 1 / k
    live = [i for i, p in enumerate(pieces) if p]
    add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y))) if min(x, y) > -math.inf else max(x, y)

    def sums(w, log):
        """Forward and backward sums of a word, and its edges, in plain loops."""
        w = "▁".encode() + w.encode()
        edges = [(s, e) for e in range(1, len(w) + 1) for s in range(max(0, e - 48), e) if w[s:e] in log]
        a, b = [0.0] + [-math.inf] * len(w), [-math.inf] * len(w) + [0.0]
        for s, e in edges:
            a[e] = add(a[e], a[s] + log[w[s:e]])
        for s, e in sorted(edges, reverse=True):
            b[s] = add(b[s], b[e] + log[w[s:e]])
        return w, edges, a, b

    def logs(uses):
        total, prob = sum(uses[i] for i in live) + 0.1 * len(live), defaultdict(float)
        for i in live:
            prob[pieces[i]] += (uses[i] + 0.1) / total
        return {p: math.log(x) for p, x in prob.items()}

    first = {}
    for i in live:
        first.setdefault(pieces[i], i)
    for _ in range(lattice_lm.ROUNDS):
        log, now = logs(used), Counter()
        for w, k in c.items():
            w, edges, a, b = sums(w, log)
            for s, e in edges:
                now[first[w[s:e]]] += math.exp(a[s] + log[w[s:e]] + b[e] - a[-1]) / k
        used = now
    log = logs(used)
    tokens = n - ends
    new, more = (sum(k == 1 for k in c.values()) + 1) / (tokens + 1), math.log10((tokens + 0.1) / (n + 0.2))

    def marginal(w):
        pieces_ = math.log(new) + sums(w, log)[2][-1]
        return more + (add(pieces_, math.log((1 - new) * c[w] / tokens)) if c[w] else pieces_) / math.log(10)

    for i, t in rows:
        w = data.words(t)
        s = sum(map(marginal, w)) + math.log10((ends + 0.1) / (n + 0.2))
        want[(i, len(w) + 1, sum(c[x] > 0 for x in w) + 1, round(sum(base(c[x]) for x in w) + base(ends), 4), round(s, 4))] += 1
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    have = sorted(((x["doc_id"], x["n_tokens"], x["n_known"], x["base_score"], x["score"]) for x in got), key=key)
    for x, y in zip(sorted(want.elements(), key=key), have, strict=True):
        assert x[:3] == y[:3] and x[3] == pytest.approx(y[3], abs=0.01) and x[4] == pytest.approx(y[4], abs=0.01)
    assert {x["train_tokens"] for x in got} == {n}
    assert lattice_lm.lattice_scores(data.empty(spark)).count() == 0


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    ids = {}
    for i, t, *_ in data.rows():
        own = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[(i, len(own))] += 1
        ids.setdefault((i, len(own)), own)
    got = packing.pack(docs, partition_bytes=1 << 13).collect()
    full = defaultdict(list)
    for x in got:
        own = ids[(x["doc_id"], x["doc_tokens"])]
        assert zlib.crc32(own[x["start"] : x["start"] + x["length"]].tobytes()) == x["ids_crc32"] or want[(x["doc_id"], x["doc_tokens"])] > 1
        full[x["sequence_id"]].append((x["offset"], x["length"]))
    assert sum(x["length"] for x in got) == sum(k[1] * n for k, n in want.items())
    for pieces in full.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 1024
    assert packing.pack(data.empty(spark)).count() == 0


def test_packing_added_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [end, f"a{end}b", f"a  {end}  b\n\n{end}\n", end * 3, f"   {end}   ", end[:-1], f"<|{end}|>", f"don't {end}'t 12{end}34 é{end}é", f"tail \t {end}"]
    own = {i: np.array([*coder.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["doc_tokens"]) for x in got} == {(i, len(a)) for i, a in own.items()}
    for x in got:
        assert zlib.crc32(own[x["doc_id"]][x["start"] : x["start"] + x["length"]].tobytes()) == x["ids_crc32"]
    assert {t.content: i for i, t in coder.get_added_tokens_decoder().items()} == packing.ADDED


def test_packing_every_character():
    """Both libraries split alike after, before and between any character, with the added token around."""
    import public_tokenizers
    from tokenizers import Tokenizer

    coder, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing._encoder(None)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4096):
        s = "".join(f"a{chr(c)}1 {chr(c)}" for c in points[i : i + 4096]) + "<|endoftext|>"
        assert coder.encode(s, add_special_tokens=False).ids == encode(s).tolist()


def test_packing_long_texts(spark):
    """Runs of a million signs and texts of megabytes get the ids of the vocabulary's own library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    coder, n, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 1_000_000, random.Random(1)
    texts = [x * n for x in (" ", "\n", "\u00a0", "a", "!", "\u00e9", "7", "ab1!")] + [" \t\n" * 400_000, "word" + " " * n + "<|endoftext|>  x", data.prose(r, 300_000)]
    texts += ["x" * 50 + " " * (packing.LONG_RUN + k) + "y" for k in (-1, 0, 1)]
    texts.append("".join(r.choice("abcdefghijklmnop0123456789+/") for _ in range(2_000_000)))
    got = defaultdict(list)
    for x in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[x["doc_id"]].append((x["start"], x["length"], x["ids_crc32"], x["doc_tokens"]))
    for i, t in enumerate(texts):
        own = np.array([*coder.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for start, length, crc, tokens in sorted(got[i]):
            assert start == at and tokens == len(own) and zlib.crc32(own[start : start + length].tobytes()) == crc
            at += length
        assert at == len(own)


def test_packing_layout_is_fixed(spark):
    r = random.Random(3)
    rows = [(i, data.prose(r, r.randint(1, 300))) for i in range(300)] + [(1000 + i, data.prose(random.Random(1), 200)) for i in range(200)]
    base = spark.createDataFrame(rows, "doc_id long, text string")
    key, own, out = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 13):
            spark.conf.set(key, str(n))
            out.append(sorted(map(tuple, packing.pack(base.repartition(n), partition_bytes=1 << 15).collect())))
    finally:
        spark.conf.set(key, own)
    assert out[0] == out[1]
    used = Counter()
    for x in out[0]:
        used[x[5]] += x[2]
    ranges = {k >> 32 for k in used}
    assert len(ranges) > 8 and sum(n < 1024 for n in used.values()) <= len(ranges)
    copies = {x[5] >> 32 for x in out[0] if x[0] >= 1000}
    assert len(copies) > 2  # one point of the curve is more than a range


def test_hilbert_neighbours():
    n = 8
    grid = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    key = packing.hilbert_index(grid, 3)
    assert sorted(key.tolist()) == list(range(n**3))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_mixing(spark, docs):
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(data.rows())
    size, target, taken, most = Counter(), {}, Counter(), Counter()
    for x in got:
        assert x["size"] == len(data.words(x["text"])) and x["taken"] <= 2 * x["size"]
        size[x["source"]] += x["size"]
        taken[x["source"]] += x["taken"]
        target[x["source"]] = x["target"]
        most[x["source"]] = max(most[x["source"]], x["size"])
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * size[s]
            left -= want[s]
        open_ -= over
    want |= {s: level * weight[s] for s in open_}
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= most[s]
    assert mixing.mix_sources(data.empty(spark)).count() == 0


def test_mixing_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 8)
    rows = [(i, "w " * (1 + i % 9), f"s{i % 2}") for i in range(600)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in ("s0", "s1"):
        assert abs(sum(x["taken"] for x in got if x["source"] == s) - next(x["target"] for x in got if x["source"] == s)) <= 9


def test_webp_round_trips():
    r = random.Random(1)
    for _ in range(12):
        w, h = r.randint(1, 20), r.randint(1, 12)
        palette = [r.getrandbits(32) for _ in range(r.choice([2, 4, 10, 200]))]
        px = [r.choice(palette) if r.random() < 0.6 else palette[i // w % len(palette)] for i in range(w * h)]
        for kw in ({}, {"green": True}, {"predictor": r.randint(0, 13)}, {"cross": r.getrandbits(24)}, {"palette": True}, {"cache": 5}, {"predictor": 11, "cross": 99, "green": True, "cache": 4}):
            a, b, c = webp.decode(webp.encode_argb(px, w, **kw))
            assert (a, b, c.tolist()) == (w, h, px), kw
    with pytest.raises(ValueError):
        webp.decode(b"RIFF")


def test_webp_writer_takes_the_smallest_form():
    """The production writer uses back-references, predictor, palette and colour cache where they shrink an image."""
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijklmnopqrst", k=9)) for _ in range(30)]
    steps = [0]
    for _ in range(5999):
        steps.append((steps[-1] + r.randint(-2, 2)) % 256)
    last, recent = [65, 66], []
    for _ in range(6000):
        k = r.randint(0, 1)
        if r.random() < 0.03:
            last[k] = 2 * r.randint(32, 40) + k
        recent.append(last[k])
    texts = [" ".join(r.choice(words) for _ in range(900)).encode(), bytes(steps), bytes(r.choices(b"01", k=5000)), bytes(recent)]
    texts += [bytes(r.choices(range(256), k=30000)), b"", b"\xff" * 576, b" " * 50000, bytes(r.choices(range(48, 64), k=20000)), b"q" * 577, words[0].encode() * 4000]
    media = webp.store_texts(texts)
    payloads = [t + b"\xff" * (max(1, -(-len(t) // 576)) * 576 - len(t)) for t in texts]
    assert webp.read_payloads(media) == payloads
    assert [webp.store_texts([t])[0] for t in texts] == media  # an image doesn't depend on those beside it
    lanes = [webp._lane(webp.split_files(m)[0]) for m in media[:4]]
    assert [[t[0] for t in x[3]] for x in lanes] == [[webp.GREEN], [webp.PREDICTOR, webp.GREEN], [webp.PALETTE], [webp.GREEN]]
    assert len(lanes[0][0][4][4]) > 1 and lanes[3][0][3] > 0  # distance codes; bits of the cache
    assert len(media[0]) < 0.4 * len(texts[0]) and len(media[1]) < 0.4 * len(texts[1]) and len(media[2]) < 0.17 * len(texts[2])
    for f in [f for m in media for f in webp.split_files(m)[:2]]:
        (w, h, a), (w2, h2, b) = webp.decode(f), webp.decode_many([f])[0]
        assert (w, h) == (w2, h2) and (a == b).all()
    # On grey pixels cross-colour can only do what subtract-green does, for more bits.
    px = [0xFF000000 | c * 0x10101 for c in steps[:480]]
    assert len(webp.encode_argb(px, 24, cross=0x2020)) > len(webp.encode_argb(px, 24, green=True))


def test_media(spark, docs):
    out = webp.media_columns(docs)
    for x in out.collect():
        b = (x["text"] or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        assert x["payload_sha256"] == hashlib.sha256(p).hexdigest() and x["tail_crc32"] == zlib.crc32(p[-32:]) and x["n_bytes"] == len(b)
        pixels = np.concatenate([webp.decode(f)[2] for f in webp.split_files(bytes(x["media"]))])
        assert (pixels >> 8 & 255).astype(np.uint8).tobytes() == p  # the general decoder agrees with the lockstep one
    assert webp.write_pixels(out.limit(3)).select("images").count() == 3
    assert webp.media_columns(data.empty(spark)).count() == 0


def test_quality(spark, docs):
    base = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    all_ = spark.read.parquet(f"{base}/documents.parquet")
    model = quality.fit_quality(all_, labels)
    got = quality.score_quality(all_.join(labels, "doc_id").filter(quality.fold(all_["doc_id"], 5) == 0), model).select("quality", "score").collect()
    bad, good = [x[1] for x in got if x[0] == 0], [x[1] for x in got if x[0] == 1]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(bad) * len(good))
    assert auc > 0.9
    scored = quality.score_quality(docs, model)
    assert all(0 <= x["score"] <= 1 for x in scored.collect()) and scored.count() == len(data.rows())
    assert quality.score_quality(data.empty(spark), model).count() == 0
    assert quality.fit_quality(docs, labels.limit(0)) == {"prior": 0.5}


def test_quality_fits_on_all_passages(spark, monkeypatch):
    r, seen = random.Random(9), []
    rows = [(i, data.prose(r, 96 * n - 5)) for i, n in enumerate((60, 1, 25, 40, 3, 30))]
    monkeypatch.setattr(quality, "fit_attention", lambda x, bags, y: seen.append(np.bincount(bags).tolist()))
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    quality.fit_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    fitted = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    assert seen == [[(60, 1, 25, 40, 3, 30)[i] for i in fitted]] and max(seen[0]) > 24


def test_passages_cover_the_text():
    first, x, at = next(quality.passages(pa.array(["", None, "a " * 200])))
    assert first == 0 and at.tolist() == [0, 1, 2, 5] and x.shape == (5, quality.FEATURES)


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = docs
    for name, stage in p.STAGES[:-1]:
        new = stage(spark, left, sf)
        assert new.columns == docs.columns
        left = spark.createDataFrame(new.toPandas(), docs.schema)
        if name == "near_dedup":
            kept = {r["doc_id"]: r["text"] for r in left.collect()}
            sets = {i: shingles(t) for i, t in kept.items()}
            assert all(v == k for k, v in components(sets).items())
    assert p.STAGES[-1][1](spark, left, sf).count() > 0


def test_near_large_group(spark):
    """A group of 2000 near copies around the threshold: classes equal those of all pairs compared."""
    r = random.Random(12)
    base = data.prose(r, 150).split()
    texts = []
    for _ in range(2000):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = data.prose(r, 1) + str(r.randint(0, 99))
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    col = {}
    for s in sets:
        for x in s:
            col.setdefault(x, len(col))
    m = np.zeros((len(texts), len(col)), np.float32)
    for i, s in enumerate(sets):
        m[i, [col[x] for x in s]] = 1
    both, size = m @ m.T, m.sum(1)
    linked = 100 * both >= 75 * (size[:, None] + size[None, :] - both)
    want = np.full(len(texts), -1)
    for i in range(len(texts)):
        open_ = [i] if want[i] < 0 else []
        while open_:
            a = open_.pop()
            want[a] = i
            open_ += np.flatnonzero(linked[a] & (want < 0)).tolist()
            want[open_] = i
    got = near_dedup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    right = np.mean([x["component_id"] == want[x["doc_id"]] for x in got])
    assert 5 < len(set(want.tolist())) < 1900 and right >= 0.99


def test_lattice_long_words(spark, monkeypatch):
    """A word of megabytes is the product of its parts, and is done in seconds."""
    import time

    sp, pieces = lattice_lm._vocabulary(None)
    lattice = lattice_lm.Lattice(pieces, {300: 5.0, 400: 2.0})
    r = random.Random(1)
    word = "".join(r.choice("abcdefgh0123") for _ in range(10_000)).encode()
    whole = lattice_lm.MARK + word
    parts = [whole[i : i + lattice_lm.SEGMENT] for i in range(0, len(whole), lattice_lm.SEGMENT)]
    want = sum(lattice._forward([p])[0][0] for p in parts) / math.log(10)
    assert abs(lattice.words([b"x", word])[1] - want) < 1e-6
    monkeypatch.setattr(lattice_lm, "SEGMENT", 1 << 30)
    assert want - 1e-6 <= lattice.words([word])[0] <= want + 60  # a cut costs the pieces that would cross it
    monkeypatch.undo()
    texts = [(1, "a b"), (2, "z" * 2_000_000), (3, " " * 1_000_000), (4, "".join(r.choice("abcdefgh0123") for _ in range(1_000_000)))]
    start = time.time()
    got = {x["doc_id"]: x for x in lattice_lm.lattice_scores(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert len(got) == 4 and got[3]["n_tokens"] == 1 and all(math.isfinite(x["score"]) for x in got.values()) and time.time() - start < 120


CONTRACT = {
    "op1": "doc_id n_assign n_access n_hex base_sha256 spans", "op2": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op3": "doc_id keep_id group_size kept text_sha256", "op4": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op5": "doc_id held_out score predicted", "op6": "doc_id size source_size target taken", "op7": "doc_id n_shingles component_id kept",
    "op8": "doc_id n_lines n_dropped dropped kept_sha256", "op9": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op10": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op11": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op12": "doc_id held_out score predicted",
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Folders of tables with null, empty, long, tied and repeated rows and extra columns, and with none."""
    out = []
    for rows in (data.rows(), []):
        path = str(tmp_path_factory.mktemp("sf"))
        docs_ = spark.createDataFrame([(i, t, s, "en", len(t or ""), 7) for i, t, s, *_ in rows], "doc_id long, text string, source string, lang string, n_chars long, Kept int")
        docs_.write.parquet(f"{path}/documents.parquet")
        labels = [(i, (i or 0) % 2, 0) for i, *_ in rows] + [(i, None, 1) for i, *_ in rows[:3]]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        out.append(path)
    return out


@pytest.mark.parametrize("name", [q for q in registry.QUERIES if not q.startswith("op13_")])  # reads vectors: test_hard_negatives
def test_query(spark, folders, name):
    full, none = folders
    got = registry.QUERIES[name](spark, full)
    n = name.split("_")[0]
    assert got.columns[: len(CONTRACT[n].split())] == CONTRACT[n].split()
    rows = got.collect()
    ids = Counter(i for i, *_ in data.rows())
    if n == "op10":
        whole = Counter((x["doc_id"], x["doc_tokens"]) for x in rows if x["start"] == 0)
        assert Counter(i for i, _ in whole.elements()) == ids
        assert sum(x["length"] for x in rows) == sum(k[1] * c for k, c in whole.items())
    else:
        assert Counter(x["doc_id"] for x in rows) == ids
    again = registry.QUERIES[name](spark, full).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert registry.QUERIES[name](spark, none).count() == 0


def test_pipeline_run(spark, folders, monkeypatch):
    import corpus_pipeline as p

    full, none = folders
    stages = {}
    monkeypatch.setattr(p, "materialize", lambda df, name: stages.setdefault(name.removeprefix("pipeline-"), materialize(df, name)))
    pieces = p.run(spark, full).collect()
    docs_ = spark.read.parquet(f"{full}/documents.parquet")
    rows = {k: [tuple(x) for x in v.collect()] for k, v in stages.items()}
    assert all(stages[k].columns == docs_.columns for k in list(stages)[:-1])
    before = Counter(map(tuple, docs_.collect()))
    model = quality.fit_quality(docs_, spark.read.parquet(f"{full}/labels.parquet"))
    good = Counter(tuple(x)[:-1] for x in quality.score_quality(docs_, model, name="_score").collect() if x["_score"] >= quality.CUT)
    assert Counter(rows["quality"]) == good and not good - before
    low = lambda x: (x[1] or "").translate(data.LOWER)
    best = {}
    for x in rows["quality"]:
        best[low(x)] = max(best.get(low(x), -1), -1 if x[0] is None else x[0])
    assert Counter(rows["exact_dedup"]) == Counter(x for x in rows["quality"] if (-1 if x[0] is None else x[0]) == best[low(x)])
    known = {x[0]: shingles(x[1]) for x in rows["exact_dedup"] if x[0] is not None}
    if len(known) == sum(x[0] is not None for x in rows["exact_dedup"]):  # no id with two texts
        groups = components(known)
        assert {x[0] for x in rows["near_dedup"] if x[0] is not None} == {i for i in known if groups[i] == i}
    assert set(rows["mixing"]) <= set(rows["near_dedup"]) and max(Counter(rows["mixing"]).values()) <= 2 * max(Counter(rows["near_dedup"]).values())
    assert Counter(x["doc_id"] for x in pieces if x["start"] == 0) == Counter(x[0] for x in rows["mixing"])
    stages.clear()
    assert p.run(spark, none).count() == 0
