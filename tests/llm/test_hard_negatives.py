"""Hard negatives against brute force and SQL; nulls, ties, repeats, one hot vector, small cells, every row indexed."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, Path string, cell int"


def rows(seed=1, n=500, dims=6):
    r = random.Random(seed)
    centre = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    out = [(i, [r.gauss(c, 0.4) for c in centre[i % 4]], r.randrange(4)) for i in range(n)]
    hot = [0.25] * dims
    out += [(1000 + i, hot, i % 3) for i in range(n // 2)]  # one vector in a third of all rows
    out += out[:20]  # repeated rows
    out += [(2000, None, 1), (2100, hot, None), (2200, [None] * dims, 2), (2300, [math.nan] * dims, 2), (2400, [math.inf] * dims, 2), (None, hot, 1)]
    out += [(2500, [0.0] * dims, 1), (2600, [1.0, -1.0], 1), (2700, [], 0), (2800, [1e30] * dims, 3), (2900, [-1e30] * dims, 3)]
    return [(i, v, label, "x", 1) for i, v, label in out]


def vectors(data):
    """Distinct (id, label, components) that take part."""
    out = set()
    for i, v, label, *_ in data:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(np.float32(x)) for x in v):
            continue
        cut = lambda x: int(math.floor(max(-float(hn.MOST), min(float(hn.MOST), 256 * float(np.float32(x))))))
        out.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(map(cut, v))))
    return sorted(out)


def expected(data):
    part, out = vectors(data), Counter()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a, label, v in part:
        if a % 100:
            continue
        scored = sorted((-dot(v, w), i, other) for i, other, w in part if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            found = [x for x in scored if x[2] != label and -80 * s <= -100 * x[0] <= -100 * s][:5]
            for k, (t, n, _) in enumerate(found):
                out[(a, p, k + 1, n, -s, -t)] += 1
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/none/embeddings.parquet")
    return path


@pytest.mark.parametrize("small", [False, True])
def test_query(spark, folder, small, monkeypatch):
    if small:  # many cells, slices, blocks of anchors and leaves
        for name, value in (("CELL_ROWS", 40), ("SLICE_ROWS", 30), ("REQUESTS", 3), ("LEAF_ROWS", 4)):
            monkeypatch.setattr(hn, name, value)
    df = hn.op13_hard_negatives(spark, folder)
    assert df.columns == "anchor_id positive_id rank negative_id positive_score negative_score".split()
    got, want = Counter(tuple(r) for r in df.collect()), expected(rows())
    assert len(want) > 100 and got == want


def test_none(spark, folder):
    assert hn.op13_hard_negatives(spark, f"{folder}/none").count() == 0


def test_cells_hold_every_row(spark, folder, monkeypatch):
    monkeypatch.setattr(hn, "CELL_ROWS", 40)
    data = hn.prepare(spark.read.parquet(f"{folder}/embeddings.parquet"))
    index = hn.Index(data)
    assert index.tree.depth >= 4 and index.rows.count() == data.count()
    assert Counter(map(str, index.rows.select("id", "label", "v").collect())) == Counter(map(str, data.collect()))


def test_bounds_hold_and_prune():
    """No row's score lies outside its leaf's bounds, and on clustered vectors of length 1 most leaves are skipped.

    (Where lengths differ, the lift moves anchors away from all rows, and fewer leaves are skipped.)
    """
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (40, 8)).repeat(100, 0) + r.normal(0, 0.05, (4000, 8))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    m2 = float((x * x).sum(1).max())
    tree = hn.Tree(x, m2, 5)
    leaf, path = tree.route(x)
    lo, hi = hn.spans(leaf, path, 32)
    q = x[::97]
    most, least, _ = tree.bounds(q, lo, hi)
    s = q @ x.T
    assert (s <= most[:, leaf]).all() and (s >= least[:, leaf]).all()
    fifth = np.sort(s, 1)[:, -6]
    assert (most >= fifth[:, None]).mean() < 0.5


def test_matrix_of_slices():
    column = pa.array([[1, 2], [3], [], [4, 5]], pa.list_(pa.int32()))
    assert hn.matrix(column, 2).tolist() == [[1, 2], [3, 0], [0, 0], [4, 5]]
    assert hn.matrix(column.slice(1, 2), 2).tolist() == [[3, 0], [0, 0]]
