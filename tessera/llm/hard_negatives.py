"""Hard negatives: different-label rows whose score lies just below a positive's, by vantage-point trees.

Scores are inner products. With M the largest norm, a row x becomes (x, sqrt(M^2 - |x|^2)) and an
anchor q becomes (q, 0): the squared distance is |q|^2 + M^2 - 2 q.x, so higher scores are nearer
and a window of scores is an annulus around the anchor. A vantage-point tree (a row and the median
distance to it at each node) is fitted on a bounded sample of SAMPLE rows; every row is routed to
one of its cells, and the least and greatest distance of a cell's rows to each vantage point above it
bound the scores in the cell. Only cells that meet an anchor's annulus are visited. There, a smaller
tree over the cell's rows is walked leaf by leaf, nearest first, until no leaf can hold a row that is
among the first k. An anchor visits its nearest cell first; what it finds there narrows the
annulus for all others, which are visited in a second round. The result is exact: bounds only skip
cells and leaves that cannot hold a better row.

A cell is cut into slices of about SLICE_ROWS rows by a hash of the id, and anchors into blocks of
about REQUESTS, so a task holds a slice and a block, however many rows share one vector.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take
no part; rows that repeat id, label and vector count once; rows with an anchor's id are not its
partners; shorter vectors are filled with zeros; scaled components are cut at +-2^24, so that scores fit
a long; ties go to the smaller id; an empty table gives no row; further columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_batches, by_value, materialize

by_value(__name__)

K = 5
#: Sampled rows for the top tree, at most so many components in all.
SAMPLE, SAMPLE_CELLS = 4096, 1 << 24
CELL_ROWS, MAX_DEPTH = 2048, 10
SLICE_ROWS, REQUESTS, LEAF_ROWS = 4096, 32_768, 128
FAR = 1 << 62
MOST = 1 << 24

_INDEX = "id long, label long, v array<int>, cell int, path array<double>"
_TARGETS = "qid long, anchor long, label long, v array<int>, lows array<long>, highs array<long>, done int, cell int"
_FOUND = "qid long, anchor long, w int, id long, score long"


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Float rows of a list column, filled with zeros up to ``dims``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(size) and (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims))
    out[np.arange(dims) < size[:, None]] = flat
    return out


class Tree:
    """Vantage-point tree of ``depth`` levels in heap order; leaves are numbered from left to right."""

    def __init__(self, x: np.ndarray, m2: float, depth: int, seed: int = 1):
        nodes = (1 << depth) - 1
        self.depth, self.m2 = depth, m2
        self.v, self.lift, self.radius = np.zeros((nodes, x.shape[1])), np.zeros(nodes), np.full(nodes, np.inf)
        r = np.random.default_rng(seed)
        lift = np.sqrt(np.maximum(m2 - (x * x).sum(1), 0))
        members = {0: np.arange(len(x))}
        for node in range(nodes):
            own = members.pop(node, np.zeros(0, np.int64))
            inside = np.ones(len(own), bool)
            if len(own):
                some = r.choice(own, min(len(own), 8), replace=False)
                test = own if len(own) <= 256 else r.choice(own, 256, replace=False)
                d = self._between(x[test] @ x[some].T, lift[test][:, None], lift[some])
                best = some[int(np.argmax(d.std(0)))]
                self.v[node], self.lift[node] = x[best], lift[best]
                d = self._between(x[own] @ x[best], lift[own], lift[best])
                self.radius[node] = np.median(d)
                inside = d <= self.radius[node]
            members[2 * node + 1], members[2 * node + 2] = own[inside], own[~inside]

    def _between(self, dots, a, b):
        return np.sqrt(np.maximum(2 * self.m2 - 2 * dots - 2 * a * b, 0))

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each row and its distances to the vantage points on the way [rows, depth]."""
        lift = np.sqrt(np.maximum(self.m2 - (x * x).sum(1), 0))
        node, path = np.zeros(len(x), np.int64), np.zeros((len(x), self.depth))
        for level in range(self.depth):
            path[:, level] = self._between((x * self.v[node]).sum(1), lift, self.lift[node])
            node = 2 * node + 1 + (path[:, level] > self.radius[node])
        return node - ((1 << self.depth) - 1), path

    def bounds(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greatest and least score that each leaf can hold for each anchor [anchors, leaves], and the leaf an anchor falls into.

        lo, hi [leaves, depth]: distances of a leaf's rows to the vantage points above it (lo > hi: no rows).
        """
        base = (q * q).sum(1) + self.m2
        leaves = 1 << self.depth
        near, far = np.zeros((len(q), leaves)), np.full((len(q), leaves), np.inf)
        home = np.zeros(len(q), np.int64)
        if self.depth:
            d = np.sqrt(np.maximum(base[:, None] - 2 * (q @ self.v.T), 0))
            for level in range(self.depth):
                node = np.arange(leaves) // (1 << (self.depth - level)) + (1 << level) - 1
                own = d[:, node]
                near = np.maximum(near, np.maximum(lo[:, level] - own, own - hi[:, level]))
                far = np.minimum(far, own + hi[:, level])
                home = 2 * home + 1 + (d[np.arange(len(q)), home] > self.radius[home])
            home -= leaves - 1
        slack = 1 + 1e-9 * base[:, None]  # floats only skip what is out by more than their error
        none = (lo > hi).any(1)
        most = np.where(none, -np.inf, (base[:, None] - near**2) / 2 + slack)
        return most, np.where(none, np.inf, (base[:, None] - far**2) / 2 - slack), home


def spans(leaf: np.ndarray, path: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of each leaf's rows, by level."""
    lo, hi = np.full((leaves, path.shape[1]), np.inf), np.full((leaves, path.shape[1]), -np.inf)
    np.minimum.at(lo, leaf, path)
    np.maximum.at(hi, leaf, path)
    return lo, hi


def walk(rows: dict, asked: list[tuple], k: int, m2: float, same: bool):
    """(request number, window, id, score): of each asked (id, label, lows, highs), the first ``k`` rows of each window.

    rows: id, label, x; the leaves of a tree over them are taken nearest first.
    """
    x, ids, labels = rows["x"], rows["id"], rows["label"]
    depth = max(0, int(np.ceil(np.log2(max(len(x), 1) / LEAF_ROWS))))
    tree = Tree(x, m2, depth)
    leaf, path = tree.route(x)
    order = np.argsort(leaf, kind="stable")
    x, ids, labels, leaf = x[order], ids[order], labels[order], leaf[order]
    lo, hi = spans(leaf, path[order], 1 << depth)
    first = np.searchsorted(leaf, np.arange((1 << depth) + 1))
    whole = m2 >= 1 << 52  # beyond exact floats
    xi = x.astype(np.int64) if whole else x
    for start in range(0, len(asked), 512):
        part = asked[start : start + 512]
        q = np.stack([a[4] for a in part])
        most, least, _ = tree.bounds(q, lo, hi)
        for i, (own, label, lows, highs, vector) in enumerate(part):
            nearest = np.argsort(-most[i], kind="stable")
            vector = vector.astype(np.int64) if whole else vector
            seen: dict[int, tuple] = {}
            for w, (low, high) in enumerate(zip(lows, highs, strict=True)):
                best: list[tuple[int, int]] = []
                for j in nearest.tolist():
                    if most[i, j] < low:
                        break
                    if least[i, j] > high:
                        continue
                    if j not in seen:
                        a, b = first[j], first[j + 1]
                        ok = ((labels[a:b] == label) == same) & (ids[a:b] != own)
                        s = (xi[a:b][ok] @ vector).astype(np.int64)
                        seen[j] = (s, ids[a:b][ok])
                    s, there = seen[j]
                    hit = np.flatnonzero((s >= low) & (s <= high))
                    if len(hit):
                        if len(hit) > k:
                            hit = hit[np.lexsort((there[hit], -s[hit]))[:k]]
                        best = sorted(best + list(zip((-s[hit]).tolist(), there[hit].tolist(), strict=True)))[:k]
                        if len(best) == k:
                            low = max(low, -best[-1][0])
                for score, other in best:
                    yield start + i, w, other, -score


class Index:
    """Routed rows of (id, label, v), their cells' bounds, and the top tree."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
        stats = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0))).first()
        count, self.dims, m2 = int(stats[0]), int(stats[1]), float(stats[2])
        most = max(64, min(SAMPLE, SAMPLE_CELLS // max(self.dims, 1)))
        sample = rows.orderBy(F.xxhash64("id"), "id", "label", "v").limit(most).select("v").toArrow()
        depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(count, 1) / CELL_ROWS)))), int(np.log2(max(sample.num_rows, 4) / 4)))
        dims = self.dims
        self.tree = tree = Tree(matrix(sample.column("v"), dims), m2, depth)

        def route(batches):
            for b in batches:
                cell, path = tree.route(matrix(b.column("v"), dims))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(list(path), pa.list_(pa.float64()))], names=[*b.schema.names, "cell", "path"])

        self.rows = materialize(rows.select("id", "label", "v").mapInArrow(route, _INDEX), "vectors")
        ends = [f(F.col("path")[i]) for i in range(depth) for f in (F.min, F.max)]
        cells = self.rows.groupBy("cell").agg(F.count("*"), *ends).collect()  # a row a cell, at most 2^MAX_DEPTH
        self.lo, self.hi = np.full((1 << depth, depth), np.inf), np.full((1 << depth, depth), -np.inf)
        slices = np.ones(1 << depth, np.int64)
        for c in cells:
            slices[c[0]] = -(-c[1] // SLICE_ROWS)
            self.lo[c[0]], self.hi[c[0]] = c[2::2], c[3::2]
        self.slices = self.spark.createDataFrame([(i, int(n)) for i, n in enumerate(slices)], "cell int, slices int")

    def _targets(self, requests: DataFrame, nearest: bool) -> DataFrame:
        """A row for each request and cell it has to visit: its nearest cell, or all others that meet a window."""
        tree, lo, hi, dims = self.tree, self.lo, self.hi, self.dims

        def visit(batches):
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    most, least, home = tree.bounds(matrix(part.column("v"), dims), lo, hi)
                    if nearest:
                        row, cell = np.arange(len(home)), home
                    else:
                        done = part.column("done").to_numpy(zero_copy_only=False)
                        lows, highs = part.column("lows").to_pylist(), part.column("highs").to_pylist()
                        meets = np.array([np.logical_or.reduce([(m >= x) & (n <= y) for x, y in zip(a, c, strict=True)]) for m, n, a, c in zip(most, least, lows, highs, strict=True)])
                        meets[np.arange(len(done)), done] = False
                        row, cell = np.nonzero(meets)
                    out = part.drop_columns(["done"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(home[row].astype(np.int32)), pa.array(cell.astype(np.int32))], names=[*out.schema.names, "done", "cell"])

        return requests.mapInArrow(visit, _TARGETS)

    def _visit(self, requests: DataFrame, nearest: bool, k: int, same: bool) -> DataFrame:
        dims, m2 = self.dims, self.tree.m2
        blocks = max(1, -(-requests.count() // REQUESTS))
        targets = self._targets(requests, nearest).withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
        targets = targets.join(F.broadcast(self.slices), "cell").withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)"))).drop("slices")
        targets = materialize(targets, "targets")
        rows = self.rows.drop("path").join(F.broadcast(self.slices), "cell")
        rows = rows.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).drop("slices")
        wanted = targets.select(*[F.col(c).alias(f"{c}_") for c in ("cell", "slice", "block")]).distinct()
        rows = rows.join(wanted, (F.col("cell") == F.col("cell_")) & (F.col("slice") == F.col("slice_")))

        def meet(left, right):
            if left.num_rows and right.num_rows:
                x = matrix(left.column("v"), dims)
                key = np.column_stack([left.column("id").to_numpy(), left.column("label").to_numpy(), x.astype(np.int64)])
                _, kept = np.unique(key, axis=0, return_index=True)  # repeated rows lie in one slice
                own = {"x": x[kept], "id": key[kept, 0], "label": key[kept, 1]}
                columns = [right.column(c).to_pylist() for c in ("qid", "anchor", "label", "lows", "highs")]
                asked = [(a, lab, lows, highs, q) for _, a, lab, lows, highs, q in zip(*columns, matrix(right.column("v"), dims), strict=True)]
                found = [(columns[0][i], columns[1][i], w, other, s) for i, w, other, s in walk(own, asked, k, m2, same)]
            else:
                found = []
            names, types = ["qid", "anchor", "w", "id", "score"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names=names)

        return rows.groupBy("cell_", "slice_", "block_").cogroup(targets.groupBy("cell", "slice", "block")).applyInArrow(meet, _FOUND)

    def first(self, requests: DataFrame, k: int, same: bool) -> DataFrame:
        """(qid, anchor, w, id, score, rank): the first ``k`` rows with the same or another label, of each window of each request.

        requests: qid (unique), anchor, label, v, lows, highs (windows of scores, both ends inside).
        """
        asked = materialize(requests.withColumn("done", F.lit(-1)).select("qid", "anchor", "label", "v", "lows", "highs", "done"), "requests")
        near = materialize(self._visit(asked, True, k, same), "nearest")
        # A window with k rows is narrowed to what can still be among the first k.
        by_window = Window.partitionBy("qid", "anchor", "w").orderBy(F.desc("score"), "id")
        ends = near.withColumn("rank", F.row_number().over(by_window)).filter(F.col("rank") == k)
        ends = ends.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("ends"))  # at most one entry a window
        narrow = F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.col("ends")[i], x)))
        rest = self._targets_done(asked).join(ends, "qid", "left").withColumn("lows", narrow).drop("ends")
        rest = materialize(rest.select("qid", "anchor", "label", "v", "lows", "highs", "done"), "requests-narrow")
        both = near.unionByName(self._visit(rest, False, k, same))
        return both.withColumn("rank", F.row_number().over(by_window)).filter(F.col("rank") <= k)

    def _targets_done(self, asked: DataFrame) -> DataFrame:
        """``asked`` with the cell that the first round has visited."""
        return self._targets(asked, True).drop("cell")


def prepare(vectors: DataFrame, id_col: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, v): rows that take part, components scaled and rounded down."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    part = vectors.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & x.isNotNull()).filter(fine)
    whole = F.transform(x, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int"))
    return part.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"))


def mine(rows: DataFrame, anchors: DataFrame, positives: int = K, negatives: int = K, share: int = 80) -> DataFrame:
    """Hard negatives of ``anchors`` among ``rows`` (both id, label, v).

    For each anchor and each of its first ``positives`` rows of the same label: the first
    ``negatives`` rows of other labels with share % of the positive's score at least, and the score at most.
    """
    arrow_batches(rows.sparkSession)
    index = Index(rows)
    asked = anchors.distinct().select(F.xxhash64("id", "label", "v").alias("qid"), F.col("id").alias("anchor"), "label", "v")
    every = asked.withColumns({"lows": F.array(F.lit(-FAR)), "highs": F.array(F.lit(FAR))})
    best = index.first(every, positives, True).select("qid", "anchor", F.col("rank").alias("at"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = materialize(best, "positives")
    windows = best.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "positive_score"))), lambda p: p["positive_score"]).alias("highs"))
    least = F.transform("highs", lambda s: F.ceil(s * share / F.lit(100).cast("decimal(3,0)")).cast("long"))
    found = index.first(asked.join(windows, "qid").withColumn("lows", least), negatives, False)
    found = found.select("qid", "anchor", (F.col("w") + 1).alias("at"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(found, ["qid", "anchor", "at"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = prepare(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.filter(F.col("id") % 100 == 0))


OP13_SQL = """
WITH rows AS (
    SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda c: floor(256 * c::double)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
    SELECT a.id AS anchor, a.label = b.label AS same, b.id, list_inner_product(a.v, b.v)::bigint AS score
    FROM rows a JOIN rows b ON a.id <> b.id WHERE a.id % 100 = 0
), positives AS (
    SELECT anchor, id, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
)
SELECT p.anchor AS anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id)::int AS rank,
    n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""
