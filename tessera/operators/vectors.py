"""Nearest vectors by cosine with a clustered index: cells by k-means, and bounds that skip cells exactly.

Centres are fitted on a bounded sample; every vector goes to its nearest centre, and a cell keeps the
widest angle between its vectors and the centre. No vector of a cell can be nearer to a query than the
angle to the centre less that width. A query visits its nearest cell first; the k-th cosine found
there rules out all cells whose bound lies below, and the others are visited in a second round.
Cells are cut into slices of about SLICE rows and queries into blocks, so a task holds one of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import materialize

SAMPLE, SAMPLE_CELLS, ROUNDS = 4096, 1 << 24, 6
CELL_ROWS, MOST_CELLS, SLICE, QUERIES = 2000, 1024, 4000, 20_000
DIGITS = 6


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _rows(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def centres_of(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """``k`` unit centres of unit vectors by Lloyd's rounds; empty cells keep their centre."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, 1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where((np.bincount(own, minlength=len(c)) > 0)[:, None], _unit(total), c)
    return c


class Cells:
    """Index of (id, v): rows with their cell, centres and widths."""

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        vectors = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v"))
        count, dims = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
        most = max(64, min(SAMPLE, SAMPLE_CELLS // max(dims, 1)))
        sample = vectors.orderBy(F.xxhash64("id"), "id").limit(most).select("v").toArrow()
        k = max(1, min(MOST_CELLS, -(-count // CELL_ROWS), sample.num_rows // 4))
        self.centres = centre = centres_of(_unit(_rows(sample.column("v"))), k) if sample.num_rows else np.zeros((1, dims))
        unit, rows_ = _unit, _rows

        def assign(batches):
            for b in batches:
                d = unit(rows_(b.column("v"))) @ centre.T
                cell = np.argmax(d, 1)
                near = d[np.arange(len(cell)), cell]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(near)], names=[*b.schema.names, "cell", "near"])

        self.rows = materialize(vectors.mapInArrow(assign, "id long, v array<float>, cell int, near double"), "vector-cells")
        found = self.rows.groupBy("cell").agg(F.min("near"), F.count("*")).collect()  # a row a cell
        self.width, slices = np.full(len(centre), -1.0), np.ones(len(centre), np.int64)
        for c, near, n in found:
            self.width[c], slices[c] = np.arccos(np.clip(near, -1, 1)) + 1e-7, -(-n // SLICE)
        self.slices = spark.createDataFrame([(i, int(n)) for i, n in enumerate(slices)], "cell int, slices int")

    def _visits(self, queries: DataFrame, first: bool) -> DataFrame:
        """(q, v, least, cell) for the cells that a query has to visit: its nearest one, or all others that may hold more."""
        centre, width, unit, rows_ = self.centres, self.width, _unit, _rows

        def visit(batches):
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    d = unit(rows_(part.column("v"))) @ centre.T
                    bound = np.cos(np.maximum(np.arccos(np.clip(d, -1, 1)) - width, 0))
                    bound[:, width < 0] = -np.inf  # no rows
                    home = np.argmax(np.where(width < 0, -np.inf, d), 1)
                    if first:
                        row, cell = np.arange(len(home)), home
                    else:
                        bound[np.arange(len(home)), home] = -np.inf
                        row, cell = np.nonzero(bound + 1e-6 >= part.column("least").to_numpy(zero_copy_only=False)[:, None])
                    out = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.astype(np.int32))], names=[*out.schema.names, "cell"])

        return queries.mapInArrow(visit, "q long, v array<float>, least double, cell int")

    def _search(self, queries: DataFrame, first: bool, k: int) -> DataFrame:
        blocks = max(1, -(-queries.count() // QUERIES))
        visits = self._visits(queries, first).withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))
        visits = visits.join(F.broadcast(self.slices), "cell").withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)"))).drop("slices")
        visits = materialize(visits, "vector-visits")
        wanted = visits.select(*[F.col(c).alias(f"{c}_") for c in ("cell", "slice", "block")]).distinct()
        rows = self.rows.join(F.broadcast(self.slices), "cell").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
        rows = rows.join(wanted, (F.col("cell") == F.col("cell_")) & (F.col("slice") == F.col("slice_"))).select("id", "v", "cell_", "slice_", "block_")
        unit, rows_, digits = _unit, _rows, DIGITS

        def meet(left, right):
            qs, ids, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            if left.num_rows and right.num_rows:
                x, own = unit(rows_(left.column("v"))), left.column("id").to_numpy()
                y, q = unit(rows_(right.column("v"))), right.column("q").to_numpy()
                for at in range(0, len(q), 256):
                    s = np.round(y[at : at + 256] @ x.T, digits)
                    s[q[at : at + 256, None] == own] = -np.inf
                    # Order by score, then id: the k first of each query.
                    kth = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
                    row, col = np.nonzero((s >= kth[:, None]) & np.isfinite(s))
                    order = np.lexsort((own[col], -s[row, col], row))
                    row, col = row[order], col[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    row, col = row[place < k], col[place < k]
                    qs.append(q[at + row]), ids.append(own[col]), scores.append(s[row, col])
            return pa.table([pa.array(np.concatenate(qs)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], names=["q", "id", "cosine"])

        return rows.groupBy("cell_", "slice_", "block_").cogroup(visits.groupBy("cell", "slice", "block")).applyInArrow(meet, "q long, id long, cosine double")

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """(q, id, cosine, rank): the ``k`` nearest of each query (q, v), itself left out; ties go to the smaller id."""
        asked = queries.select(F.col("q").cast("long").alias("q"), F.col("v").cast("array<float>").alias("v"), F.lit(-2.0).alias("least"))
        asked = materialize(asked, "vector-queries")
        near = materialize(self._search(asked, True, k), "vector-near")
        order = Window.partitionBy("q").orderBy(F.desc("cosine"), "id")
        ends = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select("q", F.col("cosine").alias("kth"))
        rest = asked.join(ends, "q", "left").select("q", "v", F.coalesce("kth", "least").alias("least"))
        both = near.unionByName(self._search(materialize(rest, "vector-rest"), False, k))
        return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    return Cells(vectors).nearest(queries, k)


def united(words: DataFrame, like: DataFrame, least: float) -> DataFrame:
    """Candidates of both sources: (q, id) of ``words`` with their tier, and of ``like`` (q, id, cosine); rows of meaning alone need ``least``."""
    rows = words.select("q", "id", F.lit(True).alias("word")).join(like.select("q", "id", "cosine"), ["q", "id"], "full")
    tier = F.when(F.col("word") & F.col("cosine").isNotNull(), "both").when(F.col("word"), "word").when(F.col("cosine") >= least, "sem")
    return rows.withColumn("tier", tier).filter("tier is not null").drop("word")
