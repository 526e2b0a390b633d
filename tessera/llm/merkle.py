"""Merkle manifest of a dataset: a digest a row, a tree a group, one root, and a proof for every row.

A row's leaf is the sha256 of its fields, each `-` if null, else byte count, `:` and value. The
leaves of a group, in the order of their ids, are cut into aligned blocks of BLOCK = FANOUT^LEVELS
leaves. A block is a contiguous matrix of 64 hex bytes a row; a level reshapes it by FANOUT and hashes
its rows, and a node's siblings are slices found by index arithmetic. The blocks' roots are the nodes
of the next tree, in blocks again, until each group has one node, its subroot; the subroots are the
nodes of the last tree. What a block misses, the siblings above its root, comes by a join of one
row a block, so no task holds more than BLOCK leaves and their common path.

Positions come from a range partitioning by group and id: each partition counts its rows by
group, and the sums of earlier partitions are added. A group may hold any share of the rows.

Defined results: null ids come first, rows that tie on the id are ordered by leaf, and repeated rows
are leaves of their own; a null group is a group, ordered first; a group of one row has its leaf as
subroot, and a single group has its subroot as root; null and empty texts have different leaves; any
length of text is hashed whole; an empty table gives no row; columns that are not among the
fields take no part, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_batches, by_value, materialize

by_value(__name__)

FANOUT, LEVELS = 8, 4
BLOCK = FANOUT**LEVELS
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BLOCKS = "key string, block long, n long, ids array<long>, digests binary, altered array<string>, top string"
_PATH = "above binary, before array<int>, others array<int>"
_PATHS = f"key string, pos long, subroot string, {_PATH}"
_PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(columns: list[Column]) -> Column:
    """Lowercase hex sha256 of the fields, each `-` if null, else byte count, `:` and value."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


# ---------------------------------------------------------------- digest matrices


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def levels_of(nodes: np.ndarray, n: int) -> list[np.ndarray]:
    """The levels, each [nodes, 64] hex bytes, that a block of a tree with ``n`` nodes has, its root last."""
    out = [nodes]
    for _ in range(min(LEVELS, height(n))):
        below = out[-1]
        full = len(below) // FANOUT
        runs = [r.tobytes() for r in below[: full * FANOUT].reshape(full, FANOUT * HEX)]
        if full * FANOUT < len(below):
            runs.append(below[full * FANOUT :].tobytes())
        out.append(np.frombuffer(b"".join(map(_digest, runs)), np.uint8).reshape(-1, HEX))
    return out


def siblings(levels: list[np.ndarray], count: int):
    """Of each of the first ``count`` nodes: their siblings, how many stand before the node, how many there are, by level.

    Yields (bytes, [before], [others]); the node of level l is i // FANOUT^l, its run starts at a multiple of FANOUT.
    """
    below = [x.tobytes() for x in levels[:-1]]
    at = [np.arange(count) // FANOUT**k for k in range(len(below))]
    first = [a - a % FANOUT for a in at]
    last = [np.minimum(f + FANOUT, len(x)) for f, x in zip(first, levels, strict=False)]
    before = np.array([a - f for a, f in zip(at, first, strict=True)], np.int64).reshape(len(below), count).T.tolist()
    others = np.array([b - f - 1 for b, f in zip(last, first, strict=True)], np.int64).reshape(len(below), count).T.tolist()
    cuts = [(f * HEX, a * HEX, (a + 1) * HEX, b * HEX) for f, a, b in zip(first, at, last, strict=True)]
    cuts = [[x.tolist() for x in c] for c in cuts]
    for i in range(count):
        yield b"".join(data[c[0][i] : c[1][i]] + data[c[2][i] : c[3][i]] for data, c in zip(below, cuts, strict=True)), before[i], others[i]


def fold(leaf: bytes, path: bytes, before: list[int], others: list[int]) -> bytes:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    at = 0
    for left, n in zip(before, others, strict=True):
        middle, end = at + left * HEX, at + n * HEX
        leaf, at = _digest(path[at:middle] + leaf + path[middle:end]), end
    return leaf


# ---------------------------------------------------------------- Spark


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row a block of nodes (key, pos, n, digest, doc_id, altered), its matrix and its root."""

    def build(keys, table):
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        digests = "".join(table.column("digest").to_pylist()).encode()
        top = levels_of(np.frombuffer(digests, np.uint8).reshape(-1, HEX), n)[-1]
        row = [keys[0].as_py(), keys[1].as_py(), n, table.column("doc_id").to_pylist(), digests, table.column("altered").to_pylist(), top.tobytes().decode()]
        types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.string()]
        return pa.table([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["key", "block", "n", "ids", "digests", "altered", "top"])

    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("key", "block").applyInArrow(build, _BLOCKS)


def _upper(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"doc_id": F.lit(None).cast("long"), "altered": F.lit(None).cast("string")})


def _located(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the subroot of their key and the path from their root to it."""
    most = blocks.agg(F.max("n")).first()[0] or 0
    if most <= BLOCK:
        none = F.array().cast("array<int>")
        return blocks.withColumns({"subroot": F.col("top"), "above": F.lit(b""), "before": none, "others": none})
    roots = blocks.select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"))
    return blocks.join(_paths(_upper(roots)).withColumnRenamed("pos", "block"), ["key", "block"])


def _paths(nodes: DataFrame) -> DataFrame:
    """(key, pos, subroot, above, before, others) of every node."""

    def each(batches):
        for b in batches:
            for r in b.to_pylist():
                matrix = np.frombuffer(r["digests"], np.uint8).reshape(-1, HEX)
                count = len(matrix)
                own = list(siblings(levels_of(matrix, r["n"]), count))
                columns = [
                    pa.array([r["key"]] * count, pa.string()),
                    pa.array(np.arange(count) + r["block"] * BLOCK, pa.int64()),
                    pa.array([r["subroot"]] * count, pa.string()),
                    pa.array([path + r["above"] for path, _, _ in own], pa.binary()),
                    pa.array([x + r["before"] for _, x, _ in own], pa.list_(pa.int32())),
                    pa.array([x + r["others"] for _, _, x in own], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "pos", "subroot", "above", "before", "others"])

    located = _located(materialize(_blocks(nodes), "merkle-upper"))
    return located.select("key", "block", "n", "digests", "subroot", "above", "before", "others").mapInArrow(each, _PATHS)


def _positions(leaves: DataFrame) -> DataFrame:
    """``leaves`` with their position in their key (by doc_id, then digest) and the number of the key's leaves."""

    def counted(batches):
        key, seen = None, 0
        for b in batches:
            runs = pc.run_end_encode(b.column("key"))
            local = np.arange(b.num_rows, dtype=np.int64)
            start = 0
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if value != key:
                    key, seen = value, 0
                local[start:end] += seen - start
                seen, start = seen + end - start, end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local)], names=[*b.schema.names, "local"])

    ranged = leaves.repartitionByRange("key", "doc_id", "digest").sortWithinPartitions("key", "doc_id", "digest").withColumn("part", F.spark_partition_id())
    placed = materialize(ranged.mapInArrow(counted, "doc_id long, key string, digest string, altered string, part int, local long"), "merkle-leaves")
    counts = placed.groupBy("key", "part").agg(F.count("*").alias("own"))  # a row a partition and key of it
    by_part = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "key", "part", F.coalesce(F.sum("own").over(by_part), F.lit(0)).alias("before"), F.sum("own").over(Window.partitionBy("key")).alias("n")
    )
    joined = placed.join(counts, ["key", "part"])
    return joined.select("doc_id", "key", "digest", "altered", (F.col("before") + F.col("local")).alias("pos"), "n")


def merkle_blocks(docs: DataFrame, fields=FIELDS, group: str = "lang", order: str = "doc_id", altered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """The manifest: a row for each block of BLOCK leaves, with its ids, its digests, its path and the root of all.

    ``altered`` replaces fields of the rows that satisfy ``where`` by what a copy of the dataset holds;
    the digests of those go beside the leaves, for the proofs to be checked against.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    leaf = leaf_digest([docs[c] for c in fields])
    other = F.lit(None).cast("string")
    if altered:
        other = F.when(where, leaf_digest([altered.get(c, docs[c]) for c in fields]))
    key = F.coalesce(F.concat(F.lit("="), docs[group]), F.lit(""))
    leaves = docs.select(docs[order].cast("long").alias("doc_id"), key.alias("key"), leaf.alias("digest"), other.alias("altered"))
    leaves = materialize(leaves, "merkle-digests")  # hashed once: ranges are sampled from these
    located = materialize(_located(materialize(_blocks(_positions(leaves)), "merkle-blocks")), "merkle-located")
    # One row a group: their number is that of the values of `group`.
    subroots = located.filter("block = 0").select("key", F.col("subroot").alias("digest"))
    ordered = subroots.withColumns({"pos": F.row_number().over(Window.orderBy("key")).cast("long") - 1, "n": F.count("*").over(Window.partitionBy(F.lit(0)))})
    ordered = materialize(ordered, "merkle-subroots")
    paths = _paths(_upper(ordered.withColumn("key", F.lit(""))))
    tops = ordered.select("key", "pos").join(paths.drop("key"), "pos").drop("pos")
    tops = tops.select("key", F.col("subroot").alias("root"), *[F.col(c).alias(f"{c}_top") for c in ("above", "before", "others")])
    return located.join(tops, "key").select(
        "key", "block", "n", "ids", "digests", "altered", "subroot", "root", *[F.concat(c, f"{c}_top").alias(c) for c in ("above", "before", "others")]
    )


def merkle_proofs(blocks: DataFrame) -> DataFrame:
    """A row for each leaf: its digest, the roots, the hash of its siblings, and the root that its altered or own digest folds to."""

    def each(batches):
        for b in batches:
            for r in b.to_pylist():
                matrix = np.frombuffer(r["digests"], np.uint8).reshape(-1, HEX)
                count, root = len(matrix), r["root"].encode()
                leaves = [r["digests"][i : i + HEX] for i in range(0, count * HEX, HEX)]
                proofs, folded = [], []
                for leaf, other, (own, before, others) in zip(leaves, r["altered"], siblings(levels_of(matrix, r["n"]), count), strict=True):
                    path = own + r["above"]
                    proofs.append(hashlib.sha256(path).hexdigest())
                    folded.append(fold(other.encode() if other else leaf, path, before + r["before"], others + r["others"]).decode())
                columns = [
                    pa.array(r["ids"], pa.int64()), pa.array([x.decode() for x in leaves]), pa.array([r["subroot"]] * count), pa.array([r["root"]] * count),
                    pa.array(proofs), pa.array(folded), pa.array([x.encode() == root for x in folded]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return blocks.mapInArrow(each, _PROOFS)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Proofs of all documents against a copy that holds the text of every third id (by crc32) in lower case."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
    return merkle_proofs(merkle_blocks(docs, altered={"text": F.translate(docs["text"], UPPER, LOWER_CASE)}, where=tampered))


_FIELD = "coalesce(octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS[:-1]) + " || {0})"
_CRC = (
    "xor(list_reduce([4294967295::bigint] || list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint), "
    "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
)
_CASE = f"translate(text, '{UPPER}', '{LOWER_CASE}')"
_TREE = """{name} AS (
    SELECT key, 0 AS lv, pos, digest, n FROM {nodes}
    UNION ALL
    SELECT key, lv + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 7) // 8) FROM {name} WHERE n > 1 GROUP BY key, lv, pos // 8
)"""
OP11_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS key, {_LEAF.format(_FIELD.format("text"))} AS digest,
        CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(_FIELD.format(_CASE))} END AS altered
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM leaves
), {_TREE.format(name="low", nodes="placed")}, subroots AS (
    SELECT '' AS key, key AS part, digest, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), {_TREE.format(name="high", nodes="subroots")}, sides AS (
    SELECT 0 AS tree, a.key, a.lv, a.pos, string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos) AS l, string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos) AS r
    FROM low a JOIN low b ON a.key = b.key AND a.lv = b.lv AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL
    UNION ALL
    SELECT 1, a.key, a.lv, a.pos, string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos)
    FROM high a JOIN high b ON a.lv = b.lv AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL
), steps AS (
    SELECT p.key, p.pos, s.lv, s.tree, coalesce(s.l, '') AS l, coalesce(s.r, '') AS r FROM placed p JOIN sides s ON s.tree = 0 AND s.key = p.key AND s.pos = p.pos // (8 ** s.lv)::bigint
    UNION ALL
    SELECT p.key, p.pos, s.lv, s.tree, coalesce(s.l, ''), coalesce(s.r, '') FROM placed p JOIN subroots u ON u.part = p.key JOIN sides s ON s.tree = 1 AND s.pos = u.pos // (8 ** s.lv)::bigint
), paths AS (
    SELECT key, pos, list(struct_pack(x := l, h := '', y := r) ORDER BY tree, lv) AS path, string_agg(l || r, '' ORDER BY tree, lv) AS own FROM steps GROUP BY key, pos
), proofs AS (
    SELECT p.doc_id, p.digest AS leaf, u.digest AS subroot, (SELECT digest FROM high WHERE n = 1) AS root, sha256(coalesce(q.own, '')) AS proof_sha256,
        list_reduce([struct_pack(x := '', h := coalesce(p.altered, p.digest), y := '')] || coalesce(q.path, []), lambda c, s: struct_pack(x := '', h := sha256(s.x || c.h || s.y), y := '')).h AS folded_root
    FROM placed p JOIN subroots u ON u.part = p.key LEFT JOIN paths q ON q.key = p.key AND q.pos = p.pos
)
SELECT *, folded_root = root AS verified FROM proofs
"""
