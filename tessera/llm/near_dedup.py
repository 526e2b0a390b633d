"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

Sketch. A document's set of word shingles is thrown into COORDS bins, round after round
with fresh hashes, a bin keeping its smallest (round, hash); after COORDS rounds, round
COORDS + i hashes all elements into bin i, so every coordinate fills, and few rounds do
for large sets. The share of equal coordinates is concentrated around the Jaccard
similarity as with independent permutations.

Candidates. BANDS bands of ROWS coordinates; equal band keys make a bucket. Identical
texts are one node before anything is compared (told apart by 128 bits of hash).

Round 1 compares each node with the bucket's leader (its smallest node): one candidate a
node and band. Verified links are merged into components. Round 2 looks only at buckets that
still hold several components. Their nodes meet in tiles (a block of the bucket's nodes, and
a block of those outside its main component) that carry sketches and full shingle sets, so a
tile verifies at once: a node skips every component it is already linked to, and only links
that merge two components leave the tile. A tile therefore emits fewer links than it has
nodes, however alike they are; a pair is examined in the first band that its nodes share.
What stays quadratic at worst is comparing sketches of nodes that no link reaches with the
rest of their bucket, dealt over tiles of bounded size. No link between different components
is lost (up to the chance that banding or the estimate misses a pair: below 1e-4 at the
threshold, and a component is wrong only if that pair was its only link).

Leaders and heavy buckets are dealt out by salt; texts move only for nodes with a candidate.

Defined results: words are runs without ASCII white space after lower-casing A-Z; fewer
words than a shingle: the whole sequence is one shingle; null, empty or blank text has an
empty set, is linked with nothing, and keeps its own doc_id (kept); rows repeating a
doc_id with other texts are joined through that id; null ids order last; an empty table
gives an empty result; further columns pass through (clashing names are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, U64, arrow_batches, by_value, fresh, materialize, mix, prefix_hash, slices, span_hash, word_spans

by_value(__name__)

SHINGLE = 5
BANDS, ROWS = 32, 4
#: Coordinates of a sketch; the bands take the first BANDS * ROWS, estimates take all.
COORDS = 512
#: Similarity threshold in hundredths, and the lowest estimate that is still verified (4 sigma below).
PERCENT = 75
ESTIMATE = 0.675
#: Members of one leader, or nodes (and bytes of their shingle sets) of one block of a bucket, that a task compares at once.
BLOCK = 2000
BLOCK_BYTES = 16 << 20
#: Stands for a null id in join keys.
NO_ID = -(1 << 63)


def shingle_hashes(column: pa.Array, width: int = SHINGLE):
    """(first row, hashes sorted and distinct within each row, first hash of each row and the end)."""
    for first, data, offsets in slices(column):
        data = LOWER[data]
        rows = len(offsets) - 1
        starts, ends, bound = word_spans(data, offsets)
        h = span_hash(prefix_hash(data), starts, ends)
        n = np.diff(bound)
        doc = np.repeat(np.arange(rows), n)
        # Order-sensitive sum over the following words; a short document has one shingle of all its words.
        left = np.minimum(width, np.repeat(n, n))
        pad = np.concatenate([h, np.zeros(width, np.uint64)])
        s = np.zeros(len(h), np.uint64)
        factor = U64(0x9FB21C651E98DF25)
        for i in range(width):
            s = np.where(i < left, mix(s * factor + pad[i : i + len(h)] + U64(1)), s)
        place = np.arange(len(h)) - bound[doc]
        valid = place <= np.maximum(0, np.repeat(n, n) - width)
        s, doc = s[valid], doc[valid]
        order = np.lexsort((s, doc))
        s, doc = s[order], doc[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        s, doc = s[new], doc[new]
        yield first, s, np.searchsorted(doc, np.arange(rows + 1))


def sketch(elements: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Fast similarity sketch of distinct 64-bit elements (not empty): one value a coordinate."""
    low, done = np.full(coords, ~U64(0), dtype=np.uint64), 0
    while done < coords:
        # Several rounds at once for small sets; a key starts with its round, so an earlier round always wins.
        k = min(coords - done, -(-3 * coords // len(elements)))
        rounds = np.arange(done, done + k, dtype=np.uint64)[:, None]
        h = mix(elements[None, :] ^ mix(rounds + U64(1)))
        bins = h & U64(coords - 1) if coords & (coords - 1) == 0 else h % U64(coords)
        np.minimum.at(low, bins.astype(np.int64).ravel(), (rounds << U64(54) | h >> U64(10)).ravel())
        if low.max() != ~U64(0):
            return mix(low)
        done += k
    for i in np.flatnonzero(low == ~U64(0)):
        h = mix(elements ^ mix(np.array([coords + i + 1], np.uint64)))
        low[i] = U64(coords) << U64(54) | h.min() >> U64(10)
    return mix(low)


def band_keys(sk: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, from its coordinates and number; for a matrix of sketches."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :]
    for i in range(ROWS):
        key = mix(key * U64(0x9FB21C651E98DF25) + sk[:, i : BANDS * ROWS : ROWS])
    return key


def _sketch_rows(batches):
    for b in batches:
        ids, k1, k2 = (b.column(c) for c in ("doc_id", "k1", "k2"))
        for first, s, at in shingle_hashes(b.column("text")):
            n = len(at) - 1
            full = np.flatnonzero(np.diff(at))
            sk = np.zeros((len(full), COORDS), np.uint64)
            for i, k in enumerate(full):
                sk[i] = sketch(s[at[k] : at[k + 1]])
            small, keys = [None] * n, [None] * n
            for k, low, own in zip(full.tolist(), sk.astype(np.uint8), band_keys(sk).view(np.int64), strict=True):
                small[k], keys[k] = low.tobytes(), own
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, n), k1.slice(first, n), k2.slice(first, n), pa.array(np.diff(at)), pa.array(small, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "k1", "k2", "n_shingles", "sk", "bands"],
            )


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches' low bytes, row by row; chance equality is taken out."""
    same = (a == b).mean(-1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _estimate(batches):
    for b in batches:
        x = np.frombuffer(b"".join(b.column("sk_a").to_pylist()), np.uint8).reshape(-1, COORDS)
        y = np.frombuffer(b"".join(b.column("sk_b").to_pylist()), np.uint8).reshape(-1, COORDS)
        yield b.select(["a", "b"]).filter(pa.array(_similar(x, y) >= ESTIMATE))


def _verify(batches):
    """Rows sorted by (a, salt, role): the leader's text, then its members'. Emits linked pairs."""
    leader, base = None, None
    for b in batches:
        la, role, lb = b.column("a").to_pylist(), b.column("role").to_pylist(), b.column("b").to_pylist()
        out = []
        for first, s, at in shingle_hashes(b.column("text")):
            for i in range(len(at) - 1):
                own, k = s[at[i] : at[i + 1]], first + i
                if role[k] == 0:
                    leader, base = la[k], own.copy()
                elif la[k] == leader:
                    both = len(np.intersect1d(base, own, assume_unique=True))
                    if 100 * both >= PERCENT * (len(base) + len(own) - both) and both:
                        out.append((la[k], lb[k]))
        yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that are linked on full shingle sets. A leader's members come in salted blocks."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    members = pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("k")).cast("int"))
    heads = sizes.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = members.select("a", "b", "salt", F.lit(1).alias("role")).unionByName(heads)
    rows = wanted.join(texts.withColumnRenamed("node", "b").hint("merge"), "b")
    lanes = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(lanes, "a", "salt").sortWithinPartitions("a", "salt", "role", "b")
    return rows.select("a", "b", "role", "text").mapInArrow(_verify, "a long, b long")


def _components(edges: DataFrame, name: str) -> DataFrame:
    """(node, comp): smallest reachable node, by alternating large-star and small-star until nothing changes."""
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    step, last = 0, mark(edges)
    while last[0]:
        step += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("x"), "u", "m")
        new = small.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        new = materialize(new.filter("u <> v").distinct(), f"{name}-{step}")
        now = mark(new)
        edges, done, last = new, now == last, now
        if done:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _sets(batches):
    for b in batches:
        for first, s, at in shingle_hashes(b.column("text")):
            n = len(at) - 1
            yield pa.RecordBatch.from_arrays([b.column("node").slice(first, n), pa.array([s[at[i] : at[i + 1]].tobytes() for i in range(n)], pa.binary())], names=["node", "full"])


def _mixed(keys: DataFrame, comps: DataFrame) -> DataFrame:
    """Bucket rows (band, node, comp) of the buckets that hold several components; round 1 has compared all of a pair's bucket."""
    rows = keys.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = rows.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).filter("x < y and n > 2").select("band")
    return rows.join(split, "band", "left_semi")


def _across(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) that merge components within buckets: ``rows`` (band, node, comp) and ``nodes`` (node, sk, bands, full)."""
    rows = rows.join(nodes.select("node", F.octet_length("full").alias("bytes")), "node")
    per = rows.groupBy("band", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("m"))
    buckets = per.groupBy("band").agg(
        F.sum("n").alias("size"), F.sum("m").alias("bytes"), F.max_by(F.struct("comp", "n", "m"), F.struct("n", "comp")).alias("main")
    )
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    others = F.ceil(F.greatest((F.col("size") - F.col("main.n")) / BLOCK, (F.col("bytes") - F.col("main.m")) / BLOCK_BYTES)).cast("int")
    buckets = buckets.select("band", blocks.alias("blocks"), others.alias("others"), F.col("main.comp").alias("main"))
    rows = rows.drop("bytes").join(buckets, "band")
    spread = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    i, j = (spread % F.col("blocks")).cast("int"), (spread % F.col("others")).cast("int")
    all_ = rows.select("band", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("j"), "node", "comp", F.lit(0).alias("side"))
    out_ = rows.filter("comp <> main").select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), j.alias("j"), "node", "comp", F.lit(1).alias("side"))
    tiles = all_.unionByName(out_).join(nodes.hint("merge"), "node")
    lanes = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = tiles.repartition(lanes, "band", "i", "j").sortWithinPartitions("band", "i", "j", "side", "node")
    return tiles.select("band", "i", "j", "side", "node", "comp", "sk", "bands", "full").mapInArrow(_tiles, "a long, b long").distinct()


class _Block:
    """Nodes of one tile's block, and the components that are merged so far (by label)."""

    def __init__(self, rows: list[tuple]):
        self.node = np.array([r[0] for r in rows], np.int64)
        self.comp = np.array([r[1] for r in rows], np.int64)
        self.sk = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, COORDS)
        self.bands = np.array([r[3] for r in rows], np.int64).reshape(-1, BANDS)
        self.full = [r[4] for r in rows]
        self.size = np.array([len(r[4]) // 8 for r in rows], np.int64)
        self.label: dict[int, int] = {}

    def links(self, band: int, node: int, comp: int, sk: bytes, bands: list[int], full: bytes):
        """Partners of a node, at most one of each component that it isn't yet merged with."""
        own = self.label.get(comp, comp)
        open_ = np.flatnonzero((self.comp != own) & (4 * np.minimum(self.size, len(full) // 8) >= 3 * np.maximum(self.size, len(full) // 8)))
        if not len(open_):
            return
        earlier = bands.index(band)
        open_ = open_[~(self.bands[open_, :earlier] == np.array(bands[:earlier], np.int64)).any(1)]
        like = _similar(self.sk[open_], np.frombuffer(sk, np.uint8))
        near = like >= ESTIMATE
        base = np.frombuffer(full, np.uint64)
        for k in open_[near][np.argsort(-like[near], kind="stable")].tolist():
            if self.comp[k] == own:
                continue
            other = np.frombuffer(self.full[k], np.uint64)
            both = len(np.intersect1d(base, other, assume_unique=True))
            if 100 * both >= PERCENT * (len(base) + len(other) - both):
                gone = self.comp[k]
                self.comp[self.comp == gone] = own
                for c, to in self.label.items():
                    if to == gone:
                        self.label[c] = own
                self.label[int(gone)] = own
                yield int(self.node[k])


def _tiles(batches):
    """Streams tiles: the nodes of a block, then those outside the main component, which are compared with it."""
    tile, held, block = None, [], None
    for b in batches:
        left, right = [], []
        for band, i, j, side, *row in zip(*(b.column(c).to_pylist() for c in ("band", "i", "j", "side", "node", "comp", "sk", "bands", "full")), strict=True):
            if tile != (band, i, j):
                tile, held, block = (band, i, j), [], None
            if side == 0:
                held.append(row)
                continue
            if block is None:
                block, held = _Block(held), []
            for x in block.links(band, *row):
                left.append(min(x, row[0])), right.append(max(x, row[0]))
        yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _keyed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """doc_id, text (null: empty), and 128 bits of hash that stand for the text."""
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    size = F.octet_length("text")
    return slim.withColumns({"k1": F.xxhash64("text", size), "k2": F.xxhash64(size, F.lit(1), "text")})


def near_classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, k1, k2, n_shingles, component_id), a row for each of ``docs``; k1 and k2 stand for the text."""
    spark = docs.sparkSession
    arrow_batches(spark)
    slim = _keyed(docs, text, id_col)
    rows = materialize(slim.mapInArrow(_sketch_rows, "doc_id long, k1 long, k2 long, n_shingles long, sk binary, bands array<long>"), "near-sketch")
    nodes = rows.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.first("sk").alias("sk"), F.first("bands").alias("bands"), F.min("doc_id").alias("low"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    keys = nodes.select("node", F.explode("bands").alias("band"))
    leaders = keys.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").select("band", "a")
    # Written first: a join straight from a shuffle lets Spark split a hot bucket.
    leaders = materialize(leaders, "near-leaders")
    pairs = keys.join(leaders.hint("merge"), "band").filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    sk = nodes.select("node", "sk")
    pairs = pairs.join(sk.toDF("a", "sk_a"), "a").join(sk.toDF("b", "sk_b"), "b").select("a", "b", "sk_a", "sk_b")
    pairs = materialize(pairs.mapInArrow(_estimate, "a long, b long"), "near-pairs")

    def texts_of(need):
        # One row of each text, by its smallest id; a merge join at every size: texts move once, by key.
        named = nodes.join(need.distinct(), "node").select("node", "k1", "k2", F.coalesce("low", F.lit(NO_ID)).alias("low"))
        own = slim.select("k1", "k2", F.coalesce("doc_id", F.lit(NO_ID)).alias("low"), "text")
        return own.join(named.hint("merge"), ["k1", "k2", "low"]).dropDuplicates(["node"]).select("node", "text")

    links = materialize(_verified(pairs, texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))), "near-links")
    comps = _components(links, "near-comp")
    mixed = materialize(_mixed(keys, comps), "near-mixed")
    if not mixed.isEmpty():
        full = texts_of(mixed.select("node")).mapInArrow(_sets, "node long, full binary")
        full = materialize(full.join(nodes.select("node", "sk", "bands"), "node"), "near-sets")
        found = materialize(_across(mixed, full), "near-links2")
        if not found.isEmpty():
            comps = _components(comps.toDF("a", "b").unionByName(found), "near-comp2")
    # Rows that repeat an id with several texts are one document for reachability.
    named = rows.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "k1", "k2")
    twice = named.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("x"), F.max(F.struct("k1", "k2")).alias("y"))
    ids = materialize(twice.filter("x <> y").select("doc_id"), "near-ids")
    if not ids.isEmpty():
        same = named.join(ids, "doc_id").join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select("doc_id", "node").distinct()
        same = same.join(same.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").filter("a <> node")
        comps = _components(comps.toDF("a", "b").unionByName(same.select("a", F.col("node").alias("b"))), "near-comp-ids")
    # Ids combine by text, then by component; they come back to the rows by one join.
    placed = nodes.select("node", "k1", "k2", "low").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = placed.join(placed.groupBy("comp").agg(F.min("low").alias("component_id")), "comp").select("k1", "k2", "component_id")
    placed = materialize(placed, "near-classes")
    out = rows.select("doc_id", "k1", "k2", "n_shingles").join(placed, ["k1", "k2"], "left")
    return out.select("doc_id", "k1", "k2", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` plus n_shingles, component_id and kept (the row whose id is its component's)."""
    new = ["n_shingles", "component_id", "kept"]
    docs = docs.select([c for c in docs.columns if c.lower() not in new])
    d, x, y = fresh(docs, "_near_id", "_near_k1", "_near_k2")
    classes = near_classes(docs, text, id_col).distinct().withColumnsRenamed({"doc_id": d, "k1": x, "k2": y})
    body = F.coalesce(docs[text], F.lit(""))
    size = F.octet_length(body)
    same = (F.xxhash64(body, size) == F.col(x)) & (F.xxhash64(size, F.lit(1), body) == F.col(y))
    out = docs.join(classes, docs[id_col].cast("long").eqNullSafe(F.col(d)) & same, "left")
    return out.select(*[docs[c] for c in docs.columns], "n_shingles", "component_id", docs[id_col].cast("long").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_classes(docs)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
