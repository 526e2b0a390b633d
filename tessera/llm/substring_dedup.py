"""Repeated substrings: run-compressed BWT with sampled run ends over candidate blocks.

Every window of LENGTH bytes picks an anchor: the leftmost smallest hash among its strings
of ANCHOR bytes. Equal windows pick equal anchors, so a window can repeat only where its
anchor does. The windows of one anchor form a block (at most 2 * LENGTH bytes):

1. Blocks are counted by anchor. An anchor seen once: nothing repeats. Seen several times,
   always in the same block: all its windows repeat.
2. An anchor with several different blocks: equal blocks repeat as a whole; one copy of each
   different block, with its count, goes to the run index of its anchor. There the blocks'
   suffixes are sorted, and of the Burrows-Wheeler transform only run heads, run lengths and
   samples at run ends are kept: text positions, and their longest common prefix across the
   end. Matching statistics are streamed from these samples (each step through the text loses
   one byte until the next sample), and statistics of LENGTH or more mark a window.
3. An index takes at most INDEX_BLOCKS different blocks. Where an anchor has more, its index
   is cut into shards: a window reaches over the anchor to the left or to the right by at least
   half of what it is longer, so windows that reach left meet others with the same bytes
   there, and windows that reach right likewise. Blocks become two smaller ones each, and
   steps 2 and 3 are repeated with the longer anchors (eight times at most).

Covered bytes are removed. Only hashes are shuffled in step 1; texts move by key in the two
joins that cut out candidate blocks and apply the spans, and Spark can split a hot key there.

Defined results: null counts as empty; texts shorter than LENGTH keep all bytes; rows that
repeat a text repeat each other's bytes; matches never cross texts; an empty table gives an
empty result; further columns pass through (clashing names are replaced). Texts are told
apart by 128 bits of hash, blocks of one anchor and anchors by 64 bits each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, arrow_batches, by_value, fresh, materialize, prefix_hash, slices, span_hash

by_value(__name__)

LENGTH = 200
ANCHOR = 32
INDEX_BLOCKS = 8000
#: Copies of a block from which it is joined apart, and how many such blocks there can be.
HOT_ROWS, HOT_KEYS = 50_000, 10_000
INDEX_BYTES = 1 << 20
POSITION_BITS = 24
#: Window starts that are worked on at once; a longer text is cut between windows.
STRIDE = 1 << 22
BLOCK = "tid long, fp long, bkey long, lo int, len int"
SPAN = "tid long, lo int, len int"
#: A block's bytes; left and right: place of the anchor in it (-1: not known yet).
CUT = "fp long, tid long, lo int, n long, body binary, left int, right int"


def block_spans(data: np.ndarray, offsets: np.ndarray):
    """Blocks of all texts: anchor hash, block hash, text number, first byte, length (from the text's start)."""
    m, w = len(data) - ANCHOR + 1, LENGTH - ANCHOR + 1
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    h = prefix_hash(data)
    at = np.arange(m)
    v = span_hash(h, at, at + ANCHOR)
    # Order by hash, then place: the leftmost wins, and the place can be read off the minimum.
    order = (v >> U64(POSITION_BITS) << U64(POSITION_BITS)) | at.astype(np.uint64)
    pad = -(-m // w) * w
    grid = np.full(pad, ~U64(0), np.uint64)
    grid[:m] = order
    grid = grid.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - LENGTH + 1
    place = (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & U64((1 << POSITION_BITS) - 1)).astype(np.int64)
    size = np.diff(offsets)
    text = np.repeat(np.arange(len(size)), size)[:n]
    valid = np.arange(n) + LENGTH <= np.repeat(offsets[1:], size)[:n]
    head = valid.copy()
    head[1:] &= ~valid[:-1] | (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(head)
    tail = valid.copy()
    tail[:-1] &= ~valid[1:] | head[1:]
    hi = np.flatnonzero(tail)
    return v[place[lo]], span_hash(h, lo, hi + LENGTH), text[lo], lo - offsets[text[lo]], hi - lo + LENGTH


def _pieces(column: pa.Array):
    """As slices(), but a text longer than STRIDE comes in overlapping parts; with the part's place in its text."""
    for first, data, offsets in slices(column):
        if len(data) <= 2 * STRIDE:
            yield first, 0, data, offsets
        else:
            for i in range(0, max(1, len(data) - LENGTH + 1), STRIDE):
                part = data[i : i + STRIDE + LENGTH - 1]
                yield first, i, part, np.array([0, len(part)])


def _block_rows(batches):
    for b in batches:
        tid = b.column("tid").to_numpy()
        for first, shift, data, offsets in _pieces(b.column("text")):
            fp, key, text, lo, size = block_spans(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tid[first + text]), pa.array(fp.view(np.int64)), pa.array(key.view(np.int64)), pa.array((lo + shift).astype(np.int32)), pa.array(size.astype(np.int32))],
                names=["tid", "fp", "bkey", "lo", "len"],
            )


def _cut(batches):
    """Bytes of the wanted blocks of each text."""
    for b in batches:
        out = []
        for tid, text, wanted in zip(b.column("tid").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("wanted").to_pylist(), strict=True):
            out += [(x["fp"], tid, x["lo"], x["n"], text[x["lo"] : x["lo"] + x["len"]], -1, -1, x["many"]) for x in wanted]
        yield _record(out, f"{CUT}, many boolean")


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _shards(batches):
    """Two smaller blocks of each: its windows that reach left of the anchor by half of what they are longer, and the others."""
    for b in batches:
        out = []
        for fp, tid, lo, n, body, left, right in zip(*(b.column(c).to_pylist() for c in ("fp", "tid", "lo", "n", "body", "left", "right")), strict=True):
            if left < 0:  # the anchor lies in all windows; its leftmost place there was taken
                h = prefix_hash(np.frombuffer(body, np.uint8))
                at = np.arange(len(body) - LENGTH, LENGTH - ANCHOR + 1)
                left = int(at[np.flatnonzero(span_hash(h, at, at + ANCHOR).view(np.int64) == fp)[0]])
                right = left + ANCHOR
            slack = LENGTH - (right - left)
            half = -(-slack // 2)
            first, last = 0, len(body) - LENGTH  # window starts
            cut = min(last, left - half)
            for s, e, x, y in ((first, cut, left - half, right), (max(first, cut + 1), last, left, right + slack - half + 1)):
                if s <= e and slack:
                    part = body[s : e + LENGTH]
                    key = hashlib.blake2b(body[x:y] + fp.to_bytes(8, "little", signed=True) + bytes([x == left]), digest_size=8)
                    kind = hashlib.blake2b(part, digest_size=8)
                    to_long = lambda d: int.from_bytes(d.digest(), "little", signed=True)
                    out.append((to_long(key), tid, lo + s, n, part, x - s, y - s, to_long(kind)))
        yield _record(out, f"{CUT}, bkey long")


def suffix_order(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of concatenated blocks by prefix doubling from 7 symbols on.

    symbols: byte + 1; ends: end of the block that holds each position. A suffix stops at its block's end.
    """
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(8, np.uint64)])
    at = np.arange(n)
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << U64(9)) | np.where(at + i < ends, padded[i : n + i], U64(0))
    width = 7
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.zeros(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], sorted_[1:] != sorted_[:-1]]))
        if width >= 2 * LENGTH or int(rank.max()) == n:
            return order
        ahead = np.minimum(at + width, n - 1)
        second = np.where(at + width < ends, rank[ahead], 0)
        key = (rank.astype(np.uint64) << U64(32)) | second.astype(np.uint64)
        width *= 2


def common_prefix(a: np.ndarray, b: np.ndarray, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Longest common prefixes of suffixes a and b within their blocks, by eight bytes and then one at a time."""
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    room = np.minimum(ends[a] - a, ends[b] - b)
    total, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    for step in (8, 1):
        open_ = np.arange(len(a))
        while len(open_ := open_[total[open_] + step <= room[open_]]):
            same = (wide[a[open_] + total[open_], :step] == wide[b[open_] + total[open_], :step]).all(1)
            open_ = open_[same]
            total[open_] += step
    return total


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of concatenated blocks; what is kept is linear in the runs.

    heads, lengths: symbol and length of each run (a block's start is a run of its own).
    at, reach: sampled text positions beside run ends, in order, and how far a match that
    starts at one of them or before reaches.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        symbols, size = data.astype(np.int64) + 1, np.diff(offsets)
        ends = np.repeat(offsets[1:], size)
        order = suffix_order(symbols, ends)
        before = np.where(order > 0, symbols[np.maximum(order - 1, 0)], 0)
        start = np.zeros(len(data), bool)
        start[offsets[:-1][size > 0]] = True
        first = start[order]
        before[first] = -1 - order[first]
        last = np.flatnonzero(before[1:] != before[:-1])  # ends of runs but for the last one
        self.heads = before[np.concatenate([[0], last + 1])] if len(data) else before
        self.lengths = np.diff(np.concatenate([[0], last + 1, [len(data)]]))
        lcp = common_prefix(order[last], order[last + 1], data, ends)
        at, reach = np.concatenate([order[last], order[last + 1]]), np.tile(lcp, 2)
        self.at, where = np.unique(at, return_inverse=True)
        self.reach = np.zeros(len(self.at), np.int64)
        np.maximum.at(self.reach, where, reach + at)
        self.reach = np.maximum.accumulate(self.reach)

    def statistics(self, lo: int, hi: int) -> np.ndarray:
        """For each position from lo to hi: length of its longest match that starts anywhere else."""
        place = np.arange(lo, hi)
        if not len(self.at):
            return np.zeros(hi - lo, np.int64)
        k = np.searchsorted(self.at, place, side="right") - 1
        return np.where(k >= 0, np.maximum(self.reach[np.maximum(k, 0)] - place, 0), 0)


def _index(batches):
    """Rows sorted by anchor. Emits repeated window ranges (tid, lo, len) of each index."""
    held, size, last = [], 0, None

    def flush():
        if len(held) < 2:
            return
        offsets = np.concatenate([[0], np.cumsum([len(x[2]) for x in held])])
        index = RunIndex(np.frombuffer(b"".join(x[2] for x in held), np.uint8), offsets)
        for i, (tid, lo, _, n) in enumerate(held):
            hit = index.statistics(offsets[i], offsets[i + 1]) >= LENGTH
            if n == 1 and hit.any():
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    yield tid, lo + s, e - s - 1 + LENGTH

    for b in batches:
        for fp, tid, lo, n, body in zip(*(b.column(c).to_pylist() for c in ("fp", "tid", "lo", "n", "body")), strict=True):
            if fp != last and size >= INDEX_BYTES:
                yield _record(list(flush()), SPAN)
                held, size = [], 0
            last = fp
            held.append((tid, lo, body, n))
            size += len(body)
    yield _record(list(flush()), SPAN)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(tid, lo, len): byte ranges covered by repeated strings, for ``texts`` (tid, text)."""
    spark = texts.sparkSession
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(texts.mapInArrow(_block_rows, BLOCK), "sub-blocks")
    anchors = rows.groupBy("fp").agg(F.count("*").alias("total"), F.min("bkey").alias("k0"), F.max("bkey").alias("k1"))
    # Written first: a join straight from a shuffle lets Spark split a hot anchor.
    anchors = materialize(anchors.filter("total > 1").select("fp", (F.col("k0") == F.col("k1")).alias("same")), "sub-anchors")
    again = materialize(rows.join(anchors, "fp"), "sub-again")
    whole = again.filter("same").select("tid", "lo", "len")
    mixed = again.filter("not same")
    kinds = mixed.groupBy("fp", "bkey").agg(F.count("*").alias("n"), F.min(F.struct("tid", "lo", "len")).alias("one"))
    kinds = materialize(kinds, "sub-kinds")
    twice = kinds.filter("n > 1")
    # Blocks with very many copies would meet in one task: at most HOT_KEYS of them, which every task can hold.
    most = kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = twice.filter(F.col("n") > max(HOT_ROWS, most // HOT_KEYS)).select("fp", "bkey")
    cold = twice.filter(F.col("n") <= max(HOT_ROWS, most // HOT_KEYS)).select("fp", "bkey")
    for rows_, keys in ((mixed, F.broadcast(hot)), (mixed.join(F.broadcast(hot), ["fp", "bkey"], "left_anti"), cold)):
        whole = whole.unionByName(rows_.join(keys, ["fp", "bkey"]).select("tid", "lo", "len"))
    per = kinds.groupBy("fp").agg(F.count("*").alias("blocks")).filter(F.col("blocks") > INDEX_BLOCKS)
    per = materialize(per.select("fp", F.lit(True).alias("many")), "sub-many")
    wanted = kinds.join(per, "fp", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    wanted = wanted.select("one.tid", F.struct("fp", "one.lo", "one.len", "n", "many").alias("w"))
    wanted = wanted.groupBy("tid").agg(F.collect_list("w").alias("wanted"))  # at most a text's own blocks
    once = texts.join(wanted, "tid").dropDuplicates(["tid"])
    bodies = materialize(once.select("tid", "text", "wanted").mapInArrow(_cut, f"{CUT}, many boolean"), "sub-bodies")

    def indexed(blocks):
        rows = blocks.select("fp", "tid", "lo", "n", "body").repartition(lanes, "fp").sortWithinPartitions("fp", "tid", "lo")
        return rows.mapInArrow(_index, SPAN)

    found, level = [whole, indexed(bodies.filter("not many"))], 0
    many = bodies.filter("many")
    while not many.isEmpty():
        level += 1
        parts = materialize(many.select(*[x.split()[0] for x in CUT.split(", ")]).mapInArrow(_shards, f"{CUT}, bkey long"), f"sub-shards{level}")
        kinds = parts.groupBy("fp", "bkey").agg(F.sum("n").alias("all"), F.min(F.struct("tid", "lo")).alias("one"))
        kinds = materialize(kinds.withColumnsRenamed({"fp": "f", "bkey": "k"}), f"sub-kinds{level}")
        per = materialize(kinds.groupBy(F.col("f").alias("g")).agg(F.count("*").alias("blocks")).filter("blocks > 1"), f"sub-many{level}")
        parts = parts.join(kinds, (F.col("fp") == F.col("f")) & (F.col("bkey") == F.col("k")))
        found.append(parts.filter("n = 1 and all > 1").select("tid", "lo", F.octet_length("body").alias("len")))
        left = parts.filter(F.struct("tid", "lo") == F.col("one")).withColumn("n", F.col("all")).join(per, F.col("fp") == F.col("g"))
        left = materialize(left.select(*many.columns[:-1], "blocks"), f"sub-left{level}")
        found.append(indexed(left.filter(F.col("blocks") <= INDEX_BLOCKS)))
        many = left.filter(F.col("blocks") > INDEX_BLOCKS)
    spans = found[0]
    for x in found[1:]:
        spans = spans.unionByName(x)
    return materialize(spans.distinct(), "sub-spans")


def _apply(text: bytes, spans: list | None) -> tuple[bytes, list[tuple[int, int]]]:
    """Remaining bytes and maximal removed ranges."""
    runs: list[list[int]] = []
    for lo, n in sorted((x["lo"], x["len"]) for x in spans or ()):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], lo + n)
        else:
            runs.append([lo, lo + n])
    kept, at = [], 0
    for s, e in runs:
        kept.append(text[at:s])
        at = e
    return b"".join([*kept, text[at:]]), [tuple(r) for r in runs]


def text_id(body: Column) -> Column:
    """64 bits that stand for a text; texts that share them are told apart by ``second_id``."""
    return F.xxhash64(body, F.octet_length(body))


def second_id(body: Column) -> Column:
    return F.xxhash64(F.octet_length(body), F.lit(1), body)


def _told_apart(rows: DataFrame, tid: str, body: str) -> DataFrame:
    """``rows`` with another ``tid`` for texts whose 64 bits stand for several texts, by 64 bits more."""
    second = second_id(F.col(body))
    both = rows.select(F.col(tid).alias("clash"), second.alias("h")).groupBy("clash").agg(F.min("h").alias("x"), F.max("h").alias("y"))
    both = materialize(both.filter("x <> y").select("clash"), "sub-clashes")
    if both.isEmpty():
        return rows
    clash, own = fresh(rows, "_clash", "_own")
    met = rows.withColumn(own, second).join(both.withColumnRenamed("clash", clash), F.col(tid) == F.col(clash), "left")
    return met.withColumn(tid, F.when(F.col(clash).isNull(), F.col(tid)).otherwise(F.xxhash64(tid, own))).drop(clash, own)


def remove_repeats(docs: DataFrame, text: str = "text", with_bytes: bool = True) -> DataFrame:
    """``docs`` plus n_bytes, n_removed, n_spans, kept_sha256, and (with_bytes) kept_bytes and removed spans."""
    arrow_batches(docs.sparkSession)
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "removed"]
    docs = docs.select([c for c in docs.columns if c.lower() not in new])
    tid, body, lists = fresh(docs, "_tid", "_body", "_spans")
    rows = docs.withColumn(body, F.coalesce(F.col(text), F.lit(""))).withColumn(tid, text_id(F.col(body)))
    rows = _told_apart(rows, tid, body)
    spans = repeated_spans(rows.select(F.col(tid).alias("tid"), F.col(body).alias("text")))
    spans = spans.groupBy("tid").agg(F.collect_list(F.struct("lo", "len")).alias(lists))  # at most a text's own blocks
    keep = [c for c in docs.columns if with_bytes or c != text]
    joined = rows.join(spans, rows[tid] == spans["tid"], "left").select(*keep, body, lists)
    extra = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    extra += ", kept_bytes binary, removed array<struct<s:long,e:long>>" if with_bytes else ""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*keep).schema), extra])

    def run(batches):
        for b in batches:
            done = [(t, *_apply(t, x)) for t, x in zip(b.column(body).cast(pa.binary()).to_pylist(), b.column(lists).to_pylist(), strict=True)]
            out = [
                pa.array([len(t) for t, _, _ in done], pa.int64()), pa.array([len(t) - len(k) for t, k, _ in done], pa.int64()),
                pa.array([len(r) for _, _, r in done], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for _, k, _ in done], pa.string()),
            ]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                out += [pa.array([k for _, k, _ in done], pa.binary()), pa.array([[{"s": s, "e": e} for s, e in r] for _, _, r in done], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))]
                names += ["kept_bytes", "removed"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *out], names=[*keep, *names])

    return joined.mapInArrow(run, schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_bytes=False)
