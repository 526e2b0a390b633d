"""Packing documents into sequences along a Hilbert curve.

The words of a document are hashed into a signed vector, projected to three dimensions, and
the quantised point gives a Hilbert index; a hash of id and text follows it, so that copies,
which share one point, can be split too. Bytes are summed first; they give the number of
ranges, about PARTITION_BYTES each. The keys of a sample (chosen by hash with a chance in
proportion to bytes, about SAMPLE documents a range) give the bounds of the ranges, and texts
go to their range, one range a task, sorted by key. There they are tokenised and packed as a stream: documents are cut at
sequence ends, so each range leaves one partial sequence and all others are full. Neither
partitions nor order of the input nor Spark's settings change the layout.

Defined results: null or empty text is the single id 0; ties on the curve are ordered
by doc_id (nulls first), then text hash; repeated rows are packed as often as they occur;
any length of text is cut into as many pieces as needed; an empty table gives no piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, arrow_batches, by_value, prefix_hash, slices, span_hash, word_spans

by_value(__name__)

SEQUENCE = 1024
END_ID = 0
ADDED = {"<|endoftext|>": 50256}
#: White-space signs in a row from which a text is left to the slower library.
LONG_RUN = 100_000
DIMS, BITS, WIDTH = 3, 10, 64
#: Bytes of text in a range; beyond RANGES ranges they grow instead, so that the bounds stay small.
PARTITION_BYTES = 16 << 20
RANGES = 1 << 16
#: Sampled documents a range; only their keys and sizes reach the driver (16 MB for RANGES ranges).
SAMPLE = 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points [n, dims] with ``bits`` bits a coordinate (Skilling's transposition)."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


def curve_keys(column: pa.Array) -> np.ndarray:
    """Hilbert index of each text's projected hashed word vector."""
    project = np.random.default_rng(7).standard_normal((WIDTH, DIMS)) / np.sqrt(WIDTH)
    out = [np.zeros(0, np.int64)]
    for _, data, offsets in slices(column):
        starts, ends, bound = word_spans(data, offsets)
        h = span_hash(prefix_hash(data), starts, ends)
        rows = len(offsets) - 1
        doc = np.repeat(np.arange(rows), np.diff(bound))
        slot = (h & U64(WIDTH - 1)).astype(np.int64)
        sign = 1.0 - 2.0 * ((h >> U64(40)) & U64(1)).astype(np.float64)
        v = np.bincount(doc * WIDTH + slot, weights=sign, minlength=rows * WIDTH).reshape(rows, WIDTH).astype(np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        cell = np.clip(((v @ project) + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
        out.append(hilbert_index(cell.astype(np.int64)))
    return np.concatenate(out)


def _bounds(sample: list[tuple[int, int]], parts: int) -> np.ndarray:
    """Keys at which ranges of about equal bytes start (not the first range)."""
    if not sample:
        return np.zeros(0, np.int64)
    key, size = (np.array(x, np.int64) for x in zip(*sorted(sample), strict=True))
    before = np.cumsum(size) - size
    cut = np.searchsorted(before, np.arange(1, parts) * (size.sum() / parts))
    return np.unique(key[np.minimum(cut, len(key) - 1)])


def pack(docs: DataFrame, text: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, partition_bytes: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    arrow_batches(docs.sparkSession)
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text].alias("text"))
    slim = slim.withColumns({"bytes": F.coalesce(F.octet_length("text"), F.lit(0)) + 1, "h": F.xxhash64("doc_id", "text")})
    total = slim.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = max(1, -(-total // max(partition_bytes or PARTITION_BYTES, -(-total // RANGES))))

    def located(batches):
        for b in batches:
            own = b.column("h").to_numpy(zero_copy_only=False) & ((1 << 32) - 1)
            key = pa.array(curve_keys(b.column("text")) << 32 | own)
            part = pa.array(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int32))
            yield pa.RecordBatch.from_arrays([part, key, *b.columns], names=["part", "key", *b.schema.names])

    schema = "part int, key long, doc_id long, text string, bytes int, h long"
    bounds = np.zeros(0, np.int64)
    if parts > 1:
        # A document of `step` bytes or more is always picked and stands for itself, a shorter one for `step` bytes.
        step = max(1, total // (SAMPLE * parts))
        picked = slim.filter(F.pmod(F.xxhash64("h"), F.lit(step)) < F.col("bytes")).withColumn("bytes", F.greatest("bytes", F.lit(min(step, (1 << 31) - 1))))
        bounds = _bounds([(r[0], r[1]) for r in picked.mapInArrow(located, schema).select("key", "bytes").collect()], parts)
    placed = slim.mapInArrow(located, schema).select("part", "key", "doc_id", "h", "text")
    placed = placed.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "key", "doc_id", "h", "text")
    return placed.select("part", "doc_id", "text").mapInArrow(_packer(tokenizer), PIECES)


def _packer(tokenizer: str | None):
    def run(batches):
        encode = _encoder(tokenizer)
        part, sequence, offset = None, 0, 0
        for b in batches:
            out = [[] for _ in range(7)]
            for p, doc, body in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if p != part:
                    part, sequence, offset = p, p << 32, 0
                ids = np.append(encode(body), np.uint32(END_ID)).astype("<u4") if body else np.array([END_ID], "<u4")
                n, at = len(ids), 0
                while at < n:
                    take = min(n - at, SEQUENCE - offset)
                    for column, x in zip(out, (doc, at, take, zlib.crc32(ids[at : at + take].tobytes()), n, sequence, offset), strict=True):
                        column.append(x)
                    at, offset = at + take, offset + take
                    if offset == SEQUENCE:
                        sequence, offset = sequence + 1, 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            )

    return run


def _encoder(tokenizer: str | None):
    """text -> the ids that `tokenizers` gives with byte_bpe_50k.json.

    Mostly by the same vocabulary, split pattern and added token in the form of ranks, which takes under a
    third of the time. The pattern looks at characters by class only, and a test compares both
    libraries on every code point. Its engine has no room for about a million blanks in a row, so a text
    with LONG_RUN of them, or one that it refuses, goes through `tokenizers` itself.
    """
    import base64
    import re
    from functools import cache

    import public_tokenizers
    import tiktoken

    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
    long_run = re.compile(rf"\s{{{LONG_RUN}}}")

    @cache
    def whole():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def encode(s: str) -> np.ndarray:
        if len(s) < LONG_RUN or not long_run.search(s):
            try:
                return np.array(coder.encode(s, allowed_special="all"), dtype=np.uint32)
            except ValueError:  # the engine's stack
                pass
        return np.array(whole().encode(s, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
