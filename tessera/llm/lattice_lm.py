"""Language-model scores from a subword lattice over an existing piece vocabulary.

A text is lower-cased (A-Z), cut into words, and ends with one end token. The pieces of
an existing vocabulary weigh every segmentation of a word, and a word that occurs on the
training side has one more edge, the whole word. A forward recursion in log space sums over
all segmentations; pieces never cross words, so the document's log probability is the sum
over its words plus the end. Each distinct word is evaluated once.

The vocabulary on hand carries merge ranks, not probabilities, so the unigram probabilities
of its pieces are learned from the training side: counts of one segmentation to begin with,
then ROUNDS rounds of expected counts over all segmentations (forward-backward on distinct
words). A distinct word weighs 1 / its count there, for the pieces are to spell new words, and
rare words are most like those. The whole-word edge takes count / words of the mass that is left by the share of
words that occur once, which is what new words have had so far.

Plan. Rows are dealt into blocks of a file, by rows and, for long texts, fewer rows (TIERS), so
that a block's bytes are bounded. Each block sends its distinct words once; counts are summed
by word, the lattice is evaluated on distinct words, and one join returns to every block the
counts and likelihoods of its own words; then texts meet their block's small dictionary.
Everything that moves is proportional to the input; only piece counts (the size of the
vocabulary) and a few totals reach the driver.

Defined results: null text is empty: one end token; null ids count as training side
(crc32 of the empty text); repeated rows count as often as they occur; a word of more than
SEGMENT bytes is the product of its parts of SEGMENT bytes (no piece crosses a cut); characters outside
the vocabulary use its byte pieces; an empty table gives an empty result; without training
rows all counts are 0, and pieces are uniform; clashing column names do not matter, for
only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, arrow_batches, by_value, materialize, prefix_hash, slices, span_hash, word_spans
from tessera.llm.quality import fold

by_value(__name__)

#: Longest text (bytes) and rows of a block, from short texts to long ones.
TIERS = ((1 << 16, 4096), (1 << 20, 64), (1 << 62, 1))
#: Bytes of a word after which no piece goes on, so that the recursion works on parts of a very long word side by side.
SEGMENT = 4096
#: Rounds of expected piece counts.
ROUNDS = 2
SMOOTH = 0.1
MARK = "▁".encode()
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _vocabulary(path: str | None):
    """(processor, pieces as bytes by id; None for control symbols)."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            pieces.append(bytes([int(sp.id_to_piece(i)[3:-1], 16)]))
        else:
            pieces.append(None if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).encode())
    return sp, pieces


class Lattice:
    """Log10 probabilities of pieces, by length and hash."""

    def __init__(self, pieces: list[bytes | None], counts: dict[int, float]):
        live = [i for i, p in enumerate(pieces) if p]
        total = sum(counts.get(i, 0) for i in live) + SMOOTH * len(live)
        by: dict[int, dict[bytes, list]] = {}
        for i in live:  # a byte piece may spell the same bytes as a character piece: their mass adds up
            entry = by.setdefault(len(pieces[i]), {}).setdefault(pieces[i], [0.0, i])
            entry[0] += (counts.get(i, 0) + SMOOTH) / total
        self.size, self.tables = len(pieces), []
        for n, group in sorted(by.items()):
            data = np.frombuffer(b"".join(group), np.uint8)
            at = np.arange(len(group)) * n
            h = span_hash(prefix_hash(data), at, at + n)
            order = np.argsort(h)
            mass, ids = (np.array(x) for x in zip(*group.values(), strict=True))
            self.tables.append((n, h[order], np.log(mass)[order], ids[order]))

    def words(self, words: list[bytes]) -> np.ndarray:
        """Log10 of the sum over all segmentations of each word, its mark in front."""
        cut, owner = self._segments(words)
        out = np.zeros(len(cut))
        for part in self._parts(cut):
            out[part] = self._forward([cut[i] for i in part])[0]
        return np.bincount(owner, weights=out, minlength=len(words)) / np.log(10)

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece over all segmentations of words that weigh ``counts``."""
        words, owner = self._segments(words)
        counts = counts[owner]
        out = np.zeros(self.size)
        for part in self._parts(words):
            total, alpha, ends, levels = self._forward([words[i] for i in part])
            beta = np.full(len(alpha), -np.inf)
            beta[ends] = 0.0
            for start, end, p, ids, word in reversed(levels):  # a start occurs once in a level
                after = p + beta[end]
                beta[start] = np.logaddexp(beta[start], after)
                share = np.exp(alpha[start] + after - total[word]) * counts[part][word]
                out += np.bincount(ids, weights=share, minlength=self.size)
        return out

    @staticmethod
    def _segments(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Marked words, cut every SEGMENT bytes, and the word that each part comes from."""
        marked = [MARK + w for w in words]
        parts = [(w[s : s + SEGMENT], i) for i, w in enumerate(marked) for s in range(0, len(w), SEGMENT)]
        return [p for p, _ in parts], np.array([i for _, i in parts], np.int64)

    @staticmethod
    def _parts(words: list[bytes]):
        order = np.argsort([len(w) for w in words], kind="stable")
        return [x for x in np.array_split(order, max(1, -(-sum(map(len, words)) // 200_000))) if len(x)]

    def _forward(self, words: list[bytes]):
        """Log likelihoods, states' log sums, each word's last state, and edges by their end's place: (start, end, log, piece, word)."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words])
        first = np.cumsum(size) - size
        h = prefix_hash(data)
        start_of = np.repeat(first, size)
        ends = np.arange(1, len(data) + 1)
        edges = []
        for n, keys, logs, ids in self.tables:
            e = ends[ends - n >= start_of]
            if not len(e):
                continue
            got = span_hash(h, e - n, e)
            k = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
            hit = keys[k] == got
            edges.append((e[hit], np.full(hit.sum(), n), logs[k[hit]], ids[k[hit]]))
        e, n, p, ids = (np.concatenate(x) for x in zip(*edges, strict=True))
        # Positions: the state before byte i of word w is i + w, so that words do not share states.
        word = np.repeat(np.arange(len(words)), size)[e - 1]
        depth = e - first[word]
        order = np.lexsort((e, depth))
        e, n, p, ids, word, depth = e[order], n[order], p[order], ids[order], word[order], depth[order]
        alpha = np.full(len(data) + len(words), -np.inf)
        alpha[first + np.arange(len(words))] = 0.0
        bound = np.append(np.flatnonzero(np.diff(depth, prepend=-1)), len(depth))
        levels = []
        for i in range(len(bound) - 1):
            s = slice(bound[i], bound[i + 1])
            levels.append((e[s] - n[s] + word[s], e[s] + word[s], p[s], ids[s], word[s]))
            v = alpha[levels[-1][0]] + p[s]
            at = np.flatnonzero(np.diff(e[s], prepend=-1))
            top = np.maximum.reduceat(v, at)
            sums = np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.append(at, len(v))))), at)
            alpha[levels[-1][1][at]] = top + np.log(sums)
        last = first + size + np.arange(len(words))
        return alpha[last], alpha, last, levels


def _by_block(batches):
    """(block, its rows as a list of batches) for rows of the same block, which follow each other within a tier."""
    held: dict[int, tuple[int, list]] = {}
    for b in batches:
        tiers = b.column("tier").to_numpy(zero_copy_only=False)
        for t in np.unique(tiers).tolist():
            own = b.filter(pa.array(tiers == t))
            key = own.column("block").to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if t in held and key[i] != held[t][0]:
                    yield held.pop(t)
                held.setdefault(t, (key[i], []))[1].append(own.slice(i, j - i))
    yield from held.values()


def _block_words(batches):
    """Distinct words of each block and their counts on the training side."""
    for block, parts in _by_block(batches):
        keys, trained, words = [], [], []
        for b in parts:
            train = b.column("train").to_numpy(zero_copy_only=False)
            for first, data, offsets in slices(b.column("text")):
                data = LOWER[data]
                starts, ends, bound = word_spans(data, offsets)
                if not len(starts):
                    continue
                h = span_hash(prefix_hash(data), starts, ends)
                w = np.repeat(train[first : first + len(offsets) - 1], np.diff(bound)).astype(np.int64)
                u, at, inv = np.unique(h, return_index=True, return_inverse=True)
                keys.append(u), trained.append(np.bincount(inv, weights=w, minlength=len(u)).astype(np.int64))
                raw = data.tobytes()
                words.append(np.array([raw[s:e] for s, e in zip(starts[at], ends[at], strict=True)], dtype=object))
        if keys:
            k, w, t = np.concatenate(keys), np.concatenate(words), np.concatenate(trained)
            u, at, inv = np.unique(k, return_index=True, return_inverse=True)
            n = np.bincount(inv, weights=t).astype(np.int64)
            for i in range(0, len(u), 100_000):
                text = pa.array(w[at[i : i + 100_000]].tolist(), pa.binary())
                rows = len(text)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, block)), text, pa.array(n[i : i + rows])], names=["block", "word", "n"])


def lattice_scores(docs: DataFrame, text: str = "text", id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row for each row of ``docs``.

    ``docs`` that is not read straight from Parquet files is written to the scratch folder first.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    try:
        located = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text].alias("text"), "_metadata.file_path", "_metadata.row_index")
    except Exception as e:  # no file source: its rows have no place
        if "_metadata" not in str(e):
            raise
        docs = materialize(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text].alias("text")), "lm-docs")
        located = docs.select("doc_id", "text", "_metadata.file_path", "_metadata.row_index")
    train = fold(F.col("doc_id"), 10) != 0
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    tier = sum((F.when(size > most, 1).otherwise(0) for most, _ in TIERS[1:]), F.when(size > TIERS[0][0], 1).otherwise(0))
    per = F.element_at(F.array(*[F.lit(n) for _, n in TIERS]), F.col("tier") + 1)
    located = located.withColumn("tier", tier)
    block = F.xxhash64("file_path", "tier", F.floor(F.col("row_index") / per))
    rows = located.select(block.alias("block"), "tier", "doc_id", "text", train.alias("train"))
    pairs = materialize(rows.select("block", "tier", "text", "train").mapInArrow(_block_words, "block long, word binary, n long"), "lm-pairs")
    words = materialize(pairs.groupBy("word").agg(F.sum("n").alias("c")), "lm-words")

    def piece_counts(batches):
        sp, pieces = _vocabulary(vocabulary)
        total = np.zeros(len(pieces))
        for b in batches:
            c = b.column("c").to_numpy()
            got = sp.encode([x.decode("utf-8", "replace") for x in b.column("word").to_pylist()], num_threads=1)
            flat = np.fromiter((i for g in got for i in g), np.int64)
            total += np.bincount(flat, weights=np.repeat(1 / c, [len(g) for g in got]), minlength=len(pieces))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

    used = words.filter("c > 0").mapInArrow(piece_counts, "piece long, n double").groupBy("piece").agg(F.sum("n")).collect()
    counts = {int(i): round(float(n), 6) for i, n in used}  # sums of tasks come in any order
    ends = located.agg(F.count(F.when(train, 1))).first()[0]
    kinds, tokens, once = words.filter("c > 0").agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") == 1, 1))).first()
    n_all, n_kinds = int(tokens) + int(ends), int(kinds) + (ends > 0)
    floor_ = n_all + SMOOTH * (n_kinds + 1)

    def expected(now):
        def run(batches):
            lattice, total = Lattice(_vocabulary(vocabulary)[1], now), 0.0
            for b in batches:
                total = total + lattice.expected(b.column("word").to_pylist(), 1 / b.column("c").to_numpy())
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.atleast_1d(total)[at])], names=["piece", "n"])

        return run

    for _ in range(ROUNDS if counts else 0):
        used = words.filter("c > 0").mapInArrow(expected(counts), "piece long, n double").groupBy("piece").agg(F.sum("n")).collect()
        counts = {int(i): round(float(n), 6) for i, n in used}
    # Words that occur once tell how much mass is left for new ones.
    new = (int(once) + 1) / (int(tokens) + 1)
    more = (int(tokens) + SMOOTH) / (n_all + 2 * SMOOTH)

    def evaluate(batches):
        lattice = Lattice(_vocabulary(vocabulary)[1], counts)
        for b in batches:
            w = b.column("word").to_pylist()
            size = np.array([len(x) for x in w], np.int64)
            at = np.cumsum(size) - size
            h = span_hash(prefix_hash(np.frombuffer(b"".join(w), np.uint8)), at, at + size)
            c = b.column("c").to_numpy()
            whole = np.full(len(c), -np.inf)
            whole[c > 0] = np.log((1 - new) * c[c > 0] / int(tokens)) if new < 1 else -np.inf
            lp = np.logaddexp(np.log(new) + np.log(10) * lattice.words(w), whole) / np.log(10)
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(h.view(np.int64)), b.column("c"), pa.array(lp + np.log10(more))], names=["word", "h", "c", "lp"])

    valued = words.mapInArrow(evaluate, "word binary, h long, c long, lp double")
    dictionary = pairs.select("block", "word").join(valued, "word").select("block", "h", "c", "lp")
    end_lp = float(np.log10((int(ends) + SMOOTH) / (n_all + 2 * SMOOTH)))
    end_base = float(np.log10((ends + SMOOTH) / floor_))

    def score(texts: pa.Table, entries: pa.Table) -> pa.Table:
        h = entries.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, c, lp = h[order], entries.column("c").to_numpy()[order], entries.column("lp").to_numpy()[order]
        base = np.log10((c + SMOOTH) / floor_)
        n = texts.num_rows
        tokens, known, b_sum, l_sum = np.ones(n, np.int64), np.full(n, int(ends > 0)), np.full(n, end_base), np.full(n, end_lp)
        for first, data, offsets in slices(texts.column("text")):
            data = LOWER[data]
            starts, stops, bound = word_spans(data, offsets)
            k = np.searchsorted(h, span_hash(prefix_hash(data), starts, stops))
            rows_, m = np.repeat(np.arange(len(offsets) - 1), np.diff(bound)), len(offsets) - 1
            at = slice(first, first + m)
            tokens[at] += np.diff(bound)
            known[at] += np.bincount(rows_, weights=c[k] > 0, minlength=m).astype(np.int64)
            b_sum[at] += np.bincount(rows_, weights=base[k], minlength=m)
            l_sum[at] += np.bincount(rows_, weights=lp[k], minlength=m)
        held = pa.compute.invert(texts.column("train"))
        return pa.table([texts.column("doc_id"), held, tokens, known, b_sum, l_sum], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = rows.groupBy("block").cogroup(dictionary.groupBy("block")).applyInArrow(score, OUT)
    return out.withColumn("train_tokens", F.lit(n_all).cast("long"))


def op9_lattice_lm(spark, sf_dir: str) -> DataFrame:
    scores = lattice_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
