"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Two lines are linked when they are within a few edits of each other (insert, delete, replace
a character): EDITS edits when both have at least LEAST[EDITS - 1] characters, one edit from
LEAST[0] on, none (equal lines only) below, for two edits turn any short word into any other.
With LEAST = (0, 0) every pair of lines within EDITS edits is linked.

Candidates. A line is split into EDITS + 1 segments, so an edit-similar line holds one of them
unchanged near its place. A line has the keys of its own segments (segment number and text)
and probes the keys of lines up to EDITS shorter at the few offsets that are possible; keys
that coincide for several lengths are probed once. One aggregation over all keys finds those
that several lines share; only their rows go on.

A key's lines are compared in two rounds, so its work stays linear where its lines are alike:
round 1 verifies each line against the key's smallest line and merges; round 2 joins only lines
of different components, on signatures of the parities of their character counts (an edit
flips at most two, so similar lines differ in at most 2 * EDITS bits) and of their counts of
adjacent pairs (at most four an edit). Keys with many lines are split by parts of the first
signature: of 2 * EDITS + 1 parts one is equal, so nothing is lost.

Verification is a banded bit-parallel edit distance: equal blocks at both ends are cut off; then
for every character of one line a mask tells which of the 2 * EDITS + 1 characters around its
place in the other one are equal, and one word for each number of edits holds the diagonals
that can be reached, updated by shifts, ands and ors.

Of each component the occurrence with the smallest (doc_id, text hash, line number) stays.

Defined results: null text has no lines; blank lines are never dropped; null doc_ids come first;
rows that repeat doc_id and text are one document; an empty table gives an empty result;
clashing names are replaced. Equal lines are told apart from others by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialize
from tessera.llm.near_dedup import _components

EDITS = 2
#: Characters from which lines may differ by 1, 2, ... edits; shorter ones are compared for equality.
LEAST = (8, 16)
#: Lines of a key beyond which it is split by signature parts.
HOT = 64
#: Equal ends are cut off in blocks of at least so many characters, of at most so many blocks.
CUT, CUTS = 32, 64


def _probes(residue: int) -> list[tuple[int, int, int, bool]]:
    """(segment, start - segment * q, length - q, own) of every key of a line of q * (EDITS + 1) + residue characters."""
    parts, many = EDITS + 1, 1000
    n, out = many * parts + residue, {}
    for shorter in range(EDITS + 1):
        short, longer = divmod(n - shorter, parts)
        for i in range(parts):
            start, length = short * i + max(0, i - (parts - longer)), short + (i >= parts - longer)
            for offset in range(max(-i, shorter - (EDITS - i)), min(i, shorter + EDITS - i) + 1):
                place = (i, start + offset - i * many, length - many)
                out[place] = out.get(place, False) or shorter == 0 and offset == 0
    return [(*place, own) for place, own in sorted(out.items())]


def _keys(lines: DataFrame, *keep: str) -> DataFrame:
    """``keep``, key, own: index keys of each line's segments (own), and keys of shorter lines that it probes."""
    row = lambda i, start, length, own: F.struct(F.lit(i).alias("i"), F.lit(start).alias("s"), F.lit(length).alias("l"), F.lit(own).alias("own"))
    tables = F.array(*[F.array(*[row(*p) for p in _probes(r)]) for r in range(EDITS + 1)])
    n = F.length("line")
    rows = lines.filter(n >= LEAST[0]).select(*keep, "line", n.alias("n"), F.explode(F.element_at(tables, n % (EDITS + 1) + 1)).alias("p"))
    q = F.floor(F.col("n") / (EDITS + 1))
    rows = rows.select(*keep, "line", "n", (q * F.col("p.i") + F.col("p.s")).cast("int").alias("start"), F.greatest(F.lit(0), q + F.col("p.l")).cast("int").alias("len"), "p.i", "p.own")
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n"))
    return rows.filter(fits).select(*keep, F.xxhash64("i", F.substring("line", F.col("start") + 1, F.col("len"))).alias("key"), "own")


def _parities(items: Column) -> Column:
    """64 parities of how often items occur; an item's bit is picked by hash."""
    one = F.lit(1).cast("long")
    flip = lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", one, F.pmod(F.xxhash64(x), F.lit(64)).cast("int")))
    return F.aggregate(items, F.lit(0).cast("long"), flip)


def _letters(line: Column) -> Column:
    return F.filter(F.split(line, ""), lambda c: c != "")


def _signatures(lines: DataFrame) -> DataFrame:
    """(id, n, sig, sig2): length, parities of characters, and of pairs of adjacent ones."""
    rows = lines.select("id", _letters(F.col("line")).alias("c"))
    pair = lambda i: F.concat(F.element_at("c", i), F.element_at("c", i + 1))
    pairs = F.when(F.size("c") > 1, F.transform(F.sequence(F.lit(1), F.size("c") - 1), pair)).otherwise(F.array().cast("array<string>"))
    return rows.select("id", F.size("c").alias("n"), _parities(F.col("c")).alias("sig"), _parities(pairs).alias("sig2"))


def _cut_front(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the equal blocks at the front of x and y cut off, and both reversed."""
    least = F.least(F.length("x"), F.length("y"))
    rows = pairs.withColumn("w", F.greatest(F.lit(CUT), F.ceil(least / CUTS)).cast("int"))
    rows = rows.withColumn("k", F.floor(least / F.col("w")).cast("int"))
    block = lambda c, i: F.substring(F.col(c), i * F.col("w") + 1, F.col("w"))
    same = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: block("x", i) == block("y", i))
    rows = rows.withColumn("p", F.when(F.col("k") > 0, F.array_position(same, F.lit(False))).otherwise(1).cast("int"))
    rest = F.when(F.col("p") > 0, F.col("p") - 1).otherwise(F.col("k")) * F.col("w") + 1
    return rows.withColumn("p", rest).withColumns({c: F.reverse(F.substring(F.col(c), F.col("p"), F.length(c))) for c in "xy"}).drop("w", "k", "p")


def within_edits(pairs: DataFrame) -> DataFrame:
    """Rows of ``pairs`` whose strings x and y are within ``most`` (at most EDITS) edits; other columns stay, x and y go."""
    near = pairs.filter(F.abs(F.length("x") - F.length("y")) <= F.col("most"))
    near = _cut_front(_cut_front(near)).withColumns({"x": _letters(F.col("x")), "y": _letters(F.col("y"))})
    # Diagonal d of 0..2 * EDITS: the reached prefix of y is d - EDITS longer than that of x.
    width, edge = 2 * EDITS + 1, F.array_repeat(F.lit(""), EDITS)
    near = near.withColumns({"nx": F.size("x"), "ny": F.size("y"), "y": F.concat(edge, F.col("y"), edge, edge, F.array(F.lit("")))})
    equal = lambda j, d: F.when(F.element_at("x", j) == F.element_at("y", j + d), 1 << d).otherwise(0)
    mask = lambda j: sum((equal(j, d) for d in range(1, width)), equal(j, 0))
    near = near.withColumn("masks", F.when(F.col("nx") > 0, F.transform(F.sequence(F.lit(1), F.col("nx")), mask)).otherwise(F.array().cast("array<int>")))
    all_ = (1 << width) - 1

    def step(state, m):
        new = [state["r0"].bitwiseAND(m)]
        for e in range(1, EDITS + 1):
            fewer = state[f"r{e - 1}"]
            moved = fewer.bitwiseOR(F.shiftright(fewer, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
            new.append(state[f"r{e}"].bitwiseAND(m).bitwiseOR(moved).bitwiseAND(F.lit(all_)))
        after = F.struct(*[c.alias(f"r{e}") for e, c in enumerate(new)])
        return F.when(state[f"r{EDITS}"] == 0, state).otherwise(after)  # no diagonal is left

    start = F.struct(*[F.lit(((1 << (e + 1)) - 1) << EDITS & all_).alias(f"r{e}") for e in range(EDITS + 1)])
    near = near.withColumn("r", F.aggregate("masks", start, step))
    reached = F.element_at(F.array(*[F.col(f"r.r{e}") for e in range(EDITS + 1)]), F.col("most") + 1)
    hit = F.call_function("shiftright", reached, (F.col("ny") - F.col("nx") + EDITS).cast("int")).bitwiseAND(F.lit(1)) == 1
    # Rows leave by a generator: a filter would be pushed down, with the steps above written into it over and over.
    return near.withColumn("r", F.explode(F.when(hit, F.array(F.lit(True))))).drop("x", "y", "nx", "ny", "masks", "r")


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``lines`` (id, line) that are linked."""
    x, y = lines.select(F.col("id").alias("a"), F.col("line").alias("x")), lines.select(F.col("id").alias("b"), F.col("line").alias("y"))
    short = F.least(F.length("x"), F.length("y"))
    most = sum((F.when(short >= n, 1).otherwise(0) for n in LEAST[1:EDITS]), F.when(short >= LEAST[0], 1).otherwise(0))
    return within_edits(pairs.join(x, "a").join(y, "b").withColumn("most", most)).select("a", "b")


def line_components(lines: DataFrame) -> DataFrame:
    """(k1, k2, c1, c2): class of each of ``lines`` (k1, k2, line; may repeat) that is linked with another one.

    k1 and k2 stand for the line. Candidates go by k1 alone; should two lines share it, the one
    with the smaller k2 is compared.
    """
    keys = _keys(lines, "k1")
    shared = keys.groupBy("key").agg(F.min(F.when(F.col("own"), F.col("k1"))).alias("a"), F.min("k1").alias("low"), F.max("k1").alias("high"))
    # Written first: a join straight from a shuffle lets Spark split a hot key.
    shared = materialize(shared.filter("a is not null and low < high").select("key", "a"), "line-keys")
    # Merge joins at every size, so that what moves grows with the input and with nothing else.
    rows = materialize(keys.join(shared.hint("merge"), "key").groupBy("key", F.col("k1").alias("id"), "a").agg(F.max("own").alias("own")), "line-shared")
    pairs = rows.filter("id <> a").select(F.least("id", "a").alias("a"), F.greatest("id", "a").alias("b")).distinct()
    pairs = materialize(pairs, "line-pairs")
    need = materialize(pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct(), "line-need")
    texts = lines.join(need.hint("merge"), "k1").groupBy(F.col("k1").alias("id")).agg(F.min(F.struct("k2", "line")).alias("m"))
    texts = materialize(texts.select("id", "m.k2", "m.line"), "line-texts")
    links = materialize(_verified(pairs, texts), "line-links")
    comps = _components(links, "line-comp")
    rows = rows.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    split = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).filter("low < high and n > 2").select("key", "n")
    rows = materialize(rows.join(split, "key").select("key", "id", "own", "comp", "n"), "line-mixed")
    if not rows.isEmpty():
        signed = materialize(_signatures(texts.join(rows.select("id").distinct(), "id", "left_semi")), "line-signatures")
        parts = 2 * EDITS + 1
        width = -(-64 // parts)
        cut = F.array(*[F.xxhash64("key", F.lit(i), F.shiftrightunsigned("sig", i * width).bitwiseAND(F.lit((1 << width) - 1))) for i in range(parts)])
        rows = rows.withColumnRenamed("n", "many").join(signed, "id").withColumn("key", F.explode(F.when(F.col("many") > HOT, cut).otherwise(F.array("key"))))
        x = rows.select("key", F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("sig").alias("sa"), F.col("sig2").alias("ta"), F.col("n").alias("na"))
        y = rows.filter("own").select("key", F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("sig").alias("sb"), F.col("sig2").alias("tb"), F.col("n").alias("nb"))
        alike = (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= 2 * EDITS) & (F.bit_count(F.col("ta").bitwiseXOR(F.col("tb"))) <= 4 * EDITS)
        more = x.join(y, (x["key"] == y["key"]) & (F.col("ca") != F.col("cb")) & (F.abs(F.col("na") - F.col("nb")) <= EDITS) & alike)
        more = materialize(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs2")
        found = materialize(_verified(more, texts), "line-links2")
        if not found.isEmpty():
            comps = _components(comps.toDF("a", "b").unionByName(found), "line-comp2")
    comps = comps.unionByName(comps.select(F.col("comp").alias("node"), "comp").distinct())  # a class's smallest node too
    full = texts.select("id", "k2")
    out = comps.join(full.toDF("node", "k2"), "node").join(full.toDF("comp", "c2"), "comp")
    return out.select(F.col("node").alias("k1"), "k2", F.col("comp").alias("c1"), "c2")


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` plus n_lines, n_dropped, dropped (0-based line numbers), kept_text."""
    new = ["n_lines", "n_dropped", "dropped", "kept_text"]
    docs = docs.select([c for c in docs.columns if c.lower() not in new])
    h, d, hh = fresh(docs, "_h", "_d", "_hh")
    body = F.col(text)
    keyed = docs.withColumn(h, F.xxhash64(F.coalesce(body, F.lit(""))))
    seen = keyed.select(F.col(id_col).alias("doc_id"), F.col(h).alias("h"), F.posexplode(F.split(F.coalesce(body, F.lit("")), "\n", -1)).alias("pos", "line"))
    size = F.octet_length("line")
    seen = seen.filter(F.trim("line") != "").withColumns({"k1": F.xxhash64("line", size), "k2": F.xxhash64(size, F.lit(1), "line")})
    comps = materialize(line_components(seen.select("k1", "k2", "line")), "line-classes")
    places = seen.select("k1", "k2", F.struct("doc_id", "h", "pos").alias("at"))
    first = places.groupBy("k1", "k2").agg(F.min("at").alias("keep"), F.count("*").alias("n")).join(comps.hint("merge"), ["k1", "k2"], "left")
    first = first.filter("n > 1 or c1 is not null").select("k1", "k2", "keep", F.coalesce("c1", "k1").alias("c1"), F.coalesce("c2", "k2").alias("c2"))
    first = materialize(first, "line-first")
    stays = first.groupBy("c1", "c2").agg(F.min("keep").alias("keep"))
    repeated = materialize(first.drop("keep").join(stays, ["c1", "c2"]).select("k1", "k2", "keep"), "line-repeated")
    dropped = places.join(repeated.hint("merge"), ["k1", "k2"]).filter(~F.col("at").eqNullSafe(F.col("keep"))).select("at.*")
    lists = dropped.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("pos")).alias("dropped")).withColumnsRenamed({"doc_id": d, "h": hh})
    out = keyed.join(lists.hint("merge"), keyed[id_col].eqNullSafe(F.col(d)) & (keyed[h] == F.col(hh)), "left")
    gone, all_, bounds = fresh(docs, "_gone", "_lines", "_bounds")
    out = out.select(*[keyed[c] for c in docs.columns], F.coalesce("dropped", F.array().cast("array<int>")).alias(gone))
    out = out.withColumn(all_, F.when(body.isNull(), F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1)))
    # Ranges of kept lines between dropped ones, so that no line is searched for in the list.
    out = out.withColumn(bounds, F.concat(F.array(F.lit(-1)), gone, F.array(F.size(all_))))
    place = lambda i: F.element_at(bounds, i)
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda i: F.slice(all_, place(i) + 2, place(i + 1) - place(i) - 1)))
    return out.select(
        *docs.columns, F.size(all_).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), F.col(gone).alias("dropped"),
        F.when(F.size(gone) > 0, F.array_join(kept, "\n")).otherwise(F.coalesce(body, F.lit(""))).alias("kept_text"),
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.array_join("dropped", ",").alias("dropped"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
