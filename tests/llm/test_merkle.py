"""The manifest against plain recursion, against its SQL, and on edge cases."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle
from tests.llm import data


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def up(nodes):
    """Levels of a tree over ``nodes``, by plain lists."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def beside(levels, i):
    """(left siblings, right siblings) of node ``i``, by level."""
    out = []
    for level in levels[:-1]:
        first = i // 8 * 8
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 8])))
        i //= 8
    return out


def expected(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> multiset of results."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    groups = defaultdict(list)
    for r in rows:
        leaf = h("".join(map(field, r)))
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        text = r[4].translate(data.LOWER) if r[4] is not None else None
        groups[(r[2] is not None, (r[2] or "").encode())].append((r[0] is not None, r[0] or 0, leaf, r[0], h("".join(map(field, (*r[:4], text)))) if tampered else leaf))
    trees = {k: up([x[2] for x in sorted(v)]) for k, v in groups.items()}
    top = up([trees[k][-1][0] for k in sorted(trees)])
    out = Counter()
    for at, k in enumerate(sorted(groups)):
        for i, (*_, leaf, doc_id, other) in enumerate(sorted(groups[k])):
            path = beside(trees[k], i) + beside(top, at)
            cur = other
            for left, right in path:
                cur = h(left + cur + right)
            out[(doc_id, leaf, trees[k][-1][0], top[-1][0], h("".join(a + b for a, b in path)), cur, cur == top[-1][0])] += 1
    return out


def rows(n=300):
    base = [(i, s, [None, "en", "de", "fr", "ß", ""][(i or 0) % 6 if (i or 0) < 130 else 1], len(t) if t else None, t) for i, t, s, *_ in data.rows()]
    more = [(1000 + i, "s", "en", i, f"Text {i} É") for i in range(n)]
    return base + base[:5] + more + [(5000, None, f"l{k}", None, None) for k in range(12)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, Leaf string, pos int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("merkle"))
    spark.createDataFrame([(*r, "x", 1) for r in rows()], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("levels", [4, 1])
def test_manifest(spark, folder, levels, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**levels)  # with blocks of 8 leaves, trees have several layers of blocks
    got = Counter(tuple(r) for r in merkle.op11_merkle_manifest(spark, folder).collect())
    assert got == expected(rows())
    assert {x[-1] for x in got} == {True, False}


def test_sql(spark, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    order = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    got = con.sql(merkle.OP11_SQL).select(", ".join(order)).fetchall()
    want = expected(rows())
    assert Counter(got) == want


def test_one_group_and_none(spark):
    one = spark.createDataFrame([(7, None, "en", 3, "abc")], "doc_id long, source string, lang string, n_chars long, text string")
    r = merkle.merkle_proofs(merkle.merkle_blocks(one)).collect()[0]
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] == h("1:7-2:en1:33:abc") and r["verified"] and r["proof_sha256"] == h("")
    assert merkle.merkle_proofs(merkle.merkle_blocks(one.limit(0))).count() == 0


def test_other_fields(spark):
    """Any fields, group and order; an altered field shows only in the rows that hold it."""
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("g"), F.lit("v").alias("v"))
    blocks = merkle.merkle_blocks(df, fields=("k", "v"), group="g", order="k", altered={"v": F.lit("w")}, where=F.col("k") == 41)
    got = {r["doc_id"]: r["verified"] for r in merkle.merkle_proofs(blocks).collect()}
    assert [k for k, ok in got.items() if not ok] == [41] and len(got) == 100
