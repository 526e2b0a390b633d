"""Every corpus query on one very long word, runs of a million blanks and newlines, and prose of megabytes."""

import random
from collections import Counter

import pytest

from tessera.llm import registry
from tests.llm import data


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, r = str(tmp_path_factory.mktemp("long")), random.Random(1)
    word = "".join(r.choice("abcdefghijklmnop0123456789") for _ in range(1_000_000))
    texts = [word, " " * 1_000_000, "\n" * 1_000_000, data.prose(r, 300_000), "a" * 1_000_000, None, "", *(data.prose(r, 50) for _ in range(10))]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, len(rows)


@pytest.mark.parametrize("name", [q for q in registry.QUERIES if not q.startswith("op13_")])
def test_long(spark, folder, name):
    path, n = folder
    rows = registry.QUERIES[name](spark, path).collect()
    if name.startswith("op10_"):
        last = {}
        for x in rows:
            last[x["doc_id"]] = last.get(x["doc_id"], 0) + x["length"]
        assert len(last) == n and all(last[x["doc_id"]] == x["doc_tokens"] for x in rows)
    else:
        assert Counter(x["doc_id"] for x in rows) == Counter(range(n))
