"""Texts of requests: units, price limits, sizes, amounts in words, and lists; small sheets."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import ingest
from tessera.operators import rules as R
from tessera.sources.catalogue import ALIASES_SQL, CELLS_SQL


def values(spark, f, *args):
    """f of each tuple of texts or numbers."""
    rows = [(i, *(a if isinstance(a, tuple) else (a,))) for i, a in enumerate(args)]
    df = spark.createDataFrame(rows, ["i", *[f"x{k}" for k in range(len(rows[0]) - 1)]])
    return [r["v"] for r in df.select("i", f(*[F.col(c) for c in df.columns[1:]]).alias("v")).orderBy("i").collect()]


def test_units(spark):
    got = values(spark, X.norm_units, "1 litre", "1.0 Ltr jug", "half size food pan", "Full Size Chafing Dish 9 Ltr", "double-walled bowl", "quarter lid", "quarter plate")
    assert got == ["1l", "1l jug", "1/2 food pan", "Full Size Chafing Dish 9l", "dw bowl", "1/4 lid", "quarter plate"]


def test_prices(spark):
    got = values(spark, lambda s: F.struct(*X.price_limits(s)), "cups under 1k", "cups >= 500", "between 1,000 and 2k urn", "cups 2000 to 200", "thunder 500", "200-2000", "over 10 and under ₹ 99.5 x", "plain")
    assert [tuple(x) for x in got] == [
        ("cups", None, 1000.0), ("cups", 500.0, None), ("urn", 1000.0, 2000.0), ("cups", 200.0, 2000.0), ("thunder 500", None, None), ("200-2000", None, None), ("and x", 10.0, 99.5), ("plain", None, None)
    ]


def test_sizes(spark):
    got = values(spark, lambda s: F.struct(*X.size_facts(s)), "1.50 litres", "12 lt", "2 ltrs", "30 cl", "5 oz", '9" x 25 cm', "300 x 200")
    assert [tuple(map(list, x)) for x in got] == [([1500], [], []), ([12000], [], []), ([2000], [], []), ([300], [], []), ([148], [], []), ([], [229, 250], []), ([], [], ["300x200"])]
    notes = values(spark, X.size_note, ("9 l", "7 ltr"), ("100 ml", "113 ml"), ("100 ml", "114 ml"), ("19 mm", "21 cm"), ("25 cm", "200 mm"), ("30 x 40", "40x30"), ("tray", "7 l"), ("500 ml", "1.5 l"))
    assert notes == ["client asked 9 L — this is 7 L", "", "client asked 100 ml — this is 114 ml", "", "client asked 25 cm — this is 20 cm", "client asked 30x40 — this is 40x30", "", "client asked 500 ml — this is 1.5 L"]


def test_amounts(spark):
    got = values(spark, R.amount_words, 0, 19, 110, 12_340_000_000, 10_00_00_000, 1_23_45_678, 25_00_00_000_00_00_000, -5)
    assert got == [
        "zero", "nineteen", "one hundred ten", "one thousand two hundred thirty four crore", "ten crore",
        "one crore twenty three lakh forty five thousand six hundred seventy eight", "twenty five crore crore", None,
    ]


LISTS = [
    ("100 soup bowl, 60 ice box and 25 pizza tray", [("soup bowl", 100), ("ice box", 60), ("pizza tray", 25)]), ("kettle 1000 qty", [("kettle", 1000)]), ("kettle x 50", [("kettle", 50)]), ("kettle /50 qty", [("kettle", 50)]),
    ("kettle qty 50", [("kettle", 50)]), ("1000 kettle", [("kettle", 1000)]), ("crate 300 x 200", [("crate 300x200", 1)]), ("crate 300 x 200 x 70\nbox 4", [("crate 300x200x70", 1), ("box", 4)]), ("ABC [X-1] 4", [("ABC [X-1]", 4)]),
    ('"MIRROR SHAKER with lid [WBS001-SS]  4"\nplain tray', [("MIRROR SHAKER with lid [WBS001-SS]", 4), ("plain tray", 1)]), ("69111000 100", [("69111000", 100)]), ("691110", [("691110", 1)]), ("set/4", [("set/4", 1)]),
    ("caddy for the bar [GC002] 2", [("caddy for the bar [GC002]", 2)]), ("we need 5 kettles", None), ("10 kettle, some trays", None), ("50 200", None), ("0 kettle, 5 tray", None), ("", None), (" \n ", None), (None, None),
    ("tray\nwe want more of them", None), ("x" * 91, None), (", ".join(f"{i} tray" for i in range(1, 32)), None), (", ".join(f"{i} tray" for i in range(1, 31)), [("tray", i) for i in range(1, 31)]), ("y" * 8001, None),
]


def test_lists(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LISTS)], "i int, t string").select("i", X.prompt_items(F.col("t")).alias("v")).orderBy("i")
    for r, (t, want) in zip(df.collect(), LISTS, strict=True):
        assert (None if r["v"] is None else [(x["product"], x["qty"]) for x in r["v"]]) == want, t


def test_limit_before_quantity(spark):
    (got,) = values(spark, X.prompt_items, "2 kettle under 1000")
    assert [tuple(x) for x in got] == [("kettle", 2, None, 1000.0)]
    (got,) = values(spark, X.prompt_items, "kettle under 1000\ntray above 5k 3 pcs")
    assert [tuple(x) for x in got] == [("kettle", 1, None, 1000.0), ("tray", 3, 5000.0, None)]


@pytest.fixture(scope="module")
def sheet(spark):
    return spark.sql(CELLS_SQL), spark.sql(ALIASES_SQL)


def test_small_sheets(spark, sheet):
    cells, aliases = sheet
    assert {tuple(r) for r in ingest.header_rows(cells, aliases).collect()} == {("S1", 6, 6), ("S2", 3, 3)}
    rows = {(r["sheet"], r["r"]): (r["product"], r["qty"], r["price"], r["gst"]) for r in ingest.sheet_rows(cells, aliases).collect()}
    assert rows[("S1", 7)] == ("Round Tray", 4.0, 318.0, 18.0) and rows[("S1", 8)] == ("Round Tray", 1.0, 90.0, 12.0) and ("S1", 9) not in rows and ("S1", 12) not in rows
    assert {r["sheet"]: r["kind"] for r in ingest.file_kind(cells).collect()} == {"S1": "requirement", "S2": "catalogue"}
