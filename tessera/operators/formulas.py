"""Formulas in cells (sheet, r, c, v): SUM over a range, and arithmetic on references, also to other sheets.

A formula is computed in the first pass in which everything it refers to is known; at most PASSES
passes, fewer where nothing more gets known. Ranges are answered by running sums of a column, a sorted pass
a column and not a join of ranges; references by equal keys. Numbers are decimals, results are rounded
half up to two places. Blank and text cells add nothing to a sum and make arithmetic on them fail,
as a division by zero does: such formulas, and those of a cycle, stay without a value.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal, DecimalException

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import materialize

PASSES = 4
NUMBER = "decimal(30,6)"
RANGE = r"^=SUM\(\$?([A-Z]{1,3})\$?([0-9]+):\$?([A-Z]{1,3})\$?([0-9]+)\)$"
REFERENCE = r"(?:(?:'([^']+)'|([A-Za-z0-9_]+))!)?\$?([A-Z]{1,3})\$?([0-9]+)"


def column_number(letters: Column) -> Column:
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64))


def _arithmetic(text: str) -> Decimal:
    """Value of numbers with + - * / and parentheses."""
    at = 0

    def peek():
        return text[at] if at < len(text) else ""

    def factor():
        nonlocal at
        if peek() in "+-" and peek():
            sign, at = peek(), at + 1
            return factor() if sign == "+" else -factor()
        if peek() == "(":
            at += 1
            v = chain("+-", lambda: chain("*/", factor))
            if peek() != ")":
                raise ValueError(text)
            at += 1
            return v
        start = at
        while peek() and peek() in "0123456789.":
            at += 1
        return Decimal(text[start:at])

    def chain(signs, part):
        nonlocal at
        v = part()
        while peek() and peek() in signs:
            sign, at = peek(), at + 1
            w = part()
            v = v + w if sign == "+" else v - w if sign == "-" else v * w if sign == "*" else v / w
        return v

    v = chain("+-", lambda: chain("*/", factor))
    if at < len(text):
        raise ValueError(text)
    return v


def _computed(text: Column, refs: Column, values: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series, refs: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for t, names, found in zip(texts, refs, values, strict=True):
            known = dict(zip(names, found, strict=True))
            try:
                for name in sorted(known, key=len, reverse=True):
                    t = t.replace(name, f"({known[name]})")
                out.append(str(_arithmetic(t).quantize(Decimal("0.01"), ROUND_HALF_UP)))
            except (ValueError, DecimalException):
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(text, refs, values)


def _sums(state: DataFrame) -> DataFrame:
    """(sheet, r, c, new) of the pending ranges whose cells are all known."""
    part = lambda i: F.regexp_extract("f", RANGE, i)
    asked = state.filter(F.col("pending") & F.col("f").rlike(RANGE))
    a, b, x, y = column_number(part(1)), column_number(part(3)), part(2).cast("long"), part(4).cast("long")
    asked = asked.select("sheet", "r", "c", F.explode(F.sequence(F.least(a, b), F.greatest(a, b))).alias("column"), F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))
    ends = F.inline(F.array(F.struct((F.col("lo") - 1).alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("hi").alias("at"), F.lit(1).alias("sign"))))
    asks = asked.select("sheet", "column", F.col("r").alias("own_r"), F.col("c").alias("own_c"), ends).withColumns({"value": F.lit(0).cast(NUMBER), "wait": F.lit(0)})
    cells = state.join(asks.select("sheet", F.col("column").alias("c")).distinct(), ["sheet", "c"], "left_semi")
    none = F.lit(None).cast("long")
    cells = cells.select("sheet", F.col("c").alias("column"), none.alias("own_r"), none.cast("int").alias("own_c"), F.col("r").alias("at"), F.lit(0).alias("sign"), F.coalesce("value", F.lit(0).cast(NUMBER)).alias("value"), F.col("pending").cast("int").alias("wait"))
    to_here = Window.partitionBy("sheet", "column").orderBy("at", F.col("sign") != 0).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = cells.unionByName(asks).withColumns({"total": F.sum("value").over(to_here), "waits": F.sum("wait").over(to_here)}).filter("sign <> 0")
    per = both.groupBy("sheet", F.col("own_r").alias("r"), F.col("own_c").alias("c")).agg(F.sum(F.col("total") * F.col("sign")).alias("total"), F.sum(F.col("waits") * F.col("sign")).alias("waits"))
    return per.filter("waits = 0").select("sheet", "r", "c", F.round("total", 2).cast(NUMBER).alias("new"))


def _terms(state: DataFrame) -> DataFrame:
    """(sheet, r, c, new) of the pending arithmetic whose references are all known."""
    asked = state.filter(F.col("pending") & ~F.col("f").rlike(RANGE)).select("sheet", "r", "c", F.substring("f", 2, 1 << 20).alias("text"))
    groups = [F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(i)) for i in range(5)]
    refs = asked.select("sheet", "r", "c", F.inline(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("name", "quoted", "plain", "letters", "row"), strict=True)])))
    other = F.coalesce(F.nullif("quoted", F.lit("")), F.nullif("plain", F.lit("")), "sheet")
    refs = refs.select("sheet", "r", "c", "name", other.alias("s2"), F.col("row").cast("long").alias("r2"), column_number(F.col("letters")).alias("c2")).distinct()
    there = state.select(F.col("sheet").alias("s2"), F.col("r").alias("r2"), F.col("c").alias("c2"), "value", F.col("pending").cast("int").alias("wait"))
    met = refs.join(there, ["s2", "r2", "c2"], "left")
    per = met.groupBy("sheet", "r", "c").agg(
        F.collect_list(F.struct("name", F.col("value").cast("string").alias("value"))).alias("refs"), F.sum(F.coalesce("wait", F.lit(0))).alias("waits"), F.sum(F.col("value").isNull().cast("int")).alias("lacks")
    )
    rows = asked.join(per, ["sheet", "r", "c"], "left").filter("coalesce(waits, 0) = 0 and coalesce(lacks, 0) = 0")
    rows = rows.withColumn("refs", F.coalesce("refs", F.array().cast("array<struct<name:string,value:string>>")))
    new = _computed(F.col("text"), F.col("refs.name"), F.col("refs.value")).cast(NUMBER)
    return rows.select("sheet", "r", "c", new.alias("new")).filter("new is not null")


def recomputed(cells: DataFrame, passes: int = PASSES) -> DataFrame:
    """(sheet, r, c, v, value, step): numbers as they are (step 0), formulas with the pass that computed them, null where none did."""
    f = F.regexp_replace("v", " ", "")
    formula = F.coalesce(f.startswith("="), F.lit(False))
    state = cells.select("sheet", F.col("r").cast("long").alias("r"), F.col("c").cast("int").alias("c"), "v", F.expr(f"try_cast(trim(v) as {NUMBER})").alias("value"), F.when(formula, f).alias("f"), formula.alias("pending"))
    state = materialize(state.withColumn("step", F.when(F.col("value").isNotNull(), 0)), "formulas-0")
    for step in range(1, passes + 1):
        found = materialize(_sums(state).unionByName(_terms(state)), f"formulas-new{step}")
        if found.isEmpty():
            break
        # Only formulas that wait can have been found; all other cells stay as they are and where they are.
        met = state.filter("pending").join(found, ["sheet", "r", "c"], "left")
        hit = F.col("new").isNotNull()
        met = met.select("sheet", "r", "c", "v", F.coalesce("new", "value").alias("value"), "f", (~hit).alias("pending"), F.when(hit, step).otherwise(F.col("step")).alias("step"))
        state = materialize(state.filter("not pending").unionByName(met), f"formulas-{step}")
    return state.select("sheet", "r", "c", "v", "value", "step")
