"""Recomputed cells against plain Python."""

import random
import re
from decimal import ROUND_HALF_UP, Decimal

from tessera.operators import formulas


def plain(cells, passes=4):
    """The same by dictionaries: (sheet, r, c) -> (value, step)."""
    num = lambda c: sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(c)))
    out, pending = {}, {}
    for k, v in cells.items():
        v = (v or "").replace(" ", "") if (v or "").lstrip().startswith("=") else v
        if v and v.startswith("="):
            pending[k] = v
        else:
            try:
                out[k] = (Decimal(v.strip()), 0)
            except Exception:
                out[k] = (None, None)
    for step in range(1, passes + 1):
        new = {}
        for (s, r, c), f in pending.items():
            m = re.match(formulas.RANGE, f)
            if m:
                a, b = sorted((num(m[1]), num(m[3])))
                x, y = sorted((int(m[2]), int(m[4])))
                keys = [k for k in cells if k[0] == s and x <= k[1] <= y and a <= k[2] <= b]
                if not any(k in pending for k in keys):
                    new[(s, r, c)] = sum((out[k][0] or Decimal(0) for k in keys), Decimal(0))
                continue
            ok, text = True, f[1:]
            for q in set(re.finditer(formulas.REFERENCE, text)):
                k = (q[1] or q[2] or s, int(q[4]), num(q[3]))
                ok &= k not in pending and k in out and out[k][0] is not None
            if ok:
                text = re.sub(formulas.REFERENCE, lambda q: f"Decimal('{out[(q[1] or q[2] or s, int(q[4]), num(q[3]))][0]}')", text)
                text = re.sub(r"(?<![\w'.])(\d+(?:\.\d+)?)(?![\w'.])", r"Decimal('\1')", text)
                try:
                    new[(s, r, c)] = eval(text)
                except Exception:
                    pass
        if not new:
            break
        for k, v in new.items():
            out[k] = (Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP), step)
            pending.pop(k)
    return {k: out.get(k, (None, None)) for k in cells}


def test_recomputed(spark):
    r = random.Random(7)
    cells = {}
    letters = "ABCDEF"
    for s in ("one", "two sheets"):
        for row in range(1, 16):
            for c in range(1, 7):
                ref = lambda: f"{r.choice(['', '$'])}{r.choice(letters)}{r.choice(['', '$'])}{r.randint(1, 17)}"
                kind = r.random()
                if kind < 0.55:
                    v = str(r.randint(-50, 50)) if r.random() < 0.8 else f"{r.uniform(0, 9):.3f}"
                elif kind < 0.62:
                    v = r.choice([None, "", "text", " 7 "])
                elif kind < 0.72:
                    v = f"=SUM({r.choice(letters)}{r.randint(1, 6)}:{r.choice(letters)}{r.randint(1, 6)})"
                elif kind < 0.76:
                    v = f"='{r.choice(['one', 'two sheets'])}'!{ref()} + 1"
                else:
                    v = "= " + r.choice(["{} * {}", "({} - {}) / 2", "{} + 3.5 * {}", "-{} + ({})", "{} / {}", "2*(1+{})-{}"]).format(ref(), ref())
                cells[(s, row, c)] = v
    cells |= {("x", 1, 1): "=B1", ("x", 1, 2): "=A1", ("x", 2, 1): "=1/0", ("x", 3, 1): "=2*(3", ("x", 4, 1): "=1+2", ("x", 4, 2): "=A4*A11", ("x", 11, 1): "4", ("x", 5, 1): "=SUM(A4:A4)", ("x", 5, 28): "=AB6+1", ("x", 6, 28): "1"}
    rows = spark.createDataFrame([(*k, v) for k, v in cells.items()], "sheet string, r long, c int, v string")
    got = {(x["sheet"], x["r"], x["c"]): (x["value"], x["step"]) for x in formulas.recomputed(rows).collect()}
    want = plain(cells)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all((v[0] is None) == (want[k][0] is None) and (v[0] is None or abs(v[0] - want[k][0]) < Decimal("0.0001")) for k, v in got.items())
    assert got[("x", 4, 2)] == (Decimal("12.000000"), 2) and got[("x", 1, 1)] == (None, None) and got[("x", 5, 28)][0] == 2
    assert max(v[1] or 0 for v in got.values()) >= 2
    assert formulas.recomputed(rows.limit(0)).count() == 0
