"""Scalar text, unit and number functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that name a unit, not a thing.
UNIT_WORDS = "inch inches cm mm mtr mtrs meter metre meters kg kgs ltr litre liter size set nos pcs pc".split()

#: Measures that are never taken for a typing error.
UNIT_SAFE = "liter liters litre litres ltr ltrs lt quart quarts qt qts gram grams gm gms oz comp inch inches dia diameter swg gauge".split()


def norm_phrase(s: Column) -> Column:
    """Lower case, signs to blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def norm_model(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def norm_header(s: Column) -> Column:
    return F.upper(F.trim(s))


def sig_words(s: Column) -> Column:
    """Distinct alphabetic words of three letters or more that are not units, in first-seen order."""
    words = F.regexp_extract_all(F.lower(s), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(UNIT_WORDS)))


def skeleton(w: Column) -> Column:
    """First letter and the later consonants."""
    return F.concat(F.substring(w, 1, 1), F.regexp_replace(F.substring(w, 2, 100), "[aeiou]", ""))


# Words of a fraction of a pan, and what makes a text speak of pans.
FRACTIONS = {"full": "1/1", "half": "1/2", "third": "1/3", "quarter": "1/4", "sixth": "1/6", "ninth": "1/9"}
PANS, NO_PANS = r"(?i)\b(pan|pans|lid|lids|colander|carrier)\b", r"(?i)\bchaff?ing\b"


def norm_units(s: Column) -> Column:
    """One spelling of a unit: litres as l, no .0 before it, fraction words of pans as n/m, and a few short forms."""
    s = F.regexp_replace(s, r"(?i)(\d+(?:\.\d+)?)\s*(litres?|liters?|ltrs?|lt)\b", "$1l")
    s = F.regexp_replace(s, r"(?i)(\d+)\.0\s*(l|ml|kw|w|v|hz|mm|cm|kg)\b", "$1$2")
    parts = s
    for word, part in FRACTIONS.items():
        parts = F.regexp_replace(parts, rf"(?i)\b{word}[\s-]+size\b", part)
    for word, part in list(FRACTIONS.items())[1:]:
        parts = F.regexp_replace(parts, rf"(?i)\b{word}\b", part)
    s = F.when(s.rlike(PANS) & ~s.rlike(NO_PANS), parts).otherwise(s)
    for pattern, short in ((r"\bdouble[\s-]*wall(?:ed)?\b", "dw"), (r"\bdozen\b", "dz"), (r"\bounces?\b", "oz")):
        s = F.regexp_replace(s, f"(?i){pattern}", short)
    return s


# A price in a request, and the words and signs of a limit.
PRICE = r"(?:rs\.?|inr|₹)?\s*(\d[\d,]*(?:\.\d+)?)\s*(k)?"
RANGES = (rf"\b(?:between|range|price)\s*{PRICE}\s*(?:and|to|-)\s*{PRICE}\b", rf"{PRICE}\s+(?:to|-)\s+{PRICE}\b")
AT_MOST = rf"(?:\b(?:under|below|less\s+th[ae]n|cheaper\s+than|up\s?to|within|max(?:imum)?|budget)\b|<=|<)\s*{PRICE}\b"
AT_LEAST = rf"(?:\b(?:above|over|more\s+than|greater\s+than|at\s+least|min(?:imum)?)\b|>=|>)\s*{PRICE}\b"


def price_limits(s: Column) -> tuple[Column, Column, Column]:
    """(text without it, lowest, highest price a piece) of a range, or of an upper and a lower limit; k is a thousand."""

    def part(pattern, group, t):
        return F.regexp_extract(t, f"(?i){pattern}", group)

    def number(pattern, group, t):
        x = F.nullif(F.regexp_replace(part(pattern, group, t), ",", ""), F.lit("")).cast("double")
        return x * F.when(part(pattern, group + 1, t) != "", 1000.0).otherwise(1.0)

    first, second = RANGES
    hit = F.when(part(first, 0, s) != "", part(first, 0, s)).otherwise(part(second, 0, s))
    a, b = (F.coalesce(number(first, g, s), number(second, g, s)) for g in (1, 3))
    without = lambda t, pattern: F.when(part(pattern, 0, t) != "", F.replace(t, part(pattern, 0, t), F.lit(" "))).otherwise(t)
    rest = without(s, AT_MOST)
    clean = F.when(hit != "", F.replace(s, hit, F.lit(" "))).otherwise(without(rest, AT_LEAST))
    low = F.when(hit != "", F.least(a, b)).otherwise(number(AT_LEAST, 1, rest))
    high = F.when(hit != "", F.greatest(a, b)).otherwise(number(AT_MOST, 1, s))
    return F.btrim(F.regexp_replace(clean, r"\s+", " "), F.lit(" ,.-")), low, high


# Millilitres of a unit, and how far two sizes of one thing may differ.
CAPACITY = {"l": 1000.0, "ltr": 1000.0, "ltrs": 1000.0, "litre": 1000.0, "litres": 1000.0, "liter": 1000.0, "liters": 1000.0, "lt": 1000.0, "ml": 1.0, "cl": 10.0, "oz": 29.57, "qt": 946.0}
CAPACITY_NEAR, LENGTH_NEAR = 0.12, 0.08
CAPACITIES = r"([0-9]+(?:\.[0-9]+)?)\s*(litres?|liters?|ltrs?|lt|ml|cl|oz|qt|l)\b"
LENGTHS = r"([0-9]+(?:\.[0-9]+)?)\s*(cm|mm)\b"
INCHES = "([0-9]+(?:\\.[0-9]+)?)\\s*(?:\"|''|inch(?:es)?\\b)"
AREAS = r"[0-9]{2,4}\s*[x*×]\s*[0-9]{2,4}"


def _measured(t: Column, pattern: str, factor) -> Column:
    values, units = (F.regexp_extract_all(t, F.lit(pattern), F.lit(g)) for g in (1, 2))
    return F.transform(F.arrays_zip(values.alias("v"), units.alias("u")), lambda x: F.bround(x["v"].cast("double") * factor(x["u"]), 0).cast("long"))


def size_facts(s: Column) -> tuple[Column, Column, Column]:
    """(capacities in ml, lengths in mm, inches among them, areas as NxN) that a text states, each sorted and distinct."""
    t = F.lower(s)
    ml = F.create_map(*[F.lit(x) for pair in CAPACITY.items() for x in pair])
    long = _measured(t, LENGTHS, lambda u: F.when(u == "cm", 10.0).otherwise(1.0))
    inch = F.transform(F.regexp_extract_all(t, F.lit(INCHES), F.lit(1)), lambda x: F.bround(x.cast("double") * 25.4, 0).cast("long"))
    tidy = lambda x: F.array_sort(F.array_distinct(x))
    return tidy(_measured(t, CAPACITIES, lambda u: ml[u])), tidy(F.concat(long, inch)), tidy(F.regexp_extract_all(F.replace(t, F.lit(" "), F.lit("")), F.lit(AREAS), F.lit(0)))


def _apart(a: Column, b: Column, near: float) -> Column:
    """Both state something, and no pair agrees within a share of the larger."""
    close = F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= F.greatest(x, y) * near))
    return (F.size(a) > 0) & (F.size(b) > 0) & ~close


def size_note(asked: Column, got: Column) -> Column:
    """'client asked 9 L — this is 7 L' where the sizes of two texts conflict, else empty.

    Lengths compare within edges (below 40 mm), dishes (to 400) and furniture only, the largest class first.
    """
    (qc, ql, qd), (gc, gl, gd) = size_facts(asked), size_facts(got)
    plain = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    litres = lambda x: F.when(x >= 1000, F.concat(plain(x / 1000), F.lit(" L"))).otherwise(F.concat(x.cast("string"), F.lit(" ml")))
    metric = lambda x: F.when(x >= 10, F.concat(plain(x / 10), F.lit(" cm"))).otherwise(F.concat(x.cast("string"), F.lit(" mm")))
    said = lambda a, b, how: F.concat(F.lit("client asked "), F.array_join(F.transform(a, how), " / "), F.lit(" — this is "), F.array_join(F.transform(b, how), " / "))
    note = F.when(_apart(qc, gc, CAPACITY_NEAR), said(qc, gc, litres))
    for low, high in ((401, 1 << 60), (40, 400), (0, 39)):
        a, b = (F.filter(x, lambda v: v.between(low, high)) for x in (ql, gl))  # noqa: B023
        note = note.when(_apart(a, b, LENGTH_NEAR), said(a, b, metric))
    other = (F.size(qd) > 0) & (F.size(gd) > 0) & ~F.arrays_overlap(qd, gd)
    return note.when(other, F.concat(F.lit("client asked "), qd[0], F.lit(" — this is "), gd[0])).otherwise("")


def gst_percent(v: Column) -> Column:
    """Fractions up to 1 are shares of one; missing is 18; zero stays zero."""
    return F.coalesce(F.when((v > 0) & (v <= 1), v * 100).otherwise(v), F.lit(18.0))


def deletions(w: Column) -> Column:
    """A word and all it becomes when one character is deleted: equal keys for words one edit or swap apart."""
    cut = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w))))
    return F.array_distinct(F.concat(F.array(w), cut))


def one_edit(a: Column, b: Column) -> Column:
    """Edit distance at most one, an adjacent swap counting as one edit."""
    swap = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2, F.length(a))) == b,
    )
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & swap)


def wrapped_lines(s: Column, width: int) -> Column:
    """Lines that a cell of ``width`` characters shows."""
    return F.aggregate(F.split(s, "\n"), F.lit(0), lambda n, x: n + F.greatest(F.lit(1), F.ceil(F.length(x) / width)).cast("int"))


# Words of prose, and the quantity at the end of a line or in front of a part.
PROSE = (
    r"(?i)\b(we|i|need|needs|needed|require|requires|required|want|wants|please|looking|setup|set up|for the|opening|room|hotel|kitchen|section|"
    r"department|also|plus|including|approx|around|about)\b"
)
LINE = (
    r"(?i)^(.{3,90}?)(?:[\s\-–/]+(?:qty|x|nos\.?|pcs\.?)[\s.:]*(\d{1,5})|[\s\-–/]+(\d{1,5})\s*(?:qty|nos\.?|pcs\.?|pieces?|units?)\.?|[\s\-–]+(\d{1,5}))?$"
)
PART = r"(?i)^(\d{1,6})\s*(?:x|nos\.?|pcs\.?|pieces?)?\s+(.{2,70})$"
PROMPT_MOST, LINE_MOST, PARTS_MOST = 8000, 90, 30


def prompt_items(s: Column) -> Column:
    """array<struct<product, qty, low, high>> of a list that is typed or pasted, or null where any part of it reads like prose.

    A code alone; lines with a quantity at the end (none: 1); or parts between commas with the quantity first. A price limit
    is taken off a line before its quantity is read.
    """
    whole = F.regexp_replace(F.btrim(s, F.lit(" \t\r\n\x0b\x0c")), r"(?i)(?<=\d\d)\s*[x×*]\s*(?=\d{2,4}\b)", "x")
    return F.transform(F.array(whole), _items)[0]


def _items(p: Column) -> Column:
    code = r"^(\d{6,8})(?:\s+(\d{1,5}))?$"
    number = lambda x: F.nullif(x, F.lit("")).cast("int")
    none = F.lit(None).cast("double")
    item = lambda product, qty, low, high: F.struct(product.alias("product"), F.coalesce(qty, F.lit(1)).alias("qty"), low.alias("low"), high.alias("high"))
    alone = F.array(item(F.regexp_extract(p, code, 1), number(F.regexp_extract(p, code, 2)), none, none))
    bracket = r"\[[^\]\[]+\]"
    stripped = lambda x: F.btrim(F.btrim(x, F.lit(" \t\r\n\x0b\x0c")), F.lit('"'))
    lines = F.filter(F.transform(F.split(p, r"\r\n|\n|\r"), stripped), lambda x: x != "")

    # Arrays of one bind what is used several times; as plain expressions it would be computed at each use.
    once = lambda x, f: F.transform(F.array(x), f)[0]

    def limits(x):
        """The text without its price limit, if it has one, and the limit."""
        clean, low, high = price_limits(x)
        y = once(F.struct(clean.alias("clean"), low.alias("low"), high.alias("high")), lambda y: F.struct(y["clean"].alias("clean"), y["low"].alias("low"), y["high"].alias("high"), (y["low"].isNotNull() | y["high"].isNotNull()).alias("any")))
        return y

    def opened(x):
        """A line as it is read: name, quantity, limit, and whether it is one of a list."""
        return once(limits(x), lambda y: once(F.when(y["any"], y["clean"]).otherwise(x), lambda t: once(F.regexp_extract(t, LINE, 1), lambda name: F.struct(
            name.alias("name"), F.coalesce(*[number(F.regexp_extract(t, LINE, g)) for g in (2, 3, 4)]).alias("qty"), y["low"].alias("low"), y["high"].alias("high"),
            ((F.length(x) <= LINE_MOST) & (~x.rlike(PROSE) | x.rlike(bracket)) & (name != "") & (name.rlike("[A-Za-z]") | F.trim(name).rlike(r"^\d{6,8}$"))).alias("good"),
        ))))

    def lined(y):
        return item(F.btrim(y["name"], F.lit(" .-/")), y["qty"], y["low"], y["high"])

    listed = lambda xs: (F.size(xs) == 1) & ~F.get(xs, F.lit(0)).rlike(bracket) & (F.get(xs, F.lit(0)).rlike(r"(?i),|;|\band\b") | F.get(xs, F.lit(0)).rlike(r"^\d"))
    pieces = F.filter(F.transform(F.split(p, r"(?i),|;|\band\b"), lambda x: F.btrim(x, F.lit(" \t\r\n\x0b\x0c"))), lambda x: x != "")
    part_ok = lambda x: (number(F.regexp_extract(x, PART, 1)) > 0) & F.btrim(F.regexp_extract(x, PART, 2), F.lit(" .")).rlike("[A-Za-z]")

    def pieced(x):
        part = F.regexp_extract(x, PART, 2)
        return once(limits(part), lambda y: item(F.when(y["any"], y["clean"]).otherwise(F.btrim(part, F.lit(" ."))), number(F.regexp_extract(x, PART, 1)), y["low"], y["high"]))

    fits = (p != "") & (F.length(p) <= PROMPT_MOST)
    typed = lambda xs: ~p.rlike(PROSE) & F.size(xs).between(1, PARTS_MOST) & F.forall(xs, lambda x: F.coalesce(part_ok(x), F.lit(False)))
    as_pieces = once(pieces, lambda xs: F.when(typed(xs), F.transform(xs, pieced)))
    read = lambda xs: F.when(~listed(xs), F.transform(xs, opened))
    as_lines = once(lines, lambda xs: once(read(xs), lambda ys: F.when((F.size(xs) > 0) & F.forall(ys, lambda y: y["good"]), F.transform(ys, lined))))
    return F.when(~fits, None).when(p.rlike(code), alone).otherwise(F.coalesce(as_lines, as_pieces))
