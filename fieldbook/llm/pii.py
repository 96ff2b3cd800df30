"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only. Spark gives the matches of a pattern but not their places; the pieces that ``split`` leaves
between the same matches give them, since both walk the text alike. Every pattern is written so that no failed attempt is
repeated inside a run of characters: possessive repeats, and a start only where a run begins or the match before ended.
Places are summed within blocks of matches and then over the blocks, and context is read from pieces of the text, so time
grows with the text and not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns of the contract, in the form described above.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # words of capitals and digits that may belong to the number; ``_account`` finds where it ends
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{0,30}+(?![A-Za-z0-9])"
             r"(?:(?! [A-Z]{2}[0-9]{2}[A-Z0-9]{11}) [A-Z0-9]{1,30}+(?![A-Za-z0-9])){0,10}+"),
}
# A character that every match of the kind holds, and that many texts don't.
_MARK = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None}
BASE = ("email", "ip", "card", "phone")
ORDER = (*BASE, "card_short", "iban")
WORDS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reply)\b",
    "ip": r"(?i)\b(?:ip|ipv4|host|server|address|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|expir\w*)\b",
    "card_short": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|expir\w*)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|cell)\b",
    "iban": r"(?i)\b(?:iban|account|bank|bic|swift|transfer)\b",
}
CONTEXT = 40  # code points on either side
PIECE = 512  # code points of a piece of the text, from which context is read
BLOCK = 128  # matches whose places are summed together
ACCEPT = 0.7
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, also where the body uses it inside a loop."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(text: Column, pattern: str) -> Column:
    """Array of (start, value) of the pattern's matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.split(text, pattern, -1), found, lambda p, v: F.struct(F.length(p).alias("p"), v.alias("v")))
    none = F.array().cast("array<struct<start:int,value:string>>")

    def block(s, b):
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(F.slice(s, b * BLOCK + 1, BLOCK), start, lambda a, x: F.struct(
            (a["at"] + x["p"] + F.coalesce(F.length(x["v"]), F.lit(0))).alias("at"),
            F.when(x["v"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(
                (a["at"] + x["p"]).alias("start"), x["v"].alias("value"))))).alias("out")))

    def places(s):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda b: block(s, b))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<base:int,out:array<struct<start:int,value:string>>>>").alias("out"))
        summed = F.aggregate(blocks, start, lambda a, x: F.struct(
            (a["at"] + x["at"]).alias("at"),
            F.concat(a["out"], F.array(F.struct(a["at"].alias("base"), x["out"].alias("out")))).alias("out")))
        return F.flatten(F.transform(summed["out"], lambda c: F.transform(c["out"], lambda m: F.struct(
            (c["base"] + m["start"]).alias("start"), m["value"].alias("value")))))

    return _let(steps, places)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right Luhn checksum."""
    size = F.length(number)
    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda a, i: a + _luhn_step(
        F.substring(number, i, F.lit(1)).cast("int"), (size - i) % 2 == 1)) % 10 == 0


def _luhn_step(d: Column, doubled: Column) -> Column:
    return F.when(doubled, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)


def mod_97(value: Column) -> Column:
    """Whether an account number's check digits are right: the first four characters go last, letters count from ten."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def step(a, i):
        c = F.substring(turned, i, F.lit(1))
        letter = F.instr(F.lit(_LETTERS), c)
        return F.when(letter > 0, (a * 100 + letter + 9) % 97).otherwise((a * 10 + c.cast("int")) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _account(value: Column) -> Column:
    """The longest run of words from the start that is an account number by length and check digits, or null."""
    words = F.split(value, " ")
    ends = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(words, 1, k), " "))
    size = lambda v: F.length(F.replace(v, F.lit(" "), F.lit("")))
    return F.get(F.filter(ends, lambda v: F.when(size(v).between(15, 34), mod_97(v)).otherwise(False)), F.lit(0))


def _kinds(kind: str, value: Column) -> Column:
    """What a match of a pattern is after its validator: kind, and whether a checksum stands behind it; null fails."""
    n = F.length(digits(value))
    if kind == "email":
        return F.lit("email")
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
        small = lambda x: (F.length(x) <= 2) | ((F.length(x) == 3) & (x <= "255"))
        return F.when(F.forall(parts, small), F.lit("ip"))
    if kind == "card":
        good = F.when(n.between(13, 19), luhn(digits(value)))
        return F.when(good & (n >= 16), F.lit("card")).when(good, F.lit("card_short"))
    if kind == "phone":
        return F.when(n.between(8, 15), F.lit("phone"))
    return F.when(value.isNotNull(), F.lit("iban"))


_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _judged(kind: str, places: Column) -> Column:
    if kind == "iban":
        places = F.transform(places, lambda m: F.struct(m["start"].alias("start"), _account(m["value"]).alias("value")))
    judged = F.transform(places, lambda m: F.struct(
        _kinds(kind, m["value"]).alias("kind"), m["start"].alias("start"),
        (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value")))
    return F.filter(judged, lambda m: m["kind"].isNotNull())


def spans(text: Column) -> Column:
    """Array of (kind, start, end, value, score) of all accepted spans, by kind in ``ORDER``, then start.

    The score is 0.5 for the pattern, 0.2 more where a checksum confirms it (0.1 for short card numbers, which are
    otherwise too common), and 0.3 more with a context word within ``CONTEXT`` code points. Base kinds are always
    accepted once their validator holds; others from ``ACCEPT`` on.
    """
    found = []
    for kind, pattern in PATTERNS.items():
        mark = _MARK[kind]
        here = F.contains(text, F.lit(mark)) if mark else text.rlike("[0-9]{2}" if kind == "iban" else "[0-9]")
        if kind == "iban":
            here = text.rlike(r"[A-Z]{2}[0-9]{2}")
        places = F.when(here, _places(text, pattern))
        found.append(F.coalesce(_judged(kind, places), F.array().cast(_SPAN)))

    def near(m, pieces):
        def part(at, size):
            two = F.concat(F.get(pieces, F.floor(at / PIECE).cast("int")), F.coalesce(F.get(pieces, F.floor(at / PIECE).cast("int") + 1), F.lit("")))
            return F.coalesce(F.substring(two, at % PIECE + 1, size), F.lit(""))

        lo = F.greatest(m["start"] - CONTEXT, F.lit(0))
        around = F.concat(part(lo, m["start"] - lo), F.lit("\n"), part(m["end"], F.lit(CONTEXT)))
        hit = F.lit(False)
        for k, words in WORDS.items():
            hit = F.when(m["kind"] == k, around.rlike(words)).otherwise(hit)
        return hit

    checked = lambda m: F.when(m["kind"].isin("card", "iban"), 0.2).when(m["kind"] == "card_short", 0.1).otherwise(0.0)
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    scored = _let(F.concat(*found), lambda all_: _let(F.when(F.size(all_) > 0, cut), lambda pieces: F.transform(all_, lambda m: F.struct(
        *[m[c].alias(c) for c in ("kind", "start", "end", "value")],
        F.round(F.lit(0.5) + checked(m) + F.when(near(m, pieces), 0.3).otherwise(0.0), 2).alias("score")))))
    kept = F.filter(scored, lambda m: m["kind"].isin(*BASE) | (m["score"] >= ACCEPT))
    place = F.array(*[F.lit(k) for k in ORDER])
    ordered = F.sort_array(F.transform(kept, lambda m: F.struct(F.array_position(place, m["kind"]).alias("o"), m["start"].alias("s"),
                                                                m.alias("m"))))
    return F.transform(ordered, lambda x: x["m"])


def listed(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")


def find(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``, the spans of each whole text. Null and empty texts have none; other columns stay."""
    return docs.withColumn(out, spans(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def masked(docs: DataFrame, text_col: str = "text", pii_col: str = "pii", out: str = "masked") -> DataFrame:
    """Each span replaced by its kind in brackets; of spans that overlap, the one that starts first, the longer one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ordered = F.array_sort(F.transform(pii_col, lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("e"), m["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    walk = F.aggregate(ordered, start, lambda a, m: F.when(m["start"] < a["at"], a).otherwise(F.struct(
        (-m["e"]).alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, m["start"] - a["at"]),
                                        F.lit("["), m["kind"], F.lit("]")).alias("out"))))
    return docs.withColumn("__w", walk).withColumn(out, F.concat(
        F.col("__w.out"), F.substring(text, F.col("__w.at") + 1, F.length(text)))).drop("__w")
