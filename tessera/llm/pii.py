"""Personal data: regular expressions propose, checksums confirm, context words adjust the score.

The base kinds (email, ip, card, phone) are leftmost, non-overlapping matches per kind; a match that fails its
check is dropped without a retry. Three kinds are added, which the score decides about: a pattern gives FOUND, a check what CHECKED says, a context word
near it NEAR, and a span stays from KEEP on. So IBANs (length by country, mod-97; each head is tried, whatever stands before or
after) need no context, social security numbers need it, and secrets (keys and tokens) need a known form or many different
characters and context. The score of every span is returned, the base kinds' too, whatever it is.
All of it is built-in functions: the pieces between matches and the matches themselves give the offsets and the context.
The patterns below equal the plain ones of the base kinds, but are possessive and start at the head of a
run of their characters, so that long unbroken runs cost linear time and no recursion.

Defined cases: null text is empty and has no spans; equal starts go by kind as listed; repeated rows give equal
rows; texts of any length are read whole; offsets are code points, end exclusive; an empty table gives an empty result;
other columns pass through, but one named like the column that `detect` adds is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, text_or_empty

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9]{4})",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
#: Length of an IBAN by country; in the text it may be parted by a space after each four characters.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: A text without a match of this has no span of the kind; far cheaper than the pattern itself.
GUARDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-", "secret": None}
CONTEXT = {
    "email": "mail|contact|write|correo|courriel",
    "ip": "server|host|address|login|ip",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|cell",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security|tax id|taxpayer",
    "secret": "token|secret|api|key|passw|pwd|auth|bearer|credential|clave|geheim|schlüssel|jeton",
}
#: Scores: by the pattern, added by a context word within REACH code points before or half as many after; what stays.
FOUND, NEAR, KEEP, REACH = 0.5, 0.35, 0.75, 40
#: Added by the check of a kind.
CHECKED = {"email": 0.4, "ip": 0.4, "card": 0.4, "phone": 0.4, "iban": 0.4, "ssn": 0.0, "secret": 0.2}
#: Forms of keys and tokens that need no context; they add what a checksum does. A secret has so many different characters.
KNOWN_SECRET, DIFFERENT = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk_(?:live|test)_[A-Za-z0-9]{16,}$", 10
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    flat = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(flat, 5, 60), F.substring(flat, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        value = F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return ((acc * F.when(letter, 100).otherwise(10) + value) % 97).cast("int")

    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step) == 1


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
    "card": lambda m: F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
    "iban": lambda m: F.length(F.regexp_replace(m, " ", "")).between(15, 34) & _mod97(m),
    "ssn": lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
    "secret": lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(F.substring(m, 1, 128), ""))) >= DIFFERENT),
}


def _let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is computed once."""
    return F.transform(F.array(c), f)[0]


def _iban(rest: Column) -> Column:
    """The IBAN that rest starts with, or an empty string; where the country isn't listed, the longest start that passes its check."""

    def of(n: int, head: str) -> str:
        tail = f"(?: ?[A-Z0-9]{{{n % 4}}})" if n % 4 else ""
        return rf"{head}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}{tail}\b"

    listed = "|".join(of(n, f"(?:{c.replace(' ', '|')})") for n, c in IBAN_LENGTHS.items())
    codes = "|".join(c.replace(" ", "|") for c in IBAN_LENGTHS.values())
    ends = F.array(*[F.regexp_extract(rest, "^" + of(n, "[A-Z]{2}"), 0) for n in range(34, 14, -1)])
    longest = F.try_element_at(F.filter(ends, lambda m: (m != "") & CHECKS["iban"](m)), F.lit(1))
    return F.when(rest.rlike(f"^(?:{codes})"), F.regexp_extract(rest, f"^(?:{listed})", 0)).otherwise(F.coalesce(longest, F.lit("")))


SPANS = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _spans(text: Column, kind: str) -> Column:
    """SPANS of one kind."""
    pattern, rank = PATTERNS[kind], KINDS.index(kind)
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        if kind != "iban":
            return one(acc, x, x["h"])
        # the pattern finds heads only, so that what follows one can't hide the next
        return _let(_iban(F.substring(text, acc["at"] + F.length(x["p"]) + 1, F.lit(44))), lambda m: one(acc, x, m))

    def one(acc: Column, x: Column, m: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(m), F.lit(0))
        before = F.substring(F.concat(acc["tail"], x["p"]), -REACH, REACH)
        around = F.concat(before, F.lit(" "), F.substring(F.coalesce(x["q"], F.lit("")), 1, REACH // 2))
        near = F.lower(around).rlike(rf"\b(?:{CONTEXT[kind]})")
        sure = F.lit(CHECKED[kind])
        if kind == "secret":
            sure = F.when(m.rlike(KNOWN_SECRET), CHECKED["card"]).otherwise(sure)
        score = F.least(F.lit(1.0), FOUND + sure + F.when(near, NEAR).otherwise(0.0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), score.alias("score"))
        good = x["h"].isNotNull() & CHECKS[kind](m)
        if kind not in BASE:
            good = good & (score >= KEEP)
        if kind == "iban":
            good = good & (start >= F.coalesce(F.try_element_at(acc["out"], F.lit(-1))["end"], F.lit(0)))
        h = F.coalesce(x["h"], F.lit(""))
        return F.struct(
            (start + F.length(h)).alias("at"), F.substring(F.concat(before, h), -REACH, REACH).alias("tail"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out")
        )

    zipped = F.arrays_zip(pieces.alias("p"), hits.alias("h"), F.slice(pieces, F.lit(2), F.size(pieces)).alias("q"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(SPANS).alias("out"))
    guard = text.contains(GUARDS[kind]) if GUARDS[kind] else text.rlike("[0-9][ -]?[0-9]" if kind == "card" else "[0-9][0-9]" if kind == "iban" else "[0-9]")
    if kind in ("ip", "ssn"):
        guard = guard & text.rlike("[0-9]")
    return F.when(guard & text.rlike(pattern), F.aggregate(zipped, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPANS))


def detect(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """docs with a column of all spans by start, then kind: array<struct<start, rank, end, kind, score>>."""
    t = text_or_empty(text)
    found = F.concat(*[_spans(t, k) for k in KINDS])
    #: Texts without a digit or an @ hold nothing of any kind.
    none = F.array().cast(SPANS)
    return docs.withColumn(into, F.array_sort(F.when(t.rlike("[0-9@]"), found).otherwise(none)))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scored(spans: Column) -> Column:
    """The spans' scores, comma-joined, with two decimals."""
    return F.array_join(F.transform(spans, lambda s: s["score"].cast("decimal(3,2)").cast("string")), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; overlapping spans become one. Null stays null."""
    t = F.col(text)
    (spans,) = fresh(docs, "_spans")

    def step(acc: Column, s: Column) -> Column:
        over = s["start"] < acc["at"]
        piece = F.concat(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(over, acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(F.col(spans), zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))))
    return detect(docs, text, spans).withColumn(text, F.when(F.size(spans) > 0, done).otherwise(t)).drop(spans)
