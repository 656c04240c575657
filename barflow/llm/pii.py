"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust their score.

Everything is a column expression; offsets are code points. A kind's matches and the text between them come from two calls of
the same expression, and their lengths add up to offsets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds of personal data and their validity rules. Possessive quantifiers and the look at the character
# before keep long runs linear and change no match.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Length of an account number by country (ISO 13616 registry and the countries that use it without being listed).
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "|".join(" ".join(_LENGTHS.values()).split())
# A listed country's number ends at its length, so what follows is not taken for a part of it. Numbers of other countries have
# no known length: they end with a group of fewer than four, or run on to the last word end, up to a blank before a listed number.
_GAP = rf"\x20(?!(?:{_LISTED})[0-9]{{2}})"
_IBAN = (
    r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:"
    + "|".join(rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for n, names in _LENGTHS.items())
    + rf"|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:(?:{_GAP}[A-Z0-9]{{4}}){{2,7}}{_GAP}[A-Z0-9]{{1,3}}(?![A-Za-z0-9])|(?:(?:{_GAP})?[A-Z0-9]){{11,30}}))(?![A-Za-z0-9])"
)
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Characters on either side in which context words count, and what one adds to a score.
NEAR = 40
BOOST = 0.3


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn check digit."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without blanks has the check digits of ISO 13616."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i + 1, F.lit(1)))
        return F.when(c < 58, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(0), F.length(account) - 1), F.lit(0), add) == 1


@dataclass(frozen=True)
class Kind:
    """``base`` spans stay whatever their score; others need the threshold."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool
    guard: str = ""


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


KINDS = (
    Kind("email", _EMAIL, lambda m: F.lit(True), 0.7, r"mail|contact|write|kontakt|correo|courriel", True, "@"),
    Kind("ip", _IP, lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), 0.5, r"\bip\b|address|host|server|adresse", True, "."),
    Kind("card", _CARD, lambda m: F.when(_between(F.length(_digits(m)), 16, 19), luhn(_digits(m))).otherwise(False), 0.7, r"card|visa|credit|karte|tarjeta|carte", True),
    Kind("phone", _PHONE, lambda m: _between(F.length(_digits(m)), 8, 15), 0.5, r"phone|call|tel|mobile|fax|anruf", True, "+"),
    Kind("iban", _IBAN, lambda m: F.when(_between(F.length(F.replace(m, F.lit(" "), F.lit(""))), 15, 34), mod97(F.replace(m, F.lit(" "), F.lit("")))).otherwise(False), 0.7, r"iban|bank|account|konto|compte|cuenta", False),
    Kind("ssn", _SSN, lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, r"ssn|social security|tax id", False, "-"),
)

_SPAN = "struct<kind:string,start:int,end:int,value:string,score:double,base:boolean>"


def _spans(kind: Kind, text: Column, threshold: float) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({kind.pattern})"), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    pairs = F.slice(F.arrays_zip(gaps.alias("gap"), found.alias("match")), F.lit(1), F.size(found))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("value")))).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
    placed = F.filter(F.aggregate(pairs, empty, step, lambda acc: acc["out"]), lambda x: kind.valid(x["value"]))

    def scored(x: Column) -> Column:
        low = F.greatest(x["start"] - NEAR, F.lit(0))
        around = F.concat(F.substring(text, low + 1, x["start"] - low), F.lit(" "), F.substring(text, x["end"] + 1, F.lit(NEAR)))
        score = F.lit(kind.score) + F.when(F.lower(around).rlike(kind.context), BOOST).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), score.alias("score"), F.lit(kind.base).alias("base"))

    out = F.transform(placed, scored)
    if not kind.base:
        out = F.filter(out, lambda x: x["score"] >= threshold)
    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(F.contains(text, F.lit(kind.guard)), out).otherwise(none) if kind.guard else out


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans`` (kind, start, end, value, score, base), by kind as in ``KINDS``, then start.

    Starts and ends count code points, ends are exclusive. A null or empty text has no span. Matches of one kind do not
    overlap; a match that fails its check is dropped and not tried again at a later start. Other columns are not looked at.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"))
    # one projection per kind keeps each expression small
    for kind in KINDS:
        rows = rows.withColumn(f"_{kind.name}", _spans(kind, F.col("text"), threshold))
    return rows.select("doc_id", F.concat(*(F.col(f"_{kind.name}") for kind in KINDS)).alias("spans"))
