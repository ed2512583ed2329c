"""Normal forms of names, addresses, numbers and dates, and fuzzy comparison."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they are reduced to.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüýÿçñ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyycn"
COMPANY_SUFFIXES = "incorporated|corporation|company|limited|holdings|holding|group|inc|corp|ltd|llc|llp|plc|co"
COMPANY_STOP_WORDS = "the|and|of|for"
PERSON_TITLES = "mr|mrs|ms|miss|dr|prof|professor|sir|dame|lord|lady"
PERSON_SUFFIXES = "jr|sr|ii|iii|iv|phd|md|esq"
STREET_WORDS = {
    "st": "street",
    "ave": "avenue",
    "rd": "road",
    "dr": "drive",
    "ln": "lane",
    "ct": "court",
    "pl": "place",
    "blvd": "boulevard",
    "apt": "apartment",
    "ste": "suite",
    "n": "north",
    "s": "south",
    "e": "east",
    "w": "west",
}


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def base(value: Column) -> Column:
    """Accents stripped, lower case, white space collapsed."""
    return _squeeze(F.translate(F.lower(value), ACCENTED, PLAIN))


def company(value: Column) -> Column:
    c = F.regexp_replace(base(value), r"[^\w\s]", " ")
    c = F.regexp_replace(_squeeze(c), rf"\b(?:{COMPANY_STOP_WORDS})\b", " ")
    return _squeeze(F.regexp_replace(_squeeze(c), rf"(?:\s(?:{COMPANY_SUFFIXES}))+$", ""))


def person(value: Column) -> Column:
    c = F.regexp_replace(base(value), r"[^\w\s]", " ")
    c = F.regexp_replace(_squeeze(c), rf"^(?:(?:{PERSON_TITLES})\s+)+", "")
    return _squeeze(F.regexp_replace(c, rf"(?:\s+(?:{PERSON_SUFFIXES}))+$", ""))


def address(value: Column) -> Column:
    spelled = reduce(
        lambda c, pair: F.regexp_replace(c, rf"\b{pair[0]}\b\.?", pair[1]), STREET_WORDS.items(), base(value)
    )
    return _squeeze(F.regexp_replace(spelled, r"[^\w\s]", " "))


def phone(value: Column) -> Column:
    """Digits only, without the country code 1 of an eleven-digit number."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)


def email(value: Column) -> Column:
    c = F.regexp_replace(F.lower(value), " ", "")
    return F.regexp_replace(F.regexp_replace(c, r"\[at\]", "@"), r"\[dot\]", ".")


def url(value: Column) -> Column:
    c = F.regexp_replace(F.lower(value), r"^https?://", "")
    return F.regexp_replace(F.regexp_replace(c, r"^www\.", ""), r"/+$", "")


def monetary(value: Column) -> Column:
    """The amount as a double, scaled by the first of k, m, b, t that occurs."""
    number = F.regexp_replace(value, r"[^\d.]", "").try_cast("double")
    low = F.lower(value)
    scale = (
        F.when(low.contains("k"), 1e3).when(low.contains("m"), 1e6).when(low.contains("b"), 1e9).when(low.contains("t"), 1e12)
    )
    return number * F.coalesce(scale, F.lit(1.0))


def percentage(value: Column) -> Column:
    """A fraction with four decimals; numbers above 1 are taken as percent."""
    number = F.regexp_replace(value, r"[^\d.]", "").try_cast("double")
    return F.format_string("%.4f", F.when(number > 1, number / 100).otherwise(number))


def date(value: Column) -> Column:
    """yyyy-MM-dd; of two-digit parts the first is the day only if it exceeds 12. Else lower case."""
    two = lambda c: F.lpad(c, 2, "0")
    iso, short = r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
    a, b, y = (F.regexp_extract(value, short, i) for i in (1, 2, 3))
    day_first = a.try_cast("int") > 12
    return (
        F.when(
            value.rlike(iso),
            F.concat_ws("-", F.regexp_extract(value, iso, 1), two(F.regexp_extract(value, iso, 2)), two(F.regexp_extract(value, iso, 3))),
        )
        .when(value.rlike(short), F.when(day_first, F.concat_ws("-", y, two(b), two(a))).otherwise(F.concat_ws("-", y, two(a), two(b))))
        .otherwise(F.lower(value))
    )


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; equal texts give 1, an empty one 0."""
    longer = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a == b, F.lit(1.0))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .otherwise(1 - F.levenshtein(a, b) / longer)
    )


def fuzzy_match(a: Column, b: Column, threshold: float = 0.85) -> Column:
    x, y = base(a), base(b)
    return (x == y) | (levenshtein_ratio(x, y) >= threshold)


def slug(value: Column) -> Column:
    """Lower case, word characters only, runs of separators as one underscore."""
    kept = F.regexp_replace(F.lower(value), r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[\s_-]+", "_"), r"^_+|_+$", "")


NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "text": base,
    "company": company,
    "person": person,
    "address": address,
    "phone": phone,
    "email": email,
    "url": url,
    "monetary": lambda c: monetary(c).cast("string"),
    "percentage": percentage,
    "date": date,
}


def register(kind: str, normalizer: Callable[[Column], Column]) -> None:
    """Add or replace the normal form of a kind."""
    NORMALIZERS[kind] = normalizer


def normalize(value: Column, kind: str = "text") -> Column:
    return NORMALIZERS.get(kind, base)(value)
