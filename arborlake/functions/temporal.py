"""Calendar, fiscal and academic components of timestamps, and dates found in text.

All functions map Columns to Columns and stay in code generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First month of the fiscal year in extracted dates and in searches (they differ).
EXTRACT_FISCAL_START, SEARCH_FISCAL_START = 10, 7


def season(ts: Column) -> Column:
    """winter is December to February, spring March to May, summer June to August, else fall."""
    month = F.month(ts)
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.between(3, 5), "spring")
        .when(month.between(6, 8), "summer")
        .otherwise("fall")
    )


def fiscal_year(ts: Column, start: int = EXTRACT_FISCAL_START) -> Column:
    return F.year(ts) + F.when(F.month(ts) >= start, 1).otherwise(0) if start > 1 else F.year(ts)


def fiscal_quarter(ts: Column, start: int = EXTRACT_FISCAL_START) -> Column:
    return (F.floor(F.pmod(F.month(ts) - start, F.lit(12)) / 3) + 1).cast("int")


def academic_semester(ts: Column) -> Column:
    """fall from August, spring from January to May, summer in June and July."""
    month = F.month(ts)
    return F.when(month >= 8, "fall").when(month <= 5, "spring").otherwise("summer")


def academic_year(ts: Column) -> Column:
    first = F.year(ts) - F.when(F.month(ts) >= 8, 0).otherwise(1)
    return F.concat_ws("-", first.cast("string"), (first + 1).cast("string"))


def time_of_day(ts: Column) -> Column:
    hour = F.hour(ts)
    return (
        F.when(hour.between(5, 11), "morning")
        .when(hour.between(12, 16), "afternoon")
        .when(hour.between(17, 20), "evening")
        .otherwise("night")
    )


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def is_business_hours(ts: Column) -> Column:
    """Monday to Friday from 9:00 up to 17:00."""
    return (F.weekday(ts) < 5) & F.hour(ts).between(9, 16)


def decade(ts: Column) -> Column:
    return (F.floor(F.year(ts) / 10) * 10).cast("int")


def century(ts: Column) -> Column:
    return (F.floor((F.year(ts) - 1) / 100) + 1).cast("int")


def components(ts: Column) -> dict[str, Column]:
    """All components of a full date, by name."""
    return {
        "year_value": F.year(ts),
        "month_value": F.month(ts),
        "day_value": F.dayofmonth(ts),
        "quarter_value": F.quarter(ts),
        "week_of_year": F.weekofyear(ts),
        "day_of_year": F.dayofyear(ts),
        "day_of_week": F.weekday(ts),
        "is_weekend": is_weekend(ts),
        "decade": decade(ts),
        "century": century(ts),
        "season": season(ts),
        "fiscal_year": fiscal_year(ts),
        "fiscal_quarter": fiscal_quarter(ts),
        "academic_year": academic_year(ts),
        "academic_semester": academic_semester(ts),
        "time_of_day": time_of_day(ts),
        "is_business_hours": is_business_hours(ts),
    }


# The forms of dates that are recognised in text.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
SHORT_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATE_FORMS = {
    "iso": r"\b\d{4}-\d{2}-\d{2}\b",
    "us": r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    "european": r"\b\d{1,2}\.\d{1,2}\.\d{4}\b",
    "written": rf"\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b",
    "written_uk": rf"\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\b",
    "abbreviated": rf"\b(?:{SHORT_MONTHS})\.?\s+\d{{1,2}},?\s+\d{{4}}\b",
}
#: What each form starts with.
DATE_LEADS = {"iso": r"\d", "us": r"\d", "european": r"\d", "written": "[JFMASOND]", "written_uk": r"\d", "abbreviated": "[JFMASOND]"}
DECADE = r"\b((?:19|20)\d)0s\b"
QUARTER = r"\bQ([1-4])(?:\s+((?:19|20)\d{2}))?\b"
SEASON = r"(?i)\b(spring|summer|fall|autumn|winter)(?:\s+((?:19|20)\d{2}))?\b"


def led(pattern: str, first: str | None) -> str:
    """The pattern behind a look for the class of its first character, which spares most places the rest of it."""
    return f"(?={first}){pattern}" if first else pattern


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def month_number(name: Column) -> Column:
    """1 to 12 from the first three letters of an English month name."""
    at = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(name, 1, 3)))
    return F.when((at > 0) & (F.length(name) >= 3), ((at + 2) / 3).cast("int"))


def to_iso(found: Column) -> Column:
    """yyyy-MM-dd of a date in one of DATE_FORMS; null if it is no calendar date or before 1900 or after 2100."""
    y4 = F.regexp_extract(found, r"(\d{4})", 1)
    us = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    eu = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
    name = F.regexp_extract(found, r"([A-Za-z]{3,})", 1)
    day = F.regexp_extract(found, r"\b(\d{1,2})\b", 1)
    two = lambda c: F.lpad(c, 2, "0")
    iso = (
        F.when(found.rlike(r"^\d{4}-\d{2}-\d{2}$"), found)
        .when(found.rlike(us), F.concat_ws("-", y4, two(F.regexp_extract(found, us, 1)), two(F.regexp_extract(found, us, 2))))
        .when(found.rlike(eu), F.concat_ws("-", y4, two(F.regexp_extract(found, eu, 2)), two(F.regexp_extract(found, eu, 1))))
        .otherwise(F.concat_ws("-", y4, two(month_number(name).cast("string")), two(day)))
    )
    real = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))
    return F.when(F.year(real).between(1900, 2100), F.date_format(real, "yyyy-MM-dd"))


def specificity(found: Column) -> Column:
    """How precise a date expression is: full, date_only, month_only, quarter_only, year_only or vague."""
    return (
        F.when(found.rlike(r"\d{1,2}:\d{2}"), "full")
        .when(found.rlike(rf"{DATE_FORMS['iso']}|{DATE_FORMS['us']}|{DATE_FORMS['european']}"), "date_only")
        .when(found.rlike(rf"(?i){DATE_FORMS['written']}|{DATE_FORMS['written_uk']}|{DATE_FORMS['abbreviated']}"), "date_only")
        .when(found.rlike(rf"(?i)\b(?:{MONTHS}|{SHORT_MONTHS})\b\.?(?:\s+\d{{4}})?$"), "month_only")
        .when(found.rlike(r"(?i)\bq[1-4]\b|quarter"), "quarter_only")
        .when(found.rlike(r"^\s*\d{4}\s*$"), "year_only")
        .otherwise("vague")
    )


def locale_of(found: Column) -> Column:
    return (
        F.when(found.rlike(r"^\d{4}-"), "ISO").when(found.rlike(r"^\d{1,2}\."), "EU").when(found.rlike("/"), "US")
    )


# Cues of expressions relative to now, and of what they are relative to.
RELATIVE_CUES = [
    "yesterday", "today", "tomorrow", "last", "next", "ago", "from now",
    "this week", "next week", "last week", "this month", "next month", "last month",
    "this year", "next year", "last year", "this quarter", "next quarter", "last quarter",
]
REFERENCE_CUES = ["last", "next", "this", "yesterday", "today", "tomorrow", "ago", "from now", "before", "after", "since", "until"]


def _holds_any(text: Column, cues: list[str]) -> Column:
    return F.lower(text).rlike("|".join(cues))


def is_relative(found: Column) -> Column:
    return _holds_any(found, RELATIVE_CUES)


def is_partial(found: Column, ts: Column, now: Column) -> Column:
    """A short expression whose year was not written but taken from now."""
    year = F.year(now)
    return (F.year(ts) == year) & ~found.contains(year.cast("string")) & (F.length(F.trim(found)) < 10)


def date_type(found: Column, ts: Column, now: Column) -> Column:
    """relative, partial or absolute."""
    return F.when(is_relative(found), "relative").when(is_partial(found, ts, now), "partial").otherwise("absolute")


def relative_reference(found: Column, context: Column) -> Column:
    """The cues that an expression or its surroundings hold, in a fixed order, parted by commas."""
    both = F.lower(F.concat_ws(" ", found, context))
    return F.concat_ws(", ", *[F.when(both.contains(c), F.lit(c)) for c in REFERENCE_CUES])


#: Written before and behind each match where texts are cut at their matches.
_BEFORE, _BEHIND = "\0", "\1"


def find_all_at(text: Column, pattern: str) -> Column:
    """array of (raw, start): all matches of a pattern and where they start, from 0.

    A text is looked through once: its matches are put between marks, and what the marks
    part gives matches and offsets.  Texts that hold a mark are cut at their matches by a split.
    """
    none = F.array().cast("array<struct<raw:string,start:int>>")

    def step(raw: Column, before: Column, after: Column) -> Callable[[Column], Column]:
        return lambda s: F.struct(
            (s["at"] + before + F.length(raw) + after).alias("at"),
            F.concat(s["found"], F.array(F.struct(raw.alias("raw"), (s["at"] + before).alias("start")))).alias("found"),
        )

    def walked(pieces: Column) -> Column:
        start = F.struct(F.length(pieces[0]).alias("at"), none.alias("found"))

        def one(s: Column, x: Column) -> Column:
            raw = F.substring_index(x, _BEHIND, 1)
            return step(raw, F.lit(0), F.length(x) - F.length(raw) - 1)(s)

        return F.aggregate(F.slice(pieces, 2, F.size(pieces)), start, one, lambda s: s["found"])

    # there is one piece more than matches, so the last pair has no match
    paired = F.arrays_zip(find_all(text, pattern).alias("raw"), F.split(text, pattern).alias("before"))
    split = F.aggregate(
        paired,
        F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda s, x: F.when(x["raw"].isNull(), s).otherwise(step(x["raw"], F.length(x["before"]), F.lit(0))(s)),
        lambda s: s["found"],
    )
    marked = F.split(F.regexp_replace(text, pattern, f"{_BEFORE}$0{_BEHIND}"), _BEFORE)
    # a list of one, so that the pieces are made once
    quick = F.transform(F.array(marked), lambda pieces: F.when(F.size(pieces) > 1, walked(pieces)).when(pieces.isNotNull(), none))[0]
    return F.when(F.contains(text, F.lit(_BEFORE)) | F.contains(text, F.lit(_BEHIND)), split).otherwise(quick)


def around(text: Column, start: Column, length: Column, window: int = 50) -> Column:
    """The characters of a match at ``start`` (from 0) and up to ``window`` on each side."""
    first = F.greatest(start - window, F.lit(0))
    return F.substr(text, (first + 1).cast("int"), (start + length + window - first).cast("int"))


def dates_in_context(rows: DataFrame, key: str = "element_pk", text: str = "text", window: int = 50) -> DataFrame:
    """(key, form, raw, start, context, date): dates of DATE_FORMS with their place and surroundings."""

    def of_form(name: str) -> Column:
        return F.transform(find_all_at(F.col(text), led(DATE_FORMS[name], DATE_LEADS.get(name))), lambda x: F.struct(F.lit(name).alias("form"), x["raw"].alias("raw"), x["start"].alias("start")))

    found = F.flatten(F.array(*map(of_form, DATE_FORMS)))
    hits = rows.select(key, F.col(text).alias("__text"), F.inline(found))
    return hits.select(key, "form", "raw", "start", around(F.col("__text"), F.col("start"), F.length("raw"), window).alias("context"), to_iso(F.col("raw")).alias("date")).where("date IS NOT NULL")


def fiscal_from_quarter(quarter: Column, year: Column, start: int = EXTRACT_FISCAL_START) -> tuple[Column, Column]:
    """(fiscal quarter, fiscal year) of a calendar quarter; a start in any month but October keeps the calendar's."""
    if start != 10:
        return quarter, year
    return F.when(quarter < 4, quarter + 1).otherwise(F.lit(1)), F.when(quarter == 4, year + 1).otherwise(year)


_CLOCK = r"\d{1,2}(?::\d{2}(?::\d{2})?)?\s*(?:[AaPp]\.?[Mm]\.?)?"
_RANGE = rf"^\s*({_CLOCK})\s*(?:-|–|—|to)\s*({_CLOCK})\s*$"


def temporal_type(value: Column) -> Column:
    """NONE, DATE, TIME, DATETIME or TIME_RANGE of a short text (at most 50 characters and 8 words)."""
    clock = r"\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp]\.?[Mm]\.?)?"
    hour = r"\d{1,2}\s*[AaPp]\.?[Mm]\.?"
    forms = "|".join(DATE_FORMS.values())
    trimmed = F.trim(value)
    words = F.size(F.split(trimmed, r"\s+"))
    has_date, has_time = trimmed.rlike(rf"(?i){forms}"), trimmed.rlike(rf"{clock}|\b{hour}")
    ranged = trimmed.rlike(_RANGE) & (trimmed.contains(":") | trimmed.rlike(r"(?i)\d\s*[ap]\.?m\.?\s*$"))
    return (
        F.when(value.isNull() | (F.length(trimmed) > 50) | (words > 8) | (trimmed == ""), "NONE")
        .when(ranged, "TIME_RANGE")
        .when(has_date & has_time, "DATETIME")
        .when(has_date, "DATE")
        .when(trimmed.rlike(rf"^(?:{clock}|{hour})$|^(?i)(?:noon|midnight)$"), "TIME")
        .otherwise("NONE")
    )


def clock_minutes(value: Column, half: Column | None = None) -> Column:
    """Minutes since midnight of a clock time; ``half`` (am or pm) holds where the text has none; null if it is no time."""
    low = F.lower(F.trim(value))
    form = r"^(\d{1,2})(?::(\d{2}))?(?::\d{2})?\s*([ap])?\.?m?\.?$"
    part = lambda i: F.nullif(F.regexp_extract(low, form, i), F.lit(""))
    hour, minute = part(1).cast("int"), F.coalesce(part(2).cast("int"), F.lit(0))
    own = F.coalesce(part(3), F.left(half, F.lit(1))) if half is not None else part(3)
    hour24 = F.when(own == "p", hour % 12 + 12).when(own == "a", hour % 12).otherwise(hour)
    real = low.rlike(form) & (hour24 < 24) & (minute < 60)
    return F.when(low == "noon", 720).when(low == "midnight", 0).when(real, hour24 * 60 + minute)


def time_range(value: Column) -> Column:
    """(start_minute, end_minute) since midnight; a start without am or pm takes that of the end if it stays before it."""
    first, last = F.regexp_extract(value, _RANGE, 1), F.regexp_extract(value, _RANGE, 2)
    half = F.nullif(F.lower(F.regexp_extract(last, r"(?i)([ap])\.?m", 1)), F.lit(""))
    end, plain, taken = clock_minutes(last), clock_minutes(first), clock_minutes(first, half)
    start = F.when(taken <= end, taken).otherwise(plain)
    return F.when(value.rlike(_RANGE), F.struct(start.alias("start_minute"), end.alias("end_minute")))


def _clock_text(minutes: Column) -> Column:
    return F.format_string("%02d:%02d:00", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def spoken_time(minutes: Column) -> Column:
    """A time spelled out: as it is, without colon, noon, midnight or half past, business hours or lunch time."""
    hour, minute = F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    named = (
        F.when((hour == 12) & (minute == 0), "noon, midday")
        .when((hour == 0) & (minute == 0), "midnight")
        .when(minute == 30, F.concat(F.lit("half past "), twelve.cast("string")))
    )
    part = F.when(hour.between(9, 16), "business hours").when(hour.between(12, 13), "lunch time")
    return F.concat_ws(", ", _clock_text(minutes), F.format_string("%02d%02d", hour, minute), named, part)


def spoken_time_range(value: Column) -> Column:
    """from ... until ..., and the names of common working hours and of lunch; the text itself if it is no range."""
    r = time_range(value)
    start, end = r["start_minute"], r["end_minute"]
    names = (
        F.when((start == 540) & (end == 1020), "nine to five, 9-5, standard business hours, regular office hours")
        .when((start == 480) & (end == 1020), "eight to five, 8-5, extended business hours")
        .when((start == 540) & (end == 1080), "nine to six, 9-6, extended office hours")
    )
    lunch = F.when((F.floor(start / 60) == 12) & (F.floor(end / 60) == 13), "lunch hour, lunch break, midday break")
    whole = F.concat_ws(", ", F.concat(F.lit("from "), spoken_time(start), F.lit(" until "), spoken_time(end)), names, lunch)
    return F.when(start.isNotNull() & end.isNotNull(), whole).otherwise(value)


_ORDINALS = ["first", "second", "third", "fourth", "fifth"]
# Business days of the month that are named.
BUSINESS_DAYS = {1: "first", 2: "second", 3: "third", 5: "fifth", 10: "tenth", 15: "fifteenth", 20: "twentieth"}


def business_day(ts: Column) -> Column:
    """Number of weekdays of the month up to and including a day."""
    day, first = F.dayofmonth(ts), F.weekday(F.trunc(ts, "month"))
    days = F.sequence(F.lit(0), day - 1)
    return F.size(F.filter(days, lambda d: (first + d) % 7 < 5))


def spoken_date(ts: Column) -> Column:
    """A date spelled out for text embedding: quarter, month, season, place in the month, weekday, business day, year."""
    day, quarter, month = F.dayofmonth(ts), F.quarter(ts), F.month(ts)
    nth = lambda c: F.element_at(F.array(*map(F.lit, _ORDINALS)), c.cast("int"))
    week = F.floor((day - 1) / 7) + 1
    count = business_day(ts)
    named = F.try_element_at(F.create_map(*[x for k, v in BUSINESS_DAYS.items() for x in (F.lit(k), F.lit(f"{v} business day"))]), count)
    return F.concat_ws(
        ", ",
        F.date_format(ts, "yyyy-MM-dd"),
        F.concat(F.lit("Q"), quarter.cast("string")),
        F.concat(nth(quarter), F.lit(" quarter")),
        F.date_format(ts, "MMM"),
        F.element_at(F.array(*map(F.lit, ["winter", "spring", "summer", "fall"])), quarter),
        F.concat(nth(week), F.lit(" week")),
        F.when(week <= 2, "early month").when(week >= 4, "late month").otherwise("mid month"),
        F.when(day <= 7, "beginning of month").when(day >= 22, "end of month").when(day.between(10, 20), "mid month"),
        F.when((day >= 22) & (month == 12), "year end"),
        F.date_format(ts, "EEEE"),
        F.when(is_weekend(ts), "weekend").otherwise("business day, weekday"),
        F.when(count <= 5, "early business days").when(count.between(17, 22), "late business days"),
        F.when(count <= 22, named),
        F.year(ts).cast("string"),
        F.date_format(ts, "yyyy-MM"),
        F.when(quarter == 4, "fiscal year end, year end").when(quarter == 1, "fiscal year start"),
    )


def spoken_datetime(ts: Column) -> Column:
    return F.concat_ws(", ", spoken_date(ts), spoken_time(F.hour(ts) * 60 + F.minute(ts)))


def spoken(value: Column) -> Column:
    """A date, time, both or a range in a short text, spelled out; any other text as it is."""
    kind = temporal_type(value)
    forms = "|".join(DATE_FORMS.values())
    day = F.try_to_timestamp(to_iso(F.regexp_extract(value, f"({forms})", 1)), F.lit("yyyy-MM-dd"))
    clock = clock_minutes(F.regexp_extract(F.trim(F.regexp_replace(value, forms, " ")), r"(?i)(\d{1,2}(?::\d{2}){0,2}\s*(?:[ap]\.?m\.?)?)$", 1))
    return F.coalesce(
        F.when(kind == "DATE", spoken_date(day))
        .when(kind == "TIME", spoken_time(clock_minutes(value)))
        .when(kind == "DATETIME", F.concat_ws(", ", spoken_date(day), spoken_time(clock)))
        .when(kind == "TIME_RANGE", spoken_time_range(value)),
        value,
    )
