"""Dates out of free text, and the calendar of Asia/Kabul (UTC+4:30) in which days are counted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, squeeze

ZONE = "Asia/Kabul"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
FULL_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def month_number(name: Column) -> Column:
    """Number of a month by its first three letters, as two digits; null for other words."""
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    return let(at, lambda n: F.when(n > 0, F.lpad(n.cast("string"), 2, "0")))


def full_month_number(name: Column) -> Column:
    """Number of a month by its full name, or one of its usual short forms."""
    low = F.lower(name)
    return F.when(low.isin(*FULL_MONTHS, *MONTHS, "sept"), month_number(low))


def day_of(year: Column, month: Column, day: Column, least: int = 1, most: int = 9999) -> Column:
    """A calendar day, or null where there is no such day; never an error."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    parts = F.struct(text.alias("text"), (year.isNotNull() & month.isNotNull() & day.isNotNull()).alias("whole"))
    known = lambda p: p["whole"] & F.substring(p["text"], 1, 4).cast("int").between(least, most)
    return let(parts, lambda p: F.when(known(p), F.try_to_timestamp(p["text"], F.lit("yyyy-MM-dd")).cast("date")))


def _parts(c: Column, pattern: str, n: int = 3) -> list[Column]:
    return [F.nullif(F.regexp_extract(c, pattern, i), F.lit("")) for i in range(1, n + 1)]


def _first(c: Column, *rules) -> Column:
    """The first rule whose pattern is found decides, even if the day it gives does not exist."""

    def decided(text: Column) -> Column:
        out = F.lit(None).cast("date")
        for pattern, build in reversed(rules):
            out = F.when(text.rlike(pattern), build(*_parts(text, pattern))).otherwise(out)
        return out

    return let(c, decided)


#: Forms of a closing day, in the order in which they are tried; parts are told apart by what stands between them.
CLOSING_FORMS = ("Y-M-D", "D N Y", "N D Y", "D/M/Y")
#: Forms that the query layer reads at the start of a text.
SHOWN_NUMERIC, SHOWN_NAMED = ("Y-M-D", "D-M-Y"), ("N D Y", "D N Y")


def _form(form: str, parts: dict[str, str], gaps: dict[str, str]) -> tuple[str, list[str]]:
    """(pattern with a group for each part, names of the parts) of a form."""
    names = [c for c in form if c in parts]
    pattern = "".join(f"({parts[c]})" if c in parts else gaps[c] for c in form)
    return pattern, names


def _day_rule(form: str, parts: dict[str, str], gaps: dict[str, str], month: Callable, least: int, most: int, head: str, tail: str):
    pattern, names = _form(form, parts, gaps)

    def build(*values: Column) -> Column:
        at = dict(zip(names, values, strict=True))
        return day_of(at["Y"], month(at["N"]) if "N" in at else at["M"], at["D"], least, most)

    return head + pattern + tail, build


def closing_day(c: Column) -> Column:
    """The day named anywhere in a text: ISO, ``D Month Y``, ``Month D Y`` or ``D/M/Y``; years 2000 to 2099."""
    edge, end = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    parts = {"Y": r"20\d\d", "M": r"\d{1,2}", "D": r"\d{1,2}", "N": "[A-Za-z]{3,}"}
    out = []
    for form in CLOSING_FORMS:
        words = "N" in form
        # between words a blank, and before their year a comma too; between numbers the sign of the form, or one like it
        shaped = form.replace(" Y", ",Y") if words else form
        gaps = {" ": r"\s+", ",": r",?\s*", "-": "-", "/": "[/.-]"}
        out.append(_day_rule(shaped, parts, gaps, month_number, 2000, 2100, edge, end))
    return _first(squeeze(c), *out)


def shown_day(c: Column) -> Column:
    """The day a text starts with, as the query layer reads it: Y-M-D, D-M-Y, ``Month Dth, Y``, ``Dth Month Y``."""
    numbers = {"Y": r"\d{4}", "M": r"\d{1,2}", "D": r"\d{1,2}"}
    named = numbers | {"N": "[a-z]+"}

    def read(text: Column) -> Column:
        whole = [_day_rule(f, numbers, {"-": "[-/]"}, month_number, 1, 9999, "^", r"(?!\d)" if f.endswith("Y") else "") for f in SHOWN_NUMERIC]
        # days of a form in words may carry an ordinal's ending, and years follow a comma
        gaps = {" ": r"\s+", "t": "(?:st|nd|rd|th)?", ",": r",?\s+"}
        words = [_day_rule(f.replace(" Y", ",Y").replace("D", "Dt"), named, gaps, full_month_number, 1, 9999, "(?i)^", "") for f in SHOWN_NAMED]
        found = F.coalesce(*[build(*_parts(text, p)) for p, build in words])
        for p, build in reversed(whole):
            found = F.when(text.rlike(p), build(*_parts(text, p))).otherwise(found)
        return found

    return let(F.trim(c.cast("string")), read)


def display_day(day: Column, short: bool = False, fallback: str = "Not specified") -> Column:
    """A day for readers, in English: ``March 5, 2026``, or ``Mar 5, 2026``."""
    return F.coalesce(F.date_format(day, "MMM d, yyyy" if short else "MMMM d, yyyy"), F.lit(fallback))


def display_update(at: Column) -> Column:
    """When a feed was updated, for readers, in Kabul's time."""
    return F.coalesce(F.concat(F.lit("Updated "), F.date_format(F.from_utc_timestamp(at, ZONE), "MMM d, h:mm a")), F.lit("Update time unavailable"))


def legacy_day_text(c: Column) -> Column:
    """The older rule: ``Month D, Y`` or ISO as text, without asking whether the day exists."""
    text = squeeze(c)
    m, d, y = _parts(text, r"([A-Za-z]{3,})\s+(\d{1,2}),?\s*(20\d\d)")
    iso = F.nullif(F.regexp_extract(text, r"(20\d\d-\d\d-\d\d)", 1), F.lit(""))
    return F.coalesce(iso, F.when(month_number(m).isNotNull(), F.concat_ws("-", y, month_number(m), F.lpad(d, 2, "0"))))


def instant(c: Column, fallback: Column | None = None) -> Column:
    """A timestamp cut to seconds; the fallback where the text is none."""
    at = F.date_trunc("second", F.try_to_timestamp(c.cast("string")))
    return F.coalesce(at, fallback) if fallback is not None else at


def instant_text(c: Column) -> Column:
    """ISO-8601 in UTC with seconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def kabul_day(at: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(at, ZONE))


def seen_day(c: Column) -> Column:
    """Kabul's day of an instant with a zone; of a text without one, the calendar day it names."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"(?i)(?:Z|[+-]\d{2}:?\d{2})$"), kabul_day(F.try_to_timestamp(text))).otherwise(shown_day(text))


def days_until(day: Column, today: Column) -> Column:
    return F.datediff(day, today)
