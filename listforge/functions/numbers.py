"""Vacancy counts and salaries out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_digits, let, or_null, rx, word

NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
#: What openings are called, after a count and before one, and the most digits of a count.
OPENINGS = "vacancy vacancies job jobs position positions post posts opening openings".split()
COUNTED = "job jobs position positions vacancies".split()
DIGITS = 6
#: Words of a salary by scale, and of one to be agreed.
SCALE_WORDS = ["scale", "standard", "according to", "as per", "based on", "based upon"]
NEGOTIABLE = "negotiable"


def positive(c: Column) -> Column:
    n = c.try_cast("bigint")
    return F.when(n > 0, n)


def vacancy_count(c: Column) -> Column:
    """A positive count stated as a number, or as an English word up to twenty; null for anything else."""

    def read(text: Column) -> Column:
        # what is counted goes first, then what leads up to the count, then what explains it
        bare = rx(text, rf"\s+(?:{'|'.join(OPENINGS)})$", "")
        said = rx(bare, r"^a\s+", "")
        by_word = F.nullif(F.array_position(F.array(*[F.lit(w) for w in NUMBER_WORDS]), said), F.lit(0).cast("long"))
        number = rx(rx(bare, rf"^no\.?\s*(?:of\s+)?(?:{'|'.join(COUNTED)})(?![a-z])\s*[:-]?\s*", ""), r"(?<=\d)\s*\([a-z\s-]+\)$", "")
        digits = F.when(number.rlike(r"^\d+$") & (F.length(number) <= DIGITS), number)
        return F.coalesce(by_word, positive(digits))

    return let(F.lower(F.trim(fold_digits(c.cast("string")))), read)


def vacancy_bucket(n: Column) -> Column:
    return F.when(n.isNull(), "unknown").when(n == 1, "1").when(n <= 5, "2-5").when(n <= 10, "6-10").otherwise("11+")


#: What stands for no salary, and what a comparable salary names.
NO_SALARY = r"(?i)^(?:n/?a|none|null|not\s+(?:available|specified|provided|disclosed)|undisclosed|tbd|to be (?:determined|disclosed)|[-—])$"
CURRENCIES = {
    "AFN": word("afn|afs?|afghanis?") + "|؋",
    "USD": word(r"usd|us\s*dollars?") + r"|us\$|\$",
    "EUR": word("eur") + "|€",
    "GBP": word("gbp") + "|£",
}
PERIODS = {
    "hour": r"per\s+hour|hourly|/\s*(?:h|hr|hour)(?![a-z0-9_])",
    "day": r"per\s+day|daily|/\s*day(?![a-z0-9_])",
    "week": r"per\s+week|weekly|/\s*(?:wk|week)(?![a-z0-9_])",
    "month": r"per\s+month|monthly|/\s*(?:mo|month)(?![a-z0-9_])",
    "year": r"per\s+year|yearly|annually|per\s+annum|/\s*(?:yr|year)(?![a-z0-9_])",
}


def salary_text(c: Column) -> Column:
    return let(or_null(c), lambda text: F.when(~text.rlike(NO_SALARY), text))


def _named(text: Column, rules: dict[str, str]) -> Column:
    """The one name whose pattern is found; null if none or several are."""
    hits = F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(k)) for k, p in rules.items()]))
    return let(hits, lambda h: F.when(F.size(h) == 1, F.get(h, F.lit(0))))


def comparable_salary(text: Column) -> Column:
    """struct<minimum, maximum, currency, period> where one currency, one period and one or two rising amounts are named."""

    def read(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(r"(\d+(?:[ ,]\d{3})*(?:\.\d+)?)"), F.lit(1))
        amounts = F.filter(F.transform(found, lambda x: rx(x, "[ ,]", "").try_cast("double")), lambda x: x > 0)
        return F.struct(amounts.alias("amounts"), _named(t, CURRENCIES).alias("currency"), _named(t, PERIODS).alias("period"))

    def compared(s: Column) -> Column:
        low, high = F.get(s["amounts"], F.lit(0)), F.coalesce(F.get(s["amounts"], F.lit(1)), F.get(s["amounts"], F.lit(0)))
        good = s["currency"].isNotNull() & s["period"].isNotNull() & F.size(s["amounts"]).between(1, 2) & (high >= low)
        return F.when(good, F.struct(low.alias("minimum"), high.alias("maximum"), s["currency"].alias("currency"), s["period"].alias("period")))

    return let(let(F.replace(fold_digits(text), F.lit("\u00a0"), F.lit(" ")), read), compared)


def salary_kind(text: Column, pay: Column | None = None) -> Column:
    says = lambda *words: text.rlike("(?i)" + word("|".join(words)))
    return F.when(text.isNull(), "undisclosed").when(says(NEGOTIABLE), "negotiable").when(says(*SCALE_WORDS), "scale").when((comparable_salary(text) if pay is None else pay).isNotNull(), "numeric").otherwise("listed")


def salary_from_fields(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """Salary text out of typed fields."""
    amount = F.when(low.isNotNull() & high.isNotNull() & (low != high), F.concat_ws("-", low.cast("string"), high.cast("string"))).otherwise(F.coalesce(low, high).cast("string"))
    return F.when(amount.isNotNull(), F.concat_ws(" ", amount, or_null(currency), F.when(or_null(period).isNotNull(), F.concat(F.lit("per "), or_null(period)))))
