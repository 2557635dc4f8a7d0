"""Text functions as Column builders; one vectorised UDF for Unicode compatibility forms, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the byte-order mark.
WS = r"(?U)[\s\x{FEFF}]+"
EMAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"


def rx(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def let(c: Column, f) -> Column:
    """``f(c)`` with ``c`` evaluated once, however often ``f`` refers to it: keeps plans as small as they read."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        c = rx(c, pattern, to)
    return c


def squeeze(c: Column) -> Column:
    """White space runs as one blank, trimmed; null as empty."""
    return F.trim(rx(F.coalesce(c.cast("string"), F.lit("")), WS, " "))


def or_null(c: Column) -> Column:
    """Squeezed text, null if nothing is left."""
    return let(squeeze(c), lambda x: F.when(x != "", x))


def clean_lines(c: Column) -> Column:
    """Multi-line text with blanks squeezed, lines trimmed and at most one empty line in a row; null if empty."""
    out = chain(F.coalesce(c.cast("string"), F.lit("")), ("\r", ""), (" ", " "), (r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"))
    return let(chain(out, (r"(?U)^\s+", ""), (r"(?U)\s+$", "")), lambda x: F.when(x != "", x))


def distinct_texts(a: Column) -> Column:
    """Distinct non-empty squeezed values of an array, in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), squeeze), lambda x: x != ""))


#: Elements that end a line, and the character references that are decoded, in order.
LINE_ENDS = "p|li|h[1-6]|div|tr|table|ul|ol"
REFERENCES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&#x27;", "'")]


def html_lines(c: Column, line_ends: str = LINE_ENDS, drop_code: bool = True, references=tuple(REFERENCES)) -> Column:
    """HTML as lines of text: ends of blocks break lines, tags go, empty lines go."""
    code = [(r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " ")] if drop_code else []
    out = chain(F.coalesce(c, F.lit("")), *code, (r"(?i)<br\s*/?>", "\n"), (rf"(?i)</(?:{line_ends})>", "\n"), (r"<[^>]+>", " "), *references)
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), squeeze), lambda x: x != ""), "\n")


def legacy_html_lines(c: Column) -> Column:
    """The older variant: code stays, rows of tables do not break lines, one reference fewer."""
    return html_lines(c, "p|li|h[1-6]|div|ul|ol", False, (*REFERENCES[:5], ("&#39;", "'")))


def emails(c: Column, most: int | None = 20) -> Column:
    """Distinct lower-case e-mail addresses in order: the first ``most``, as a listing holds, or all."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({EMAIL})"), F.lit(1)), F.lower))
    return found if most is None else F.slice(found, 1, most)


def is_email(c: Column) -> Column:
    return F.size(emails(c)) == 1


def _forms(kind: str):
    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(kind, x))

    return form


def nfkc(c: Column) -> Column:
    return _forms("NFKC")(c)


def nfkd(c: Column) -> Column:
    return _forms("NFKD")(c)


#: Letters and digits that are written in more than one way.
LETTERS = ("يىكة", "ییکه")
EASTERN = ("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
NOISE = r"re[ -]*announced|urgent|new|position title"


def fold_digits(c: Column) -> Column:
    return F.translate(c, *EASTERN)


def word(pattern: str) -> str:
    """A pattern between ASCII word boundaries, whatever the script around it."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def comparable(c: Column, compatibility: bool = True) -> Column:
    """Text folded for comparison: compatibility forms, case, letter and digit variants, noise phrases, punctuation."""
    out = squeeze(c)
    out = F.lower(nfkc(out) if compatibility else out)
    out = rx(F.translate(out, *LETTERS), "ـ", "")
    out = fold_digits(rx(out, f"(?i){word(NOISE)}", " "))
    return squeeze(rx(out, r"[\p{P}\p{S}]+", " "))


def company_key(c: Column, compatibility: bool = True) -> Column:
    return comparable(rx(F.coalesce(c, F.lit("")), r"\([^)]*\)", " "), compatibility)


def location_key(c: Column, compatibility: bool = True) -> Column:
    return squeeze(rx(comparable(c, compatibility), word("afghanistan|province"), " "))


#: Technical names that are written out as words, each with a text that must stand there (in lower case).
WRITTEN_OUT = [
    (".net", [(f"(?i){word('asp[.]net')}", " asp net "), (r"(?i)(^|[\s(/])\.net(?=$|[\s),/])", "$1 dotnet ")]),
    ("c++", [(r"(?<![a-z0-9_])c\+\+(?=$|[^\p{L}\p{N}])", " c plus plus ")]),
    ("c#", [(r"(?<![a-z0-9_])c#(?=$|[^\p{L}\p{N}])", " c sharp ")]),
]


def phrase_tokens(c: Column, compatibility: bool = True) -> Column:
    """Letters and digits of a text as lower-case words, with a few technical names written out.

    Patterns that look around them are slow on long texts, so a plain search decides whether they are tried.
    """

    def written_out(x: Column, sign: str, steps: list[tuple[str, str]]) -> Column:
        return let(x, lambda t: F.when(F.contains(t, F.lit(sign)), chain(squeeze(t), *steps)).otherwise(t))

    out = F.lower(nfkc(squeeze(c)) if compatibility else F.coalesce(c.cast("string"), F.lit("")))
    for sign, steps in WRITTEN_OUT:
        out = written_out(out, sign, steps)
    return F.trim(rx(F.replace(out, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " "))


def phrases_in(tokens: Column, phrases: list[str]) -> Column:
    """Those of ``phrases`` (tokens already) that stand in the tokens as whole words, in the lexicon's order.

    The lexicon is a literal array: its size is fixed when the plan is made.
    """
    known = F.array(*[F.lit(p) for p in phrases if p]).cast("array<string>")
    return let(F.concat(F.lit(" "), tokens, F.lit(" ")), lambda framed: F.filter(known, lambda p: F.contains(framed, F.concat(F.lit(" "), p, F.lit(" ")))))


def contains_phrase(tokens: Column, phrase: str) -> Column:
    return F.contains(F.concat(F.lit(" "), tokens, F.lit(" ")), F.lit(f" {phrase} "))


def clauses(c: Column) -> Column:
    """Clauses of a text: lines, sentences and bullet points; short degree names keep their full stops out of it."""
    joined = rx(F.coalesce(c, F.lit("")), r"(?i)(?<![A-Za-z0-9_])([bm])\s*\.\s*(s|sc)\s*\.", "$1$2")
    return F.filter(F.transform(F.split(joined, r"[\r\n;!?•]+|\.(?:\s+|$)"), squeeze), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def key_text(c: Column) -> Column:
    """A field name for comparison: lower case, ``_`` and ``-`` as blanks."""
    return squeeze(rx(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[_-]+", " "))


def label_text(c: Column) -> Column:
    """An ASCII label for comparison."""
    return squeeze(rx(rx(F.lower(F.coalesce(c, F.lit(""))), "&", " and "), "[^a-z0-9]+", " "))


def slug(index: Column, title: Column, most: int = 70) -> Column:
    words = chain(F.lower(nfkd(squeeze(title))), ("[^a-z0-9]+", "-"), ("^-+|-+$", ""))
    return F.concat_ws("-", index.cast("string"), F.coalesce(F.nullif(F.substring(words, 1, most), F.lit("")), F.lit("role")))


def subject_text(c: Column) -> Column:
    """An e-mail subject without quotes around and stops behind it; null if shorter than 2 or longer than 220."""
    out = F.trim(chain(squeeze(c), ('^["\'“”]+|["\'“”]+$', ""), ("[.;]+$", "")))
    return let(out, lambda x: F.when(F.length(x).between(2, 220), x))


#: What fields hold when nobody filled them in.
PLACEHOLDERS = r"(?i)^(?:n/?a|none|null|nil|unknown|not (?:available|applicable|specified|provided)|[-–—]+)$"


def metadata(c: Column) -> Column:
    return let(or_null(c), lambda x: F.when(~x.rlike(PLACEHOLDERS), x))


def title_label(c: Column) -> Column:
    """A field name as a heading."""
    return F.initcap(key_text(c))


def escape_html(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(ref))
    return out


def split_labels(a: Column) -> Column:
    """Labels of an array of texts, split at commas and bars."""
    return F.flatten(F.transform(a, lambda x: F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "[,|]"), squeeze), lambda y: y != "")))


def tech_labels(a: Column, most: int = 4, longest: int = 48) -> Column:
    """The first ``most`` labels, distinct but for case, none longer than ``longest``."""
    short = F.filter(split_labels(a), lambda x: F.length(x) <= longest)
    first = let(short, lambda s: F.filter(s, lambda x, i: F.array_position(F.transform(s, F.lower), F.lower(x)) == i + 1))
    return F.slice(first, 1, most)


def csv_cell(c: Column) -> Column:
    """A CSV cell that no spreadsheet runs as a formula."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    safe = F.when(text.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)
