"""An explainable classifier: phrases of a lexicon found in title, category and text give points and reasons.

Points and order of the signals are fixed; the phrases are an argument.  ``DEFAULT`` is a compact lexicon of
our own with every class of signal; pass another one for other vocabularies.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clauses, contains_phrase, let, phrase_tokens, phrases_in
from .schema import with_columns

VERSION, THRESHOLD = 2, 55


@dataclass
class Lexicon:
    """Phrases by the signal they give, as tokens (lower case, letters and digits)."""

    strong: list[str] = field(default_factory=lambda: "software engineer|software developer|web developer|mobile developer|data engineer|data analyst|data scientist|database administrator|database officer|network engineer|network administrator|system administrator|systems administrator|it officer|it manager|it specialist|it support|ict officer|ict manager|information technology|information systems|cyber security|devops engineer|programmer|computer science|help desk|web designer|full stack|machine learning|mis officer|مهندس نرم افزار|تکنالوژی معلوماتی".split("|"))
    ambiguous: list[str] = field(default_factory=lambda: "technology|technical|digital|data|systems|telecom|information management|electronics|automation|gis".split("|"))
    body_role: list[str] = field(default_factory=lambda: "develop software|maintain servers|administer databases|configure routers|design databases|write code|troubleshoot hardware|manage network|software development|system administration".split("|"))
    support: list[str] = field(default_factory=lambda: "python|java|javascript|sql|linux|php|docker|excel|c sharp|c plus plus|asp net|dotnet|tableau|power bi|cloud|api|server|router|firewall".split("|"))
    not_title: list[str] = field(default_factory=lambda: "accountant|driver|nurse|doctor|midwife|teacher|cashier|cook|guard|cleaner|tailor|civil engineer|finance officer|procurement officer|lawyer|sales officer|electrician|agronomist|librarian".split("|"))
    not_category: list[str] = field(default_factory=lambda: "health|agriculture|education|finance|construction|logistics|human resources|legal".split("|"))
    degree_fields: list[tuple[str, str]] = field(default_factory=lambda: [(x.lower(), x) for x in "Computer Science|Information Technology|Software Engineering|Computer Engineering|Information Systems|Data Science|Cyber Security".split("|")])
    acronyms: list[tuple[str, str]] = field(default_factory=lambda: [("IT", "Information Technology"), ("CS", "Computer Science"), ("ICT", "Information and Communication Technology")])
    compact: list[tuple[str, str]] = field(default_factory=lambda: [("bscs", "Computer Science"), ("bcs", "Computer Science"), ("mscs", "Computer Science"), ("bscit", "Information Technology"), ("bit", "Information Technology")])
    degrees: list[str] = field(default_factory=lambda: "bachelor|bachelors|master|masters|degree|diploma|bsc|msc|bs|ms|graduate|phd".split("|"))
    breakers: list[str] = field(default_factory=lambda: "experience|knowledge of|skills|proficiency|familiarity|ability".split("|"))
    bundle: list[str] = field(default_factory=lambda: "multiple positions|various positions|different positions|several vacancies|lecturers".split("|"))
    bundle_other: list[str] = field(default_factory=lambda: "finance|accounting|law|medicine|nursing|agriculture|economics|civil engineering|pharmacy".split("|"))
    construction: list[str] = field(default_factory=lambda: "construction|concrete|building site|civil works|road works|contractor".split("|"))
    software_quality: list[str] = field(default_factory=lambda: "software testing|test automation|test cases|software quality|selenium".split("|"))
    report_titles: list[str] = field(default_factory=lambda: "mis reporting officer|reporting and mis officer|mis and reporting specialist".split("|"))
    report_duties: list[list[str]] = field(default_factory=lambda: [["maintain the database", "database management"], ["dashboard", "dashboards"], ["data collection tools", "kobo"], ["data analysis", "analyze data"]])


DEFAULT = Lexicon()
#: Points and caps of the signals, in the order of the reasons.
POINTS = {"title": 80, "ambiguous title": 38, "category": 42, "role": 20, "support": 10, "degree": 18, "not title": 25, "hard": 120, "not category": 35}
EDUCATION = r"(?i)education|academic\s+(?:qualification|background)"
REQUIREMENTS = "(?i)qualification|requirement"
REACH = 20


def _values(details: Column, pattern: str) -> Column:
    return F.transform(F.filter(F.map_entries(details), lambda e: e["key"].rlike(pattern)), lambda e: e["value"])


def _texts(*parts: Column) -> Column:
    """Clauses of several texts or arrays of texts."""
    return F.flatten(F.transform(F.array_compact(F.concat(*parts)), clauses))


def _near(framed: Column, phrase: str, marks: list[str], breakers: list[str]) -> Column:
    """Whether a mark stands within ``REACH`` tokens of the phrase, with no breaker between them; tokens between blanks."""
    stop = "|".join(breakers)
    between = rf"(?:(?! (?:{stop}) )(?: [^ ]+)){{0,{REACH - 1}}}? "
    mark = f"(?:{'|'.join(marks)})"
    # the plain search goes first: few clauses hold the phrase at all
    return F.contains(framed, F.lit(f" {phrase} ")) & (framed.rlike(f" {mark}(?={between}{phrase} )") | framed.rlike(f" {phrase}(?={between}{mark} )"))


def degree_field(lex: Lexicon, structured: Column, narrative: Column) -> Column:
    """struct<field, source> of the first computing degree asked for: in fields on education, else near a word for a degree."""

    def alone(raw: Column, low: Column, code: str) -> Column:
        """Whether a short degree name stands alone; "bit" is a word of its own, so only in capitals."""
        if code == "bit":
            return F.contains(raw, F.lit("BIT")) & raw.rlike("(?:^|[^A-Za-z0-9])BIT(?=$|[^A-Za-z0-9])")
        return F.contains(low, F.lit(code)) & raw.rlike(f"(?i)(?:^|[^a-z0-9]){code}(?=$|[^a-z0-9])")

    def label(x: Column, in_education: bool) -> Column:
        """The field that a clause asks for; ``x``: its text, the same in lower case, and its tokens between blanks."""
        options = [F.when(alone(x["raw"], x["low"], code), F.lit(field)) for code, field in lex.compact]
        for name, field in lex.degree_fields:
            here = F.contains(x["tokens"], F.lit(f" {name} ")) if in_education else _near(x["tokens"], name, lex.degrees, lex.breakers)
            options.append(F.when(here, F.lit(field)))
        for name, field in lex.acronyms:
            here = F.contains(x["raw"], F.lit(name)) & x["raw"].rlike(rf"(?:^|[^\p{{L}}\p{{N}}]){name}(?=$|[^\p{{L}}\p{{N}}])")
            options.append(F.when(here if in_education else here & _near(x["tokens"], name.lower(), lex.degrees, lex.breakers), F.lit(field)))
        return F.coalesce(*options)

    def first(texts: Column, in_education: bool) -> Column:
        tokens = lambda raw: F.concat(F.lit(" "), phrase_tokens(raw, compatibility=False), F.lit(" "))
        read = F.transform(_texts(texts), lambda raw: F.struct(raw.alias("raw"), F.lower(raw).alias("low"), tokens(raw).alias("tokens")))
        return F.get(F.array_compact(F.transform(read, lambda x: label(x, in_education))), F.lit(0))

    def chosen(field: Column) -> Column:
        return F.struct(F.coalesce(field["stated"], field["told"]).alias("field"), F.when(field["stated"].isNotNull(), "education requirement").when(field["told"].isNotNull(), "requirements text").alias("source"))

    return let(F.struct(first(structured, True).alias("stated"), first(narrative, False).alias("told")), chosen)


def _reason(name: str, phrase: Column, points: int) -> Column:
    return F.when(phrase.isNotNull(), F.concat(F.lit(f"{name}: “"), phrase, F.lit(f"” (+{points})")))


def assess(df: DataFrame, lex: Lexicon = DEFAULT, into: str = "relevance") -> DataFrame:
    """``df`` with a struct<version, score, threshold, decision, reasons>; the company is never read."""
    c, names = F.col, df.columns
    p = POINTS
    df = with_columns(df, ("title", "category", "description", "details", "education", "requirements", "qualifications"))
    area = F.concat_ws(" ", *[F.nullif(c("details")[k], F.lit("")) for k in ("Functional Area", "Category", "Department", "Job Family")])
    structured = F.concat(F.array(c("education")), F.coalesce(_values(c("details"), EDUCATION), F.array().cast("array<string>")))
    told = F.concat(F.array(c("requirements"), c("qualifications")), F.coalesce(_values(c("details"), REQUIREMENTS), F.array().cast("array<string>")))
    context = F.concat_ws(" ", c("category"), area)
    step = df.withColumns({"_t": phrase_tokens(c("title")), "_c": phrase_tokens(c("category")), "_f": phrase_tokens(area), "_d": phrase_tokens(c("description")), "_cf": phrase_tokens(context), "_deg": degree_field(lex, structured, F.concat(F.array(c("description")), told))})
    edu_tokens = phrase_tokens(F.concat_ws(" ", F.array_join(structured, " ")))
    step = step.withColumns({"_edu": edu_tokens, "_im": F.when(contains_phrase(edu_tokens, "information management"), "education requirement").when(F.exists(F.transform(_texts(told), lambda x: phrase_tokens(x, compatibility=False)), lambda x: contains_phrase(x, "information management") & (F.size(phrases_in(x, lex.degrees)) > 0)), "requirements text")})
    # a reporting title counts as technical with two kinds of technical duties and a degree
    duties = F.array_compact(F.array(*[F.get(phrases_in(c("_d"), g), F.lit(0)) for g in lex.report_duties]))
    gated = c("_t").isin(*lex.report_titles) & (F.size(duties) >= 2) & (c("_deg.field").isNotNull() | c("_im").isNotNull())
    site = phrases_in(F.concat_ws(" ", c("_cf"), c("_edu"), c("_d")), lex.construction)
    quality = phrases_in(F.concat_ws(" ", c("_t"), c("_d")), lex.software_quality)
    builder = contains_phrase(c("_t"), "quality control engineer") & (F.size(site) >= 2) & (F.size(quality) == 0)
    step = step.withColumns({"_gated": gated, "_duties": duties, "_strong": phrases_in(c("_t"), lex.strong), "_not": F.concat(phrases_in(c("_t"), lex.not_title), F.when(builder, F.array(F.lit("construction quality control engineer"))).otherwise(F.array().cast("array<string>")))})
    step = step.withColumn("_strong", F.when(c("_gated") & ~F.array_contains("_strong", c("_t")), F.concat("_strong", F.array("_t"))).otherwise(c("_strong")))
    developer = contains_phrase(c("_t"), "developer") & ~c("_t").rlike("(?:^| )(?:business|community|capacity|career) developer(?: |$)")
    step = step.withColumn("_strong", F.when(developer & (F.size("_strong") == 0), F.array(F.lit("developer role"))).otherwise(c("_strong")))
    step = step.withColumns({"_cat": phrases_in(c("_c"), lex.strong), "_area": phrases_in(c("_f"), lex.strong), "_amb": phrases_in(c("_t"), lex.ambiguous), "_ambc": phrases_in(c("_cf"), lex.ambiguous), "_notc": phrases_in(c("_cf"), lex.not_category), "_role": F.slice(phrases_in(c("_d"), lex.body_role), 1, 2), "_sup": F.slice(phrases_in(c("_d"), lex.support), 1, 3)})
    marks, tech, other = phrases_in(c("_t"), lex.bundle), F.concat("_strong", "_amb", phrases_in(c("_t"), ["technical"])), phrases_in(c("_t"), lex.bundle_other)
    step = step.withColumns({"_hard": (F.size("_not") > 0) & (F.size("_strong") == 0), "_mixed": (F.size(marks) > 0) & (F.size(tech) > 0) & (F.size(other) > 0), "_tech": F.get(tech, F.lit(0)), "_other": F.get(other, F.lit(0))})
    one = lambda name: F.get(c(name), F.lit(0))
    has = lambda name: (F.size(name) > 0).cast("int")
    anywhere = (F.size("_strong") + F.size("_cat") + F.size("_area")) > 0
    context_points = (has("_cat") + has("_area") + has("_ambc") > 0).cast("int") * p["category"]
    score = has("_strong") * p["title"] + has("_amb") * p["ambiguous title"] + context_points + F.size("_role") * p["role"] + F.size("_sup") * p["support"] + c("_deg.field").isNotNull().cast("int") * p["degree"]
    score = score - has("_not") * p["not title"] - (has("_notc") * (~anywhere).cast("int")) * p["not category"]
    final = F.when(c("_hard") | c("_mixed"), F.lit(0)).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), score)))
    penalty = F.when(c("_hard"), p["hard"]).otherwise(p["not title"])
    reasons = F.array_compact(
        F.concat(
            F.array(_reason("title", one("_strong"), p["title"]), _reason("title", one("_amb"), p["ambiguous title"])),
            F.array(F.when(c("_gated"), F.concat(F.lit("MIS reporting evidence gate: enriched duties “"), F.array_join(F.slice("_duties", 1, 2), "”, “"), F.lit("” and "), F.coalesce(c("_deg.source"), c("_im")), F.lit(" “"), F.coalesce(c("_deg.field"), F.lit("Information Management")), F.lit("”")))),
            F.array(F.when(F.size("_cat") > 0, _reason("category", one("_cat"), p["category"])).when(F.size("_area") > 0, _reason("functional area", one("_area"), p["category"])).otherwise(_reason("category/functional area", one("_ambc"), p["category"]))),
            F.transform("_role", lambda x: _reason("description role", x, p["role"])),
            F.transform("_sup", lambda x: _reason("description", x, p["support"])),
            F.array(
                F.when(c("_deg.field").isNotNull(), F.concat(c("_deg.source"), F.lit(": computing degree “"), c("_deg.field"), F.lit(f"” (+{p['degree']})"))),
                F.when(F.size("_not") > 0, F.concat(F.lit("non-technical title: “"), one("_not"), F.lit("” (-"), penalty.cast("string"), F.lit(")"))),
                F.when((F.size("_notc") > 0) & ~anywhere, F.concat(F.lit("non-technical category: “"), one("_notc"), F.lit(f"” (-{p['not category']})"))),
                F.when(c("_mixed"), F.concat(F.lit("mixed multi-vacancy bundle combines technical “"), c("_tech"), F.lit("” and non-technical “"), c("_other"), F.lit("” roles; cannot safely split (-all)"))),
            ),
        )
    )
    none = F.array(F.lit("no technical title, category, functional-area, or supporting signals"))
    decision = F.when(~c("_hard") & ~c("_mixed") & (final >= THRESHOLD), "include").otherwise("exclude")
    out = F.struct(F.lit(VERSION).alias("version"), final.cast("double").alias("score"), F.lit(float(THRESHOLD)).alias("threshold"), decision.alias("decision"), F.when(F.size(reasons) > 0, reasons).otherwise(none).alias("reasons"))
    return step.withColumn(into, out).select(*names, *([into] if into not in names else []))


def include(df: DataFrame) -> DataFrame:
    """Publishable rows: title, url and a decision to include."""
    return df.where("title is not null and url is not null and relevance.decision = 'include'")


def strong_title(df: DataFrame, excluded: str, explicit: list[str], lex: Lexicon = DEFAULT) -> DataFrame:
    """Rows whose title alone is enough: outside the excluded domains, with an explicit pattern, scored by its title."""
    rows = df.where(~F.col("title").rlike(excluded) & F.greatest(*[F.col("title").rlike(p) for p in [*explicit, "$^"]]))
    alone = assess(rows.withColumn("_own", F.struct("title")).withColumn("_keep", F.struct(*rows.columns)).select("title", "_keep"), lex, "_alone")
    return alone.where("_alone.decision = 'include' and exists(_alone.reasons, r -> r like 'title:%')").select("_keep.*")
