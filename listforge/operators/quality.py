"""Rules that a feed and its summary must meet; violations are rows, gates raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contacts
from ..functions.urls import canonical_url, is_web, mail_recipients
from .schema import with_columns

METHODS = ("email", "web", "phone", "unknown")
SUBJECTS = ("exact", "reference", "title_template")
DROP_PERCENT = 35


class InvalidFeed(ValueError):
    """What a gate found; the message lists the first violations."""


def is_day(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(text.rlike(r"^20\d\d-\d\d-\d\d$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def is_instant(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(c.cast("string")).isNotNull(), F.lit(False))


def is_url(c: Column) -> Column:
    return is_web(c) | F.coalesce(F.size(mail_recipients(c)) > 0, F.lit(False))


def filled(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def _optional(c: Column, rule: Column) -> Column:
    return c.isNull() | rule


def rules(today: str) -> list[tuple[str, str, Column]]:
    """(rule, severity, what holds for a valid row)."""
    c = F.col
    r = c("relevance")
    out = [(f"{n} is missing", "error", filled(c(n))) for n in ("id", "source", "title", "url", "source_url")]
    out += [(f"{n} is no url", "error", _optional(c(n), is_url(c(n)))) for n in ("url", "source_url", "apply_url")]
    out += [(f"{n} is no day", "error", _optional(c(n), is_day(c(n)))) for n in ("post_date", "closing_date")]
    out += [(f"{n} is no instant", "error", is_instant(c(n))) for n in ("scraped_at", "first_seen_at", "last_seen_at")]
    return out + [
        ("first seen after last seen", "error", F.coalesce(c("first_seen_at") <= c("last_seen_at"), F.lit(True))),
        ("application method is unknown to the schema", "error", F.coalesce(c("application_method").isin(*METHODS), F.lit(False))),
        ("subject type is unknown to the schema", "error", _optional(c("application_subject_type"), c("application_subject_type").isin(*SUBJECTS))),
        ("subject type without a subject", "error", c("application_subject_type").isNull() | filled(c("application_subject"))),
        ("an e-mail address is empty", "error", F.forall(F.coalesce("apply_emails", F.array().cast("array<string>")), filled)),
        ("a phone number is empty", "error", F.forall(F.coalesce("apply_phones", F.array().cast("array<string>")), filled)),
        ("method email without an address", "error", (c("application_method") != "email") | (F.size("apply_emails") > 0) | (F.size(mail_recipients(c("apply_url"))) > 0)),
        ("method web without a link", "error", (c("application_method") != "web") | is_web(c("apply_url"))),
        ("method phone without a number", "error", (c("application_method") != "phone") | (F.size("apply_phones") > 0)),
        ("missed runs are negative", "error", F.coalesce(c("missed_runs").cast("int") >= 0, F.lit(True))),
        ("lifecycle status is missing", "error", filled(c("lifecycle_status"))),
        ("relevance is missing", "error", r.isNotNull()),
        ("score out of range", "error", r.isNull() | r["score"].between(0, 100)),
        ("decision is unknown to the schema", "error", r.isNull() | r["decision"].isin("include", "exclude")),
        ("decision does not follow from the score", "error", r.isNull() | (r["decision"] != "include") | (r["score"] >= r["threshold"])),
        ("no reasons", "error", r.isNull() | (F.size(r["reasons"]) > 0)),
        ("excluded row is published", "error", r.isNull() | (r["decision"] == "include")),
        ("expired", "warning", c("closing_date").isNull() | (c("closing_date").cast("string") >= today)),
        ("company is missing", "warning", filled(c("company"))),
        ("description is missing", "warning", filled(c("description"))),
    ]


def check_rows(df: DataFrame, checks: list[tuple[str, str, Column]], key: str) -> DataFrame:
    """(key, rule, severity) of every rule that a row breaks: one pass, no shuffle."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, severity, ok in checks]))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("v")).select("key", "v.rule", "v.severity")


def duplicates(df: DataFrame, by: Column, rule: str) -> DataFrame:
    return df.groupBy(by.cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1 and key is not null and key <> ''").select("key", F.lit(rule).alias("rule"), F.lit("error").alias("severity"))


def violations(df: DataFrame, today: str) -> DataFrame:
    """Violations of a feed: row rules, repeated ids, repeated canonical urls."""
    rows = with_columns(df)
    return check_rows(rows, rules(today), "id").unionByName(duplicates(rows, F.col("id"), "id is not unique")).unionByName(duplicates(rows, canonical_url(F.coalesce("source_url", "url")), "url is not unique"))


def metrics(df: DataFrame, today: str) -> DataFrame:
    """One row: jobs, sources, expired rows, rows with relevance."""
    return df.agg(F.count("*").alias("jobs"), F.count_distinct("source").alias("sources"), F.count_if(F.col("closing_date").cast("string") < today).alias("expired"), F.count("relevance").alias("assessed"))


def validate(df: DataFrame, today: str, min_jobs: float = 1, min_sources: float = 1, max_expired: float | None = None, require_relevance: bool = True) -> None:
    """Raises ``InvalidFeed`` if rows break a rule or the feed its limits; rows without relevance do unless it is not required."""
    m = metrics(df, today).first()
    wrong = violations(df, today).where("severity = 'error'")
    wrong = wrong if require_relevance else wrong.where("rule <> 'relevance is missing'")
    found = [f"{r.key}: {r.rule}" for r in wrong.orderBy("rule", "key").limit(20).collect()]
    if m.jobs < min_jobs:
        found.append(f"{m.jobs} jobs, {min_jobs} are needed")
    if m.sources < min_sources:
        found.append(f"{m.sources} sources, {min_sources} are needed")
    if max_expired is not None and m.expired > max_expired:
        found.append(f"{m.expired} expired jobs, {max_expired} are allowed")
    if found:
        raise InvalidFeed("; ".join(found))


def method_of() -> Column:
    """The channel that a row's own fields give it, by the rule for merged rows."""
    c = F.col
    some = lambda n: F.size(F.coalesce(c(n), F.array().cast("array<string>"))) > 0
    mailto = F.coalesce(F.size(mail_recipients(c("apply_url"))) > 0, F.lit(False))
    return contacts.merged_method(c("application_method"), mailto, some("apply_emails") | mailto, is_web(c("apply_url")), some("apply_phones"))


def output_rules() -> list[tuple[str, str, Column]]:
    """What must hold for every row before it is published, beside the rules of a feed."""
    c = F.col
    r = c("relevance")
    return [
        *((f"{n} is missing", "error", filled(c(n))) for n in ("title", "company", "source", "url")),
        ("relevance does not include the row", "error", (r["decision"] == "include") & (r["score"] >= r["threshold"])),
        ("application method does not follow from its fields", "error", c("application_method") == method_of()),
        *((f"{n} is no day", "error", _optional(c(n), is_day(c(n)))) for n in ("post_date", "closing_date")),
    ]


def assert_output(df: DataFrame, had_input: bool) -> None:
    """Raises ``InvalidFeed`` where the rows must not replace what is published; an empty result of some input too."""
    rows = with_columns(df)
    if had_input and rows.isEmpty():
        raise InvalidFeed("there was input, and nothing is left of it")
    broken = check_rows(rows, output_rules(), "url").unionByName(duplicates(rows, canonical_url(F.coalesce("source_url", "url")), "url is not unique"))
    found = [f"{r.key}: {r.rule}" for r in broken.orderBy("rule", "key").limit(20).collect()]
    if found:
        raise InvalidFeed("; ".join(found))


def lost_references(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """(key) of rows whose reference is not there, each once for every row."""
    return rows.join(known.select(F.col(known_key).alias("_known")), rows[key] == F.col("_known"), "left_anti").select(F.col(key).cast("string").alias("key"))


def differing_counts(said: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """(key, said, there) where two tables count a key differently; one that a table lacks counts nothing."""
    a, b = (d.groupBy(F.col(key).alias("key")).agg(F.count("*").alias(n)) for d, n in ((said, "said"), (there, "there")))
    return a.join(b, "key", "full_outer").na.fill(0, ["said", "there"]).where("said <> there")


def completeness(*columns: Column) -> Column:
    """How many of the columns are filled."""
    return sum((filled(c).cast("int") for c in columns), F.lit(0))


def least_allowed(base: Column, percent: float = DROP_PERCENT) -> Column:
    return F.ceil(base * (1 - percent / 100))


def check_baseline(current: int, base: int, percent: float = DROP_PERCENT) -> None:
    least = -int(-(base * (100 - percent)) // 100)
    if current < least:
        raise InvalidFeed(f"{current} jobs, at least {least} are expected after {base}")


def summary_violations(summary: DataFrame, feed: DataFrame) -> DataFrame:
    """(key, rule) of a one-row summary against its feed: counts, ids, sources."""
    lists = ("new", "expiring_today", "expiring_soon", "banking_tech")
    sizes = [F.when(F.col(f"{n}_count") != F.size(f"{n}_ids"), F.struct(F.lit(n).alias("key"), F.lit("count differs from its list").alias("rule"))) for n in lists]
    out = summary.select(F.explode(F.array_compact(F.array(*sizes))).alias("v")).select("v.*")
    ids = summary.select(F.explode(F.concat(*[F.col(f"{n}_ids") for n in lists])).alias("id"))
    out = out.unionByName(lost_references(ids.distinct(), "id", feed, "id").select("key", F.lit("id is not in the feed").alias("rule")))
    for n in lists:
        twice = summary.select(F.explode(f"{n}_ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
        out = out.unionByName(twice.select(F.col("id").alias("key"), F.lit(f"id stands twice in {n}").alias("rule")))
    said = summary.select(F.explode("sources").alias("s")).select("s.name", F.col("s.count").alias("said"))
    there = feed.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("there"))
    differ = said.join(there, "name", "full_outer").where("coalesce(said, 0) <> coalesce(there, 0)")
    return out.unionByName(differ.select(F.col("name").alias("key"), F.lit("source count differs").alias("rule")))
