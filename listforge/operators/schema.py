"""The canonical listing row, and helpers for raw rows that lack some of its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTING = (
    "id string, source string, source_url string, url string, title string, company string, location string, post_date date, post_date_raw string, "
    "closing_date date, closing_date_raw string, category string, job_type string, gender string, vacancies string, salary string, "
    "application_method string, application_subject string, application_subject_type string, apply_url string, apply_emails array<string>, "
    "apply_phones array<string>, description string, details map<string,string>, scraped_at timestamp, first_seen_at timestamp, last_seen_at timestamp, "
    "active boolean, lifecycle_status string, missed_runs int, "
    "relevance struct<version:int,score:double,threshold:double,decision:string,reasons:array<string>>, also_found_on array<struct<source:string,url:string>>"
)
COLUMNS = [x.strip().split(" ")[0] for x in LISTING.replace("<version:int,score:double,threshold:double,decision:string,reasons:array<string>>", "").replace("<struct<source:string,url:string>>", "").replace("map<string,string>", "map").split(",")]
#: Types of the columns of raw rows that are not plain text.
RAW_TYPES = {
    "apply_emails": "array<string>",
    "apply_phones": "array<string>",
    "details": "map<string,string>",
    "active": "boolean",
    "relevance": "struct<version:int,score:double,threshold:double,decision:string,reasons:array<string>>",
    "also_found_on": "array<struct<source:string,url:string>>",
}
#: Raw rows as they are read: text wherever a feed may hold text or numbers.
RAW = ", ".join(f"{c} {RAW_TYPES.get(c, 'string')}" for c in COLUMNS)
EXTRA = ("education", "requirements", "qualifications", "reference", "vacancy_number", "status", "tech_tags", "specialties", "application_instructions")


def with_columns(df: DataFrame, names=(*COLUMNS, *EXTRA)) -> DataFrame:
    """``df`` with typed nulls for those of ``names`` that it lacks."""
    missing = {c: F.lit(None).cast(RAW_TYPES.get(c, "string")) for c in names if c not in df.columns}
    return df.withColumns(missing) if missing else df


def detail(details: Column, key_pattern: str) -> Column:
    """The value of the first field whose name matches; squeezed, null if empty."""
    from ..functions.text import or_null, squeeze

    found = F.filter(F.map_entries(details), lambda e: squeeze(e["key"]).rlike(key_pattern))
    return or_null(F.get(found, F.lit(0))["value"])


def detail_of(details: Column, *wanted: str) -> Column:
    """The first value that is not blank among the fields named ``wanted``, in that order."""
    from ..functions.text import key_text, let

    def one(name: str) -> Column:
        found = F.filter(F.map_entries(details), lambda e: key_text(e["key"]) == name)
        return let(F.get(found, F.lit(0))["value"], lambda v: F.when(F.trim(v) != "", v))

    return F.coalesce(*[one(w) for w in wanted])
