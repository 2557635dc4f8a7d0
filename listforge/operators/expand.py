"""Splits a listing that describes several numbered positions into one row for each.

A heading is a numbered line with a count of openings, on the line itself or in one of the three lines that
follow before the next numbered line.  With two headings at least, each gives a row: the text before the first
one, its own lines, and the requirements that end the text for all.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from ..functions.urls import with_param
from .normalize import NEEDS_REFERENCE, NEEDS_TITLE, normalize
from .schema import COLUMNS, RAW_TYPES

#: Forms of headings, counts, references, common endings and divisions.
NUMBERED = re.compile(r"(\d{1,2})[.)]\s+(.+?)(?:\s+[–—-]\s*(\d+)\s+(?:openings?|positions?|vacancies))?\s*", re.I)
COUNTED = re.compile(r"(?:no\.?\s+of\s+jobs?|openings?|positions?|vacancies)\s*:\s*(\d+)\b", re.I)
REFERENCE = re.compile(r"^reference(?:\s+(?:number|no\.?|id))?\s*:\s*(.+)$", re.I | re.M)
COMMON_END = re.compile(r"^(?:general\s+)?job\s+requirements?|submission\s+guidelines?$", re.I)
DIVISION = re.compile(r"[IVXLCDM]+\.\s+\S.+")
ROLE = "array<struct<number:int,title:string,openings:int,reference:string,text:string>>"


def positions(text: str | None) -> list[dict]:
    """The numbered positions of a text, none if there are fewer than two."""
    lines = [x for x in (" ".join(line.split()) for line in re.split(r"\r\n?|\n", text or "")) if x]
    numbered = {i: m for i, line in enumerate(lines) if (m := NUMBERED.fullmatch(line))}
    heads = []
    for i, m in numbered.items():
        openings = int(m[3] or 0)
        for k in range(i + 1, min(i + 4, len(lines))):
            if openings or k in numbered:
                break
            if counted := COUNTED.match(lines[k]):
                openings = int(counted[1])
                break
        if openings > 0 and len(m[2]) >= 3:
            heads.append((i, int(m[1]), m[2].rstrip(" :;.,"), openings))
    if len(heads) < 2:
        return []
    end = next((i for i in range(heads[-1][0] + 1, len(lines)) if COMMON_END.search(lines[i])), len(lines))
    out = []
    for (i, number, title, openings), stop in zip(heads, [h[0] for h in heads[1:]] + [end], strict=True):
        own = lines[i:stop]
        while own and DIVISION.fullmatch(own[-1]):
            own.pop()
        body = "\n".join(own)
        reference = REFERENCE.search(body)
        parts = ["\n".join(lines[: heads[0][0]]), f"Position-specific details\n{body}", "\n".join(lines[end:])]
        out.append({"number": number, "title": title, "openings": openings, "reference": " ".join(reference[1].split()) if reference else None, "text": "\n\n".join(p for p in parts if p)})
    return out


def _all_positions(s: pd.Series) -> pd.Series:
    return s.map(positions)


def numbered_positions(c) -> Column:
    return F.pandas_udf(_all_positions, ROLE)(c)


def expand(df: DataFrame, now: str) -> DataFrame:
    """Canonical listings; a listing of several numbered positions becomes a row for each, with its own id, url and reference."""
    c = F.col
    rows = normalize(df, now).withColumn("_roles", numbered_positions("description"))
    alone = rows.where(F.size("_roles") == 0).select(*COLUMNS)
    split = rows.where(F.size("_roles") > 0).withColumn("_role", F.explode("_roles"))
    role = lambda name: c(f"_role.{name}")
    mark = slug(role("number"), role("title"))
    line = F.get(F.filter(F.split(F.coalesce(c("description"), F.lit("")), "\n+"), lambda x: x.rlike("(?i)subject")), F.lit(0))
    by_title, by_reference = line.rlike(NEEDS_TITLE), line.rlike(NEEDS_REFERENCE)
    own = role("reference").isNotNull()
    subject = F.when(own & by_title & by_reference, F.concat_ws(" + ", role("title"), role("reference"))).when(own & (by_reference | (c("application_subject_type") == "reference")), role("reference")).otherwise(c("application_subject"))
    kind = F.when(own & by_title & by_reference, "title_template").when(own & (by_reference | (c("application_subject_type") == "reference")), "reference").otherwise(c("application_subject_type"))
    numbered = F.map_contains_key("details", F.lit("Vacancy Number"))
    parent = F.coalesce(c("details")["Reference"], c("details")["Vacancy Number"], c("title"))
    added = F.map_filter(
        F.create_map(
            F.lit("Parent Listing Title"), c("title"), F.lit("Bundled Role"), role("title"), F.lit("Role Vacancies"), role("openings").cast("string"),
            F.lit("Role Extraction"), F.lit("Structured numbered position from a multi-vacancy listing"), F.lit("Role Reference"), role("reference"),
            F.lit("Vacancy Number"), F.when(own & numbered, role("reference")),
            F.lit("Reference"), F.when(own & ~numbered, role("reference")).when(~own, F.concat(parent, F.lit(" / role "), role("number").cast("string"))),
        ),
        lambda k, v: v.isNotNull(),
    )
    kept = F.map_filter("details", lambda k, v: ~F.map_contains_key(added, k))
    values = {
        "id": F.lit(None).cast("string"), "source_url": with_param(F.coalesce("source_url", "url"), "role", mark), "url": with_param(F.coalesce("url", "source_url"), "role", mark), "title": role("title"),
        "vacancies": role("openings").cast("string"), "description": role("text"), "details": F.map_concat(kept, added), "application_subject": subject, "application_subject_type": kind,
        "relevance": F.lit(None).cast(RAW_TYPES["relevance"]), "also_found_on": F.array().cast(RAW_TYPES["also_found_on"]),
    }
    roles = split.select(*[values.get(n, c(n)).alias(n) for n in COLUMNS])
    return alone.unionByName(normalize(roles, now))
