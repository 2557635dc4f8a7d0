"""What changed since the last run, in one row, and the digest that is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import escape_html, squeeze
from ..functions.urls import canonical_url
from .schema import detail

SCHEMA_VERSION, TOP = 2, 5
#: Patterns for rows of banks and for technical roles.
BANKING = r"(?i)(?<![a-z])(?:banks?|banking|microfinance|mobile money|financial institution)(?![a-z])"
TECH = r"(?i)(?<![a-z])(?:it|ict|software|developer|programmer|network|systems?|database|data|cyber ?security|technology|digital)(?![a-z])"


def identity_tokens() -> Column:
    """What a row is known by: its id and urls, alternative ones among them."""
    links = F.concat(F.array("url", "source_url"), F.coalesce(F.transform("also_found_on", lambda x: x["url"]), F.array().cast("array<string>")))
    return F.array_distinct(F.concat(F.when(squeeze(F.col("id")) != "", F.array(F.concat(F.lit("id|"), "id"))).otherwise(F.array().cast("array<string>")), F.filter(F.transform(links, lambda u: F.concat(F.lit("url|"), F.nullif(canonical_url(u), F.lit("")))), lambda t: t.isNotNull())))


def new_rows(current: DataFrame, previous: DataFrame, key: str = "id") -> DataFrame:
    """Rows none of whose tokens was there before."""
    tokens = current.select(F.col(key).alias("_key"), F.explode(identity_tokens()).alias("token"))
    known = tokens.join(previous.select(F.explode(identity_tokens()).alias("token")).distinct(), "token", "left_semi").select("_key").distinct()
    return current.join(known, current[key] == known["_key"], "left_anti")


def source_summary(df: DataFrame) -> DataFrame:
    seen = F.coalesce(*[F.try_to_timestamp(F.col(n).cast("string")) for n in ("last_seen_at", "scraped_at", "first_seen_at")])
    return df.groupBy(F.coalesce("source", F.lit("unknown")).alias("name")).agg(F.count("*").alias("count"), F.min(seen).alias("oldest_seen_at"), F.max(seen).alias("latest_seen_at")).orderBy("name")


def is_banking_tech() -> Column:
    area = detail(F.col("details"), r"(?i)^functional area$")
    industry = detail(F.col("details"), r"(?i)^industry$")
    return F.concat_ws(" ", "company", "category", area, industry).rlike(BANKING) & F.concat_ws(" ", "title", "category", area).rlike(TECH)


def summarize(current: DataFrame, previous: DataFrame, today: str, generated_at: str, order: str = "position") -> DataFrame:
    """One row: totals, four counts with their ids in the feed's order, and a struct for each source.

    ``order``: a column of ``current`` with each row's place in the feed.
    """
    days = F.datediff(F.col("closing_date"), F.lit(today).cast("date"))
    fresh = new_rows(current, previous).select("id").distinct().withColumn("_new", F.lit(True))
    marked = current.join(fresh, "id", "left")
    rules = {"new": F.coalesce("_new", F.lit(False)), "expiring_today": F.coalesce(days == 0, F.lit(False)), "expiring_soon": F.coalesce(days.between(1, 3), F.lit(False)), "banking_tech": is_banking_tech()}
    aggs = []
    for name, rule in rules.items():
        ids = F.transform(F.array_sort(F.collect_list(F.when(rule, F.struct(order, "id")))), lambda x: x["id"])
        aggs += [F.count_if(rule).alias(f"{name}_count"), ids.alias(f"{name}_ids")]
    one = marked.agg(F.count("*").alias("total"), *aggs)
    per = source_summary(current).agg(F.array_sort(F.collect_list(F.struct("name", "count", "oldest_seen_at", "latest_seen_at"))).alias("sources"))
    return one.crossJoin(per).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(generated_at).alias("generated_at"), F.lit(today).alias("today"), "*")


def hydrate(summary: DataFrame, feed: DataFrame, ids: str) -> DataFrame:
    """The rows a summary's list names, in its order; raises if one is missing."""
    wanted = summary.select(F.posexplode(ids).alias("position", "id"))
    lost = wanted.join(feed.select("id"), "id", "left_anti").count()
    if lost:
        raise ValueError(f"{lost} ids of {ids} are not in the feed")
    return wanted.join(feed, "id").orderBy("position")


def top_in_groups(df: DataFrame, group: str, order: list[Column], top: int = TOP) -> DataFrame:
    """The first rows of each group with their place, and how many more it has."""
    place = Window.partitionBy(group).orderBy(*order)
    first = df.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top)  # kept before the shuffle
    size = df.groupBy(group).agg(F.greatest(F.count("*") - top, F.lit(0).cast("long")).alias("more"))
    return first.join(size, group)


def digest(sections: list[tuple[str, DataFrame, int]], generated_at: str, top: int = TOP) -> str:
    """The HTML of a whole digest: its sections that have rows, or that there is nothing new."""
    parts = [digest_section(title, rows, total, top) for title, rows, total in sections if total]
    return f"<html><body><p>{generated_at}</p>{''.join(parts) or '<p>Nothing new</p>'}</body></html>"


def digest_section(title: str, rows: DataFrame, total: int, top: int = TOP) -> str:
    """HTML of a section: the first rows, and how many more there are; the driver sees ``top`` rows."""
    shown = rows.limit(top).select(escape_html(F.col("title")).alias("title"), escape_html(F.col("company")).alias("company"), escape_html(F.col("url")).alias("url")).collect()
    items = "".join(f'<li><a href="{r.url}">{r.title}</a> {r.company}</li>' for r in shown)
    more = f"<p>and {total - len(shown)} more</p>" if total > len(shown) else ""
    return f"<h2>{title} ({total})</h2><ul>{items}</ul>{more}"
