"""A Python data source over a paginated JSON listing, one partition a page, and enrichment with failure accounting."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.window import Window

from ..functions.numbers import salary_from_fields
from ..functions.text import html_lines, or_null
from .http import fetch

PAGE_SIZE, MOST_PAGES = 100, 50
LISTING = "id long, slug string, title string, area_id long, page int, position int, payload string"


class BrokenListing(ValueError):
    """A listing that cannot be read as a whole; never taken for a shorter one."""


class PagePartition(InputPartition):
    def __init__(self, page: int, total: int):
        self.page, self.total = page, total


def checked_page(body, page: int, limit: int = MOST_PAGES) -> tuple[list[dict], int]:
    """(rows, pages in all) of a page's answer; raises where it is malformed, or hides how many pages there are."""
    rows = body.get("data") if isinstance(body, dict) else None
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise BrokenListing(f"page {page} holds no list of records")
    said = str((body.get("meta") or {}).get("totalPages", ""))
    if said.isdigit() and int(said) > 0:
        total = max(page, int(said))
    elif len(rows) >= PAGE_SIZE:
        raise BrokenListing(f"page {page} is full and does not say how many pages there are")
    else:
        total = page
    if total > limit:
        raise BrokenListing(f"the listing has {total} pages, {limit} are allowed")
    return rows, total


class PagedReader(DataSourceReader):
    """``url`` is a template with {page} and {size}; {areas} takes the pushed-down filter on area_id.

    ``limit`` is the number of pages allowed: a longer listing is an error, as is one that is malformed, does not
    say how long it is, has an empty page before its end or grows while it is read.
    """

    def __init__(self, options: dict):
        self.url, self.pages, self.limit = options["url"], int(options.get("pages", 0)), int(options.get("limit", MOST_PAGES))
        self.areas: list[int] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("area_id",):
                self.areas = [f.value]
            elif isinstance(f, In) and f.attribute == ("area_id",):
                self.areas = list(f.value)
            yield f  # Spark checks the rows again

    def _get(self, page: int) -> dict:
        return json.loads(fetch(self.url.format(page=page, size=PAGE_SIZE, areas=",".join(map(str, self.areas)))))

    def partitions(self):
        total, seen = self.pages or 1, 0
        # the last page known is read until it names no later one
        while not self.pages and seen < total:
            seen = total
            total = checked_page(self._get(total), total, self.limit)[1]
        if total > self.limit:
            raise BrokenListing(f"the listing has {total} pages, {self.limit} are allowed")
        return [PagePartition(p, total) for p in range(1, total + 1)]

    def read(self, partition):
        rows, total = checked_page(self._get(partition.page), partition.page, self.limit)
        if not self.pages and total > partition.total:
            raise BrokenListing(f"the listing grew from {partition.total} to {total} pages while it was read")
        if not rows and partition.page < partition.total:
            raise BrokenListing(f"page {partition.page} of {partition.total} is empty")
        for i, row in enumerate(rows):
            yield row.get("id"), row.get("slug"), row.get("title"), row.get("areaId"), partition.page, i, json.dumps(row)


class PagedListing(DataSource):
    """After ``register(spark)``: ``spark.read.format("paged_listing").option("url", template)``."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters pushed to its reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedListing)


def stable_key() -> Column:
    return F.coalesce(or_null(F.col("slug")), F.col("id").cast("string"))


def page_problems(rows: DataFrame) -> DataFrame:
    """(page, problem): pages that repeat an earlier page's rows in any order, or bring no new row."""
    keyed = rows.withColumn("url", stable_key())
    prints = keyed.groupBy("page").agg(F.sha1(F.array_join(F.array_sort(F.collect_set("url")), "\n")).alias("print"))
    repeated = prints.join(prints.groupBy("print").agg(F.min("page").alias("first")), "print").where("page > first").select("page", F.lit("repeats an earlier page").alias("problem"))
    new = keyed.groupBy("url").agg(F.min("page").alias("page")).select("page").distinct()
    return repeated.unionByName(prints.join(new, "page", "left_anti").select("page", F.lit("no new row").alias("problem")))


def read_listing(spark: SparkSession, url: str, **options) -> DataFrame:
    """All rows of a listing, read once; raises ``BrokenListing`` where its pages repeat or bring nothing new."""
    reader = spark.read.format("paged_listing").option("url", url)
    for k, v in options.items():
        reader = reader.option(k, v)
    rows = reader.load().checkpoint()
    problems = [f"page {r.page} {r.problem}" for r in page_problems(rows).orderBy("page").limit(5).collect()]
    if problems:
        raise BrokenListing("the listing stalled: " + "; ".join(problems))
    return rows


def last_pages(pages: DataFrame) -> DataFrame:
    """(page, last, known): the highest page number that each page and all before it link to.

    ``pages`` (page, linked); a link to no later page than the one read does not tell where the listing ends.
    """
    order = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as a crawl has pages
    later = F.when(F.col("linked") > F.col("page"), F.col("linked"))
    return pages.withColumn("known", F.max(later).over(order)).select("page", F.greatest("known", F.when(F.col("known").isNotNull(), F.col("linked"))).alias("last"), F.col("known").isNotNull().alias("known"))


def areas_for(categories: str, areas: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Ids of the areas that a comma-separated list of categories names, directly or by an alias."""
    from ..functions.text import label_text

    spark = areas.sparkSession
    wanted = [name for x in map(str.strip, categories.split(",")) if x for name in aliases.get(x.lower(), [x])]
    names = spark.createDataFrame([(w,) for w in wanted], "label string").select(label_text(F.col("label")).alias("label")).distinct()
    return areas.select("id", label_text(F.col("name")).alias("label")).join(F.broadcast(names), "label").select("id").distinct()


def known(rows: DataFrame, published: DataFrame) -> DataFrame:
    """Rows whose url is not published yet."""
    return rows.join(published.select("url"), "url", "left_anti")


def records(details: DataFrame, payload: str = "payload") -> DataFrame:
    """Raw rows out of detail payloads (JSON text) of the listing API."""
    c = F.get_json_object
    p = F.col(payload)
    parts = [F.when(html_lines(c(p, f"$.{k}")) != "", F.concat_ws("\n", F.lit(t), html_lines(c(p, f"$.{k}")))) for k, t in (("about", "About"), ("duties", "Duties"), ("requirements", "Requirements"), ("guidelines", "Submission guidelines"))]
    names = F.from_json(c(p, "$.provinces"), "array<struct<name:string>>")
    places = F.transform(names, lambda x: x["name"])
    keys = {"Reference": "$.reference", "Functional Area": "$.area.name", "Industry": "$.industry.name", "Education": "$.education", "Experience": "$.experience", "Nationality": "$.nationality", "Contract Duration": "$.duration", "Probation Period": "$.probation", "Gender": "$.gender", "Announcement Date": "$.publishedAt"}
    details_map = F.map_filter(F.create_map(*[x for k, path in keys.items() for x in (F.lit(k), c(p, path))]), lambda k, v: v.isNotNull())
    return details.select(
        c(p, "$.url").alias("url"), c(p, "$.title").alias("title"), c(p, "$.company.name").alias("company"), F.when(F.size(places) > 1, "Multi Location").otherwise(F.array_join(places, ", ")).alias("location"),
        c(p, "$.closingDate").alias("closing_date"), c(p, "$.area.name").alias("category"), c(p, "$.vacancies").alias("vacancies"),
        salary_from_fields(c(p, "$.salary.min").try_cast("long"), c(p, "$.salary.max").try_cast("long"), c(p, "$.salary.currency"), c(p, "$.salary.period")).alias("salary"), F.concat_ws("\n\n", *parts).alias("description"), details_map.alias("details"),
    )


class TooManyFailures(RuntimeError):
    pass


def enrich(candidates: DataFrame, get: Callable[[str], str | None], partitions: int = 4, keep=None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``html`` and ``error``, one row of counts): fetches each candidate's url, a bounded number at a time.

    Written once by ``keep``, so that counting does not fetch again.
    """

    def run(parts):
        for pdf in parts:
            got = []
            for url in pdf.url:
                try:
                    got.append((get(url), None))
                except Exception as e:  # one page's failure is a fact about that page
                    got.append((None, f"{type(e).__name__}: {e}"[:500]))
            yield pdf.assign(html=[x for x, _ in got], error=[e for _, e in got])

    schema = ", ".join(f"{n} {t}" for n, t in candidates.dtypes) + ", html string, error string"
    keep = keep or (lambda d: d.checkpoint())
    rows = keep(candidates.repartition(max(1, min(8, partitions))).mapInPandas(run, schema))
    return rows, rows.agg(F.count("*").alias("candidates"), F.count("error").alias("failures"))


def check_failures(counts: DataFrame, allow: bool = False) -> None:
    """Raises where nothing was enriched, or at least five candidates and half of all failed."""
    r = counts.first()
    if r.candidates and not allow and (r.failures == r.candidates or r.failures >= 5 and r.failures >= math.ceil(r.candidates / 2)):
        raise TooManyFailures(f"{r.failures} of {r.candidates} details failed")


def require_discovered(rows: DataFrame) -> DataFrame:
    if rows.where("trim(url) <> ''").isEmpty():
        raise TooManyFailures("no listing with a url was found")
    return rows


