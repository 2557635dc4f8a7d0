"""The boards that listings are read from: where each keeps what, and how its pages are numbered.

Addresses and selectors are fixed values: they are the boards' own markup.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .html import Adapter
from .paged import MOST_PAGES


@dataclass(frozen=True)
class Board:
    adapter: Adapter
    first_page: str
    next_page: str  # a template with {page}
    concurrency: int = 4
    gap_ms: int = 0

    def page_url(self, page: int) -> str:
        return self.first_page if page <= 1 else self.next_page.format(page=page)


ACBAR = Board(
    Adapter(
        source="acbar",
        base="https://www.acbar.org",
        cards=".job-card",
        link="a.job-card__title[href*=/en/jobs/details/]",
        company=".job-card__company",
        company_alone=True,
        job_type=".job-card__company .job-pill",
        location=".job-card__meta .job-pill >> .fa-map-marker",
        closing=".job-card__meta .job-pill >> .fa-calendar",
        rows="table tr",
        detail_title=".acbar-jd__title,h2.job-title",
        title_prefix="Position Title:",
        detail_company=".acbar-jd__org",
        pairs=((".acbar-jd__info-row", ".acbar-jd__info-term", ".acbar-jd__info-desc"), (".acbar-jd__info-text", ".acbar-jd__info-text-title", ".acbar-jd__info-text-value"), ("li.list-group-item", "span", None)),
        headed=((".acbar-jd__card", ".acbar-jd__card-title", ".acbar-jd__rich"), (".job-detail-box", "h3", ".paragraph")),
        not_titles="about the (?:company|organization)",
        needs=(".acbar-jd__title,h2.job-title", ".acbar-jd__card,.job-detail-box"),
        apply="a[href^=mailto:],a[href*=/applicationform]",
    ),
    "https://www.acbar.org/en/jobs",
    "https://www.acbar.org/en/jobs?page={page}",
    concurrency=2,
    gap_ms=200,
)

KAAROBAR = Board(
    Adapter(
        source="kaarobar",
        base="https://www.kaarobar.net",
        cards="li._li",
        link=".job-post-info h6 a[href*=/jobs/],a[href^=/jobs/]",
        not_links="a[href*=/jobs/apply/]",
        company=".job-post-info a[href*=/companies/]",
        location="[title=Location]",
        job_type=".job-time span",
        closing_pattern=r"\b(20\d{2}-\d{2}-\d{2})\b",
        gender_pattern=r"\b(Male|Female|Any)\b",
        detail_root=".widget.bg-white",
        detail_title="h5",
        title_prefix="Position Title:",
        pairs=(("table tr", "th", "td"),),
        headed=((".row-bottom.data", "h5", None),),
        apply="a[title=apply],a[href*=/jobs/apply/]",
    ),
    "https://www.kaarobar.net/jobs/",
    "https://www.kaarobar.net/jobs/?page={page}",
)

WAZIFAHA = Board(
    Adapter(
        source="wazifaha",
        base="https://wazifaha.org",
        cards=".wz-job",
        link="a.wz-job-name",
        company=".wz-job-meta-item a[href*=/companies/]",
        other_meta=".wz-job-meta-item",
        gender=".wz-tag",
        detail_title=".wz-hero-title",
        detail_company=".wz-hero-org a",
        pairs=((".wz-grid-item", ".wz-grid-label", ".wz-grid-value"),),
        headed=((".wz-content-section", ".wz-section-heading", ".wz-section-body"),),
        needs=(".wz-hero-title",),
        apply=".wz-apply-btn",
    ),
    "https://wazifaha.org/jobs/",
    "https://wazifaha.org/jobs/?page={page}",
)

#: Sources in the order of their priority; the first reads a paginated API (``paged``), the others are boards.
SOURCES = ("jobs.af", "acbar", "kaarobar", "wazifaha")
BOARDS = {b.adapter.source: b for b in (ACBAR, KAAROBAR, WAZIFAHA)}
#: Names of sources for readers.
SHOWN = {"acbar": "ACBAR", "jobs.af": "Jobs.af", "kaarobar": "Kaarobar", "wazifaha": "Wazifaha"}


def registry(spark: SparkSession, limits: dict[str, int] | None = None, limit: int = MOST_PAGES) -> DataFrame:
    """(source, priority, shown, page_limit) of every source; limits that are no positive number are the general one."""
    own = limits or {}
    rows = [(s, i, SHOWN[s], own[s] if isinstance(own.get(s), int) and own[s] > 0 else limit) for i, s in enumerate(SOURCES)]
    return spark.createDataFrame(rows, "source string, priority int, shown string, page_limit int")
