"""Paginated listings, crawls and boards: every way in which a listing can be broken."""

import json

import pytest
from pyspark.sql import functions as F

from listforge.operators import lifecycle
from listforge.sources import boards, crawl, feed, paged


def body(rows, total=None):
    return {"data": rows, "meta": {} if total is None else {"totalPages": total}}


def reader(pages, monkeypatch, **options):
    """A reader over answers by page number."""
    monkeypatch.setattr(paged, "fetch", lambda url: json.dumps(pages[int(url)]))
    return paged.PagedReader({"url": "{page}", **options})


def test_a_listing_that_is_read_whole(monkeypatch):
    pages = {1: body([{"id": 1}, {"id": 2}], 2), 2: body([{"id": 3}], 3), 3: body([{"id": 4}], 3)}
    r = reader(pages, monkeypatch)
    parts = r.partitions()
    assert [(p.page, p.total) for p in parts] == [(1, 3), (2, 3), (3, 3)]
    assert [row[0] for p in parts for row in r.read(p)] == [1, 2, 3, 4]


def test_listings_that_raise(monkeypatch):
    full = [{"id": i} for i in range(paged.PAGE_SIZE)]
    for pages, said in (
        ({1: {"data": "x"}}, "no list"),
        ({1: ["x"]}, "no list"),
        ({1: body([1, 2], 1)}, "no list"),
        ({1: body(full)}, "how many pages"),
        ({1: body(full, 51)}, "51 pages"),
    ):
        with pytest.raises(paged.BrokenListing, match=said):
            reader(pages, monkeypatch).partitions()
    with pytest.raises(paged.BrokenListing, match="3 pages"):
        reader({1: body(full, 3), 3: body([], 3)}, monkeypatch, limit=2).partitions()
    r = reader({1: body(full, 3), 2: body([], 3), 3: body([{"id": 1}], 3)}, monkeypatch)
    with pytest.raises(paged.BrokenListing, match="page 2 of 3 is empty"):
        [list(r.read(p)) for p in r.partitions()]
    pages = {1: body([{"id": 1}], 1)}
    r = reader(pages, monkeypatch)
    parts = r.partitions()
    pages[1] = body([{"id": 1}], 2)
    with pytest.raises(paged.BrokenListing, match="grew"):
        list(r.read(parts[0]))


def test_pages_that_repeat_raise(spark, tmp_path):
    paged.register(spark)
    for p, ids in ((1, [1, 2]), (2, [2, 1])):
        (tmp_path / f"{p}.json").write_text(json.dumps(body([{"id": i} for i in ids], 2)))
    with pytest.raises(paged.BrokenListing, match="page 2"):
        paged.read_listing(spark, f"file://{tmp_path}/{{page}}.json")
    (tmp_path / "2.json").write_text(json.dumps(body([{"id": 3}], 2)))
    assert paged.read_listing(spark, f"file://{tmp_path}/{{page}}.json").count() == 3
    last = paged.last_pages(spark.createDataFrame([(1, 1), (2, 4), (3, 2), (4, 6)], "page int, linked int"))
    assert [tuple(r) for r in last.orderBy("page").collect()] == [(1, None, False), (2, 4, True), (3, 4, True), (4, 6, True)]


def listing(*cards, last=None):
    rows = "".join(f'<div class="job-card"><a class="job-card__title" href="/en/jobs/details/{c}">Title {c}</a><div class="job-card__company">Org <span class="job-pill">Full</span></div><div class="job-card__meta"><span class="job-pill"><i class="fa fa-map-marker"></i> Kabul</span><span class="job-pill"><i class="fa fa-calendar"></i> 2026-05-0{c}</span></div></div>' for c in cards)
    return rows + (f'<a href="?page={last}">last</a>' if last else "")


def test_crawls_and_their_ends():
    def run(pages, limit=50):
        def get(url):
            n = int(url.partition("page=")[2] or 1)
            if isinstance(pages.get(n), Exception):
                raise pages[n]
            return pages.get(n, "")

        return crawl.crawl(boards.ACBAR, get, limit)

    whole = run({1: listing(1, 2, last=3), 2: listing(3, last=3), 3: listing(4, last=2)})
    assert (whole.complete, whole.pages, whole.last, [c["title"] for c in whole.cards]) == (True, 3, 3, ["Title 1", "Title 2", "Title 3", "Title 4"])
    one = whole.cards[0]
    assert (one["company"], one["job_type"], one["location"], one["closing_date_raw"], one["url"]) == ("Org", "Full", "Kabul", "2026-05-01", "https://www.acbar.org/en/jobs/details/1")
    assert run({1: listing(1), 2: ""}).complete
    early = run({1: listing(1, last=3), 2: ""})
    assert not early.complete and "empty before page 3" in early.ended
    assert "nothing new" in run({1: listing(1, last=3), 2: listing(1, last=3)}).ended
    assert "failed after 1" in run({1: listing(1, last=3), 2: OSError("x")}).ended
    with pytest.raises(OSError):
        run({1: OSError("x")})
    with pytest.raises(paged.BrokenListing, match="9 pages"):
        run({1: listing(1, last=9)}, 5)
    with pytest.raises(paged.BrokenListing, match="no end"):
        run({i: listing(i) for i in range(1, 9)}, 5)


def test_boards_read_their_details():
    acbar = boards.ACBAR.adapter.detail('<div class="acbar-jd"><h1 class="acbar-jd__title">Officer</h1><span class="acbar-jd__org">Org</span><div class="acbar-jd__info-row"><b class="acbar-jd__info-term">Category:</b><i class="acbar-jd__info-desc">IT</i></div><div class="acbar-jd__card"><h3 class="acbar-jd__card-title">About the Company</h3><div class="acbar-jd__rich">no</div></div><div class="acbar-jd__card"><h3 class="acbar-jd__card-title">Duties:</h3><div class="acbar-jd__rich"><p>One</p><p>Two</p></div></div><a href="/applicationform/1">x</a></div>')
    assert (acbar["title"], acbar["company"], acbar["details"], acbar["description"], acbar["apply_url"]) == ("Officer", "Org", {"Category": "IT"}, "Duties\nOne\nTwo", "https://www.acbar.org/applicationform/1")
    assert boards.ACBAR.adapter.detail("<p>another page</p>") is None
    legacy = boards.ACBAR.adapter.detail('<div><h2 class="job-title">Position Title: Clerk</h2><div class="job-detail-box"><ul><li class="list-group-item"><span>Salary:</span> 10 USD</li></ul><h3>Skills</h3><div class="paragraph">Any</div></div></div>')
    assert (legacy["title"], legacy["details"], legacy["description"]) == ("Clerk", {"Salary": "10 USD"}, "Skills\nAny")
    kaarobar = boards.KAAROBAR.adapter
    (card,) = kaarobar.listing('<ul><li class="_li"><div class="job-post-info"><h6><a href="/jobs/apply/1">a</a><a href="/jobs/1">Dev</a></h6><a href="/companies/2">Co</a></div><span title="Location">Herat</span> Female until 2026-03-04</li></ul>')
    assert (card["title"], card["company"], card["location"], card["closing_date_raw"], card["gender"]) == ("Dev", "Co", "Herat", "2026-03-04", "Female")
    detail = kaarobar.detail('<div class="widget bg-white"><h5>Position Title: Dev</h5><table><tr><th>Category:</th><td>IT</td></tr></table><div class="row-bottom data"><h5>Duties:</h5><p>Work</p></div><a title="apply" href="/x">a</a></div>')
    assert (detail["title"], detail["details"], detail["description"], detail["apply_url"]) == ("Dev", {"Category": "IT"}, "Duties\nWork", "https://www.kaarobar.net/x")
    assert kaarobar.detail("<p>another page</p>") is None
    wazifaha = boards.WAZIFAHA.adapter
    (card,) = wazifaha.listing('<div class="wz-job"><a class="wz-job-name" href="/jobs/3">Dba</a><span class="wz-job-meta-item"><a href="/companies/1">Co</a></span><span class="wz-job-meta-item">Balkh</span></div>')
    assert (card["title"], card["company"], card["location"]) == ("Dba", "Co", "Balkh")
    detail = wazifaha.detail('<h1 class="wz-hero-title">Dba</h1><script type="application/ld+json">{"@type": "JobPosting", "description": "From data"}</script>')
    assert detail["description"] == "From data" and wazifaha.detail("<h1>another</h1>") is None


def test_sources_side_by_side(spark, tmp_path):
    def fails():
        raise ValueError("down")

    def read(get):
        return crawl.board_reader(spark, boards.ACBAR, get)

    sources = {"a/b": read(lambda url: listing(1) if "page=" not in url else ""), "part": read(lambda url: listing(2, last=3) if "page=" not in url else ""), "empty": lambda: (spark.range(0), None), "down": fails}
    rows, runs = crawl.collect(spark, sources, str(tmp_path))
    got = {r.source: (r.ok, r.partial, r.raw) for r in runs.collect()}
    assert got == {"a/b": (True, False, 1), "part": (True, True, 1), "empty": (False, False, 0), "down": (False, False, 0)} and set(rows) == {"a/b", "part"}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["down.txt", "empty.txt", "part.txt"]
    crawl.collect(spark, {"down": lambda: (spark.range(1), None)}, str(tmp_path))
    assert not (tmp_path / "down.txt").exists() and crawl.safe_name("a/b") == "a_b"
    known = boards.registry(spark, {"acbar": 7, "kaarobar": -1}).orderBy("priority").collect()
    assert [(r.source, r.page_limit) for r in known] == [("jobs.af", 50), ("acbar", 7), ("kaarobar", 50), ("wazifaha", 50)]
    health = lifecycle.health(runs, rows["a/b"], rows["part"].limit(0))
    assert {r.source: r.status for r in health.collect()} == {"a/b": "healthy", "part": "partial", "empty": "failed", "down": "failed"}


def test_pairs_summaries_and_older_outputs(spark, tmp_path):
    df = spark.createDataFrame([("a, \"b\"\nc", "u1", "2026-01-02", None), ("d", "u2", "2026-01-03", "2026-02-02")], "title string, url string, scraped_at string, closing_date string")
    at = [f"file://{tmp_path}/{n}" for n in ("rows.json", "rows.csv", "summary.json")]
    for _ in range(2):
        assert feed.publish_pair(df, at[0], at[1], ["title", "url"]) == 2
    assert spark.read.json(at[0]).count() == 2 and {p.name for p in tmp_path.iterdir() if "staged" in p.name} == set()
    feed.write_summary(df.agg(F.count("*").alias("total")), at[2])
    assert spark.read.json(at[2]).first().total == 2
    with pytest.raises(feed.InvalidSource):
        feed.write_summary(df, at[2])
    assert spark.read.json(at[2]).first().total == 2
    again = crawl.union_later_wins([df, df.where("url = 'u1'").withColumn("title", F.lit("new"))])
    assert {r.url: r.title for r in again.collect()} == {"u1": "new", "u2": "d"}
    assert [r.url for r in lifecycle.still_open_legacy(df, "2026-02-02T19:29:00Z").collect()] == ["u1", "u2"]
    assert [r.url for r in lifecycle.still_open_legacy(df, "2026-02-02T19:30:00Z").collect()] == ["u1"]
    full = df
    for c in feed.LEGACY_COLUMNS:
        full = full if c in full.columns else full.withColumn(c, F.lit(None).cast("string"))
    assert [r.url for r in feed.legacy_rows(full).collect()] == ["u2", "u1"] and feed.legacy_rows(full).columns == feed.LEGACY_COLUMNS
