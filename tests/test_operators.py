"""Operators over listings: classifier, splitting, resolution, search, lifecycle, quality, summary, sources, stream."""

import itertools
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from listforge.operators import expand, lifecycle, quality, relevance, resolve, summary
from listforge.operators import select as search
from listforge.operators.normalize import normalize
from listforge.operators.schema import COLUMNS, LISTING, RAW
from listforge.sources import feed, html, paged
from listforge.streaming import lifecycle as stream

NOW = "2026-03-01T08:00:00Z"


def raw(spark, *rows):
    names = [x.split(" ")[0] for x in RAW.replace(", reasons", "").split(", ") if " " in x]
    fields = spark.createDataFrame([], RAW).columns
    assert names
    return spark.createDataFrame([Row(**{n: r.get(n) for n in fields}) for r in rows], RAW)


def test_normalize(spark):
    row = dict(source=" board ", url="https://E.com/job?id=1", title=" IT  Officer ", closing_date="5 March 2026", vacancies="3", description="Send to HR@x.org\r\nphone: 0700123456\nSubject line must include vacancy number and position title", details={"Reference ": "R-7", "Empty": "", "Posted Date": "2026-02-01"}, first_seen_at="2026-02-20T00:00:00.5Z", last_seen_at="2026-02-10T00:00:00Z", missed_runs="-2", apply_url="mailto:a@b.co", also_found_on=[Row(source="o", url="http://o.com/1"), Row(source="o", url="http://o.com/1"), Row(source=None, url="x")])
    r = normalize(raw(spark, row, {}), NOW).orderBy(F.desc_nulls_last("title")).collect()[0]
    assert (r.source, r.url, r.title, str(r.closing_date), r.vacancies) == ("board", "https://e.com/job?id=1", "IT Officer", "2026-03-05", "3")
    assert r.apply_emails == ["a@b.co", "hr@x.org"] and r.apply_phones == ["+93700123456"] and r.application_method == "email"
    assert (r.application_subject, r.application_subject_type) == ("IT Officer + R-7", "title_template")
    assert str(r.post_date) == "2026-02-01" and r.details == {"Reference": "R-7", "Posted Date": "2026-02-01"}
    assert str(r.first_seen_at) == "2026-02-10 00:00:00" and str(r.last_seen_at) == "2026-02-20 00:00:00" and r.missed_runs == 0
    assert len(r.id) == 16 and r.active and r.lifecycle_status == "active" and len(r.also_found_on) == 1
    blank = normalize(raw(spark, {}), NOW).first()
    assert blank.source == "unknown" and blank.url is None and blank.application_method == "unknown" and str(blank.scraped_at) == "2026-03-01 08:00:00"
    assert normalize(raw(spark).limit(0), NOW).columns == COLUMNS


def test_relevance(spark):
    cases = {
        "strong": dict(title="Senior Software Engineer"),
        "support only": dict(title="Officer", description="python java sql linux"),
        "category": dict(title="Officer", category="Information Technology"),
        "category and role": dict(title="Officer", category="Information Technology", description="administer databases. Bachelor degree in Computer Science"),
        "hard": dict(title="Driver", category="Information Technology"),
        "both": dict(title="IT Officer and driver"),
        "guarded": dict(title="Odoo Developer"),
        "not guarded": dict(title="Business Developer"),
        "mixed": dict(title="Lecturers: data and law"),
        "far degree": dict(title="Officer", description="Bachelor of arts with knowledge of computer science"),
        "acronym": dict(title="Officer", description="Bachelor in IT. it is it"),
    }
    df = spark.createDataFrame([(k, v.get("title"), v.get("category"), v.get("description"), "Software Engineer Ltd") for k, v in cases.items()], "name string, title string, category string, description string, company string")
    got = {r.name: r.relevance for r in relevance.assess(df).collect()}
    assert {k: (v.score, v.decision) for k, v in got.items()} == {"strong": (80, "include"), "support only": (30, "exclude"), "category": (42, "exclude"), "category and role": (80, "include"), "hard": (0, "exclude"), "both": (55, "include"), "guarded": (80, "include"), "not guarded": (0, "exclude"), "mixed": (0, "exclude"), "far degree": (0, "exclude"), "acronym": (18, "exclude")}
    assert got["strong"].reasons == ["title: “software engineer” (+80)"]
    assert got["category and role"].reasons[-1] == "requirements text: computing degree “Computer Science” (+18)"
    assert got["not guarded"].reasons == ["no technical title, category, functional-area, or supporting signals"]
    shown = spark.createDataFrame([(got["both"].reasons,)], "r array<string>").select(search.match_reasons(F.col("r")).alias("m")).first().m
    assert shown == ["Matches it officer"]


def test_expand(spark):
    text = "Intro\n1. IT Officer – 2 positions\nReference: A1\nwork\nII. Division two\n2) Data Clerk\nOpenings: 3\nmore\nJob requirements\nBSc"
    got = expand.expand(raw(spark, dict(source="s", url="https://e.com/j", title="Many", description=text), dict(source="s", url="https://e.com/k", title="One", description="1. Only - 2 openings")), NOW).orderBy("title").collect()
    assert [(r.title, r.vacancies) for r in got] == [("Data Clerk", "3"), ("IT Officer", "2"), ("One", None)]
    clerk, officer, _ = got
    assert officer.url == "https://e.com/j?role=1-it-officer" and officer.details["Reference"] == "A1" and clerk.details["Reference"] == "Many / role 2"
    assert officer.description == "Intro\n\nPosition-specific details\n1. IT Officer – 2 positions\nReference: A1\nwork\n\nJob requirements\nBSc"
    assert officer.id != clerk.id


def jobs():
    same = dict(title="IT Officer", company="Org (Kabul)", location="Kabul, Afghanistan", closing_date="2026-04-01", description="d")
    return [
        dict(same, source="b", url="https://b.com/1?utm_source=x", scraped_at="2026-02-01T00:00:00Z", apply_emails=["x@b.co"]),
        dict(same, source="b", url="https://b.com/1", scraped_at="2026-02-03T00:00:00Z"),
        dict(same, source="a", url="https://a.com/9", scraped_at="2026-02-02T00:00:00Z", closing_date="2026-04-05", apply_url="https://form.com/f"),
        dict(same, source="c", url="https://c.com/3", details={"Reference": "R2"}, closing_date="2026-04-01"),
        dict(same, source="d", url="https://d.com/3", details={"Vacancy Number": "R3"}),
        dict(title="Other", company="Org", source="a", url="https://a.com/10"),
        dict(title="No url", source="a"),
    ]


def test_resolve_in_any_order(spark):
    rows = normalize(raw(spark, *jobs()), NOW).persist()
    results, outs = set(), []
    for seed in (1, 2):
        outs.append(resolve.resolve(rows.orderBy(F.xxhash64(F.lit(seed), "title", "url")), ["a", "b"]).persist())
        results.add(tuple(sorted((r.id, r.source, r.url, r.title, str(r.closing_date), r.application_method, tuple(r.apply_emails), len(r.also_found_on), tuple(r.merged)) for r in outs[-1].collect())))
    assert len(results) == 1
    got = {r[2]: r for r in results.pop()}
    assert set(got) == {"https://a.com/9", "https://a.com/10", "https://d.com/3"}
    merged = got["https://a.com/9"]
    assert merged[4] == "2026-04-05" and merged[5] == "web" and merged[6] == ("x@b.co",) and merged[7] == 2
    assert sum(sum(r[8]) for r in got.values()) == 3
    totals = resolve.removed(outs[0]).first()
    assert totals.removed == 3 and totals.exact_removed == 1


def test_copies_of_an_url_in_many_batches(spark):
    """A hot url, read in batches of three rows and in any order of the input, gives one record in canonical order."""
    many = [dict(id=f"h{k:02}", source="a" if k % 2 else "b", url="https://e.com/hot", title="IT Officer", company="Org", gender=f"g{k}" if k in (7, 9) else None, description=f"d{k}" if k == 4 else None) for k in range(20)]
    rest = [dict(id=f"c{k}", source="a", url=f"https://e.com/{k % 4}", title=f"Role {k % 4}", location="Kabul") for k in range(8)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        seen = []
        for rows in (many + rest, (many + rest)[::-1]):
            out = resolve.resolve(normalize(raw(spark, *rows), NOW), ["a"]).orderBy("url").collect()
            seen.append([(r.url, r.gender, r.description, r.merged.exact) for r in out])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert seen[0] == seen[1] and [(u, n) for u, _, _, n in seen[0]] == [*[(f"https://e.com/{k}", 1) for k in range(4)], ("https://e.com/hot", 19)]
    # the first of them in canonical order is h01; the fields it lacks come from the next ones that have them
    assert seen[0][4][1:3] == ("g7", "d4")


def test_search(spark):
    rows = [("1", "Web Developer", "Zed", "Kabul; Herat, Afghanistan", "2026-03-03", "2026-02-28", "2", "500 USD monthly", None), ("2", "Network Engineer", "acme", "Kabul", None, None, "12", "900 USD monthly", None), ("3", "Clerk", "Acme ", "Balkh", "2026-02-20", "2026-02-27", None, "N/A", None), ("4", "Clerk", None, None, "2026-03-01", "2026-01-01", "one", "as per scale", "expired")]
    df = spark.createDataFrame(rows, "id string, title string, company string, location string, closing_date string, post_date string, vacancies string, salary string, status string")
    ready = search.derived(df, "2026-03-01").persist()
    ids = lambda **k: [r.id for r in search.pick(ready, **k).collect()]
    assert ids() == ["1", "2"] and ids(sort="salary") == ["2", "1"] and ids(sort="vacancies") == ["2", "1"] and ids(sort="company") == ["2", "1"]
    assert ids(query="developer ZED") == ["1"] and ids(location="herat") == ["1"] and ids(company=" ACME") == ["2"] and ids(category="software & web") == ["1"]
    assert ids(salary="comparable") == ["1", "2"] and ids(vacancy="11+") == ["2"] and ids(vacancy={"min": 1, "max": 3}) == ["1"] and ids(vacancy=12) == ["2"] and ids(vacancy="whatever") == ["1", "2"]
    assert ids(filter="expiring") == ["1"] and ids(filter="recent") == ["1"]
    f = search.facets(df, "2026-03-01").first()
    assert f.salary.can_sort and f.vacancies.eleven_plus == 1 and f.vacancies.listed == 2
    values = [(r.facet, r.value, r.n) for r in search.facet_values(df, "2026-03-01").collect()]
    assert values == [("category", "Network & Telecom", 1), ("category", "Software & Web", 1), ("company", "acme", 1), ("company", "Zed", 1), ("location", "Herat", 1), ("location", "Kabul", 2)]
    assert tuple(search.stats(df, "2026-03-01").first()) == (2, 1, 1)


def test_lifecycle(spark):
    old = normalize(raw(spark, *[dict(id=f"i{k}", source=s, url=f"https://{s}.com/{k}", title="t", missed_runs=m, details=d) for k, s, m, d in (("seen", "h", "0", None), ("ref", "h", "0", {"Reference": "Q1"}), ("once", "h", "0", None), ("gone", "h", "2", None), ("down", "f", "1", None), ("left", "z", "0", None))]), NOW)
    new = normalize(raw(spark, dict(id="n1", source="h", url="https://h.com/seen", title="t"), dict(id="n2", source="h", url="https://h.com/moved", title="t", details={"Reference": "Q1"})), NOW)
    status = spark.createDataFrame([("h", "healthy"), ("f", "failed")], "source string, status string")
    got = {r.id: (r.lifecycle_status, r.missed_runs) for r in lifecycle.reconcile(old, new, status, NOW).collect()}
    assert got == {"n1": ("active", 0), "n2": ("active", 0), "iseen": ("active", 0), "iref": ("active", 0), "ionce": ("unconfirmed", 1), "idown": ("source_unavailable", 1), "ileft": ("unmanaged", 0)}
    runs = spark.createDataFrame([("h", True, False, 9), ("f", False, False, 0), ("p", True, True, 1), ("d", True, False, 1)], "source string, ok boolean, partial boolean, raw int")
    many = spark.range(10).select(F.lit("d").alias("source"))
    health = lifecycle.health(runs, new.select("source").unionByName(many.limit(1)), many)
    assert {r.source: r.status for r in health.collect()} == {"h": "healthy", "f": "failed", "p": "partial", "d": "major_drop"}
    with pytest.raises(lifecycle.RunAborted):
        lifecycle.assert_healthy(health, old)
    lifecycle.assert_healthy(health, old, allow_major_drop=True)


def test_quality_and_summary(spark):
    rows = normalize(raw(spark, dict(id="1", source="s", url="https://e.com/1", title="Bank IT officer", company="Kabul Bank", closing_date="2026-03-03", apply_emails=["a@b.co"], description="d"), dict(id="1", source="s", url="https://e.com/1", title="x", closing_date="2026-01-01"), dict(id="3", source="q", title="no url")), NOW)
    rows = rows.withColumn("relevance", F.expr("named_struct('version', 2, 'score', 80D, 'threshold', 55D, 'decision', 'include', 'reasons', array('r'))"))
    found = {(r.key, r.rule) for r in quality.violations(rows, "2026-03-01").collect()}
    assert {("1", "id is not unique"), ("https://e.com/1", "url is not unique"), ("3", "url is missing"), ("1", "expired")} <= found
    with pytest.raises(quality.InvalidFeed):
        quality.validate(rows, "2026-03-01")
    good = rows.where("title like 'Bank%'")
    quality.validate(good, "2026-03-01")
    with pytest.raises(quality.InvalidFeed):
        quality.validate(good, "2026-03-01", min_jobs=2)
    with pytest.raises(quality.InvalidFeed):
        quality.check_baseline(64, 100)
    quality.check_baseline(65, 100)
    placed = good.withColumn("position", F.lit(0))
    s = summary.summarize(placed, rows.limit(0), "2026-03-01", NOW)
    r = s.first()
    assert (r.total, r.new_count, r.new_ids, r.expiring_soon_ids, r.banking_tech_count) == (1, 1, ["1"], ["1"], 1)
    assert quality.summary_violations(s, good).collect() == []
    assert {v.rule for v in quality.summary_violations(s, good.where("id = 'z'")).collect()} == {"id is not in the feed", "source count differs"}
    assert [x.title for x in summary.hydrate(s, good, "new_ids").collect()] == ["Bank IT officer"]
    assert "and 4 more" in summary.digest_section("New", good, 5)


def test_feed_files(spark, tmp_path):
    path = f"file://{tmp_path}/feed.json"
    assert feed.read_raw(spark, path).count() == 0
    (tmp_path / "feed.json").write_text(json.dumps([{"source": "s", "title": "=x, y", "url": "https://e.com/1", "vacancies": 3, "details": {"a": 1}}]))
    rows = feed.read_feed(spark, path, NOW)
    assert rows.first().vacancies == "3" and rows.first().details == {"a": "1"}
    assert feed.csv_lines(rows, ["title", "vacancies", "apply_emails"]).first().value == "\"'=x, y\",3,"
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(feed.InvalidSource):
        feed.read_raw(spark, f"file://{tmp_path}/bad.json")
    target = f"file://{tmp_path}/out"
    assert feed.publish(rows, target) == 1 and feed.publish(rows.unionByName(rows), target, expected=2) == 2
    with pytest.raises(feed.InvalidSource):
        feed.publish(rows, target, expected=5)
    assert spark.read.schema(LISTING).parquet(target).count() == 2 and [p.name for p in tmp_path.iterdir() if "staged" in p.name] == []


LIST = "<ul><li class=job><a class=t href='/j/1'>IT <b>Officer</b></a><span class=c>Org <i class=k>Full</i></span><span class=p>Kabul</span></li><li class=job><a class=apply href=/a>Apply</a></li></ul>"
DETAIL = "<html><body><h1>IT Officer</h1><table><tr><th>Reference:</th><td>R 1</td></tr></table><section class=s><p>Do</p><p>this</p></section><script type='application/ld+json'>{bad</script><script type='application/ld+json'>{\"@type\":\"JobPosting\",\"title\":\"T\"}</script></body></html>"


def test_html_adapters(spark):
    board = html.Adapter("b", "https://b.com/", cards="li.job", link="a", not_links="a.apply", company=".c", location=".p", job_type=".k", rows="table tr", sections="section.s")
    pages = spark.createDataFrame([(1, LIST), (2, LIST), (3, None)], "page int, html string")
    rows = html.listing_rows(pages, board)
    assert [tuple(r)[:] for r in html.first_occurrences(rows).select("page", "url", "title", "company", "location", "job_type").collect()] == [(1, "https://b.com/j/1", "IT Officer", "Org", "Kabul", "Full")]
    assert [r.page for r in html.stalled_pages(rows).collect()] == [2]
    d = spark.createDataFrame([(DETAIL,), (None,)], "html string").select(html.detail_columns(F.col("html"), board).alias("d")).collect()
    assert d[0].d.title == "IT Officer" and d[0].d.details == {"Reference": "R 1"} and d[0].d.description == "Do\nthis" and json.loads(d[0].d.posting)["title"] == "T"
    assert d[1].d.title is None
    table = "<table><tr><td>1<td><a href=/jobs/5>Dev</a><td>Org<td><a>Kabul</a> <a>Kabul</a><td>1 March 2026</table>".replace("<td>", "</td><td>")
    assert html.Adapter("b", "https://b.com/", cards=".none", rows="tr").listing(table)[0]["location"] == "Kabul"


def test_paged_source(spark, tmp_path):
    for page in (1, 2):
        (tmp_path / f"{page}.json").write_text(json.dumps({"data": [{"id": 10 * page + k, "slug": f"s{page}{k}", "title": "t", "areaId": k} for k in range(2)], "meta": {"totalPages": 2}}))
    paged.register(spark)
    rows = spark.read.format("paged_listing").option("url", f"file://{tmp_path}/{{page}}.json").load()
    assert sorted(r.id for r in rows.collect()) == [10, 11, 20, 21]
    assert [r.id for r in rows.where("area_id = 1").orderBy("id").collect()] == [11, 21]
    assert paged.page_problems(rows).collect() == []
    assert {r.page for r in paged.page_problems(rows.withColumn("slug", F.substring("slug", 3, 1))).collect()} == {2}
    cand = spark.createDataFrame([(f"u{i}",) for i in range(6)], "url string")

    def get(url):
        if url in ("u0", "u1", "u2"):
            raise OSError("down")
        return "<p>" + url

    got, counts = paged.enrich(cand, get)
    assert tuple(counts.first()) == (6, 3) and got.where("html is not null").count() == 3
    with pytest.raises(paged.TooManyFailures):
        paged.check_failures(spark.createDataFrame([(10, 5)], "candidates int, failures int"))
    paged.check_failures(counts)
    areas = spark.createDataFrame([(1, "IT & Software"), (2, "Health")], "id int, name string")
    assert [r.id for r in paged.areas_for("tech, ,x", areas, {"tech": ["it and software"]}).collect()] == [1]


def test_stream_of_runs(spark, tmp_path):
    def run(n, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(run=n, **r)) for r in rows))
        runs = spark.readStream.schema("run long, source string, url string, status string").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
        stream.start(runs, f"file://{tmp_path}/state", f"file://{tmp_path}/check", grace=1).awaitTermination(120)
        return {r.url: (r.lifecycle_status, r.missed_runs) for r in stream.read_state(spark, f"file://{tmp_path}/state").collect()}

    ok = dict(source="a", url=None, status="healthy")
    assert run(1, [dict(source="a", url="u"), dict(source="a", url="v"), ok]) == {"u": ("active", 0), "v": ("active", 0)}
    assert run(2, [dict(source="a", url="u"), ok]) == {"u": ("active", 0), "v": ("unconfirmed", 1)}
    assert run(3, [dict(source="a", url="u"), ok]) == {"u": ("active", 0)}
    assert run(4, [dict(source="a", url=None, status="failed")]) == {"u": ("source_unavailable", 0)}


def test_catalog_has_sql_for_most_queries():
    from listforge.plans import catalog

    found, sql = catalog.queries(), catalog.oracle_sql()
    assert set(sql) <= set(found) and len(sql) >= 45 and catalog.FLAGSHIP in found.values()
