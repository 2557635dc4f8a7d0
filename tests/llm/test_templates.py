"""Templates of hosts whose pages are near copies of each other."""

from listforge.llm import html_extract

PAGE = "<html><body><div class=top>Menu of all pages</div><div class=story>{}</div><div class=end>All rights are ours</div></body></html>"


def paragraphs(name, n=6):
    return [" ".join(f"{name}{i}x{j}" for j in range(25)) for i in range(n)]


def extracted(spark, hosts):
    data = [(100 * h + i, f"http://h{h}/{i}", PAGE.format("".join(f"<p>{t}</p>" for t in ps))) for h, pages in enumerate(hosts) for i, ps in enumerate(pages)]
    want = {100 * h + i: " ".join(ps) for h, pages in enumerate(hosts) for i, ps in enumerate(pages)}
    got = html_extract.main_text(spark.createDataFrame(data, "page_id long, url string, html string").repartition(3))
    return {r.page_id: r.text for r in got.collect()}, want


def test_html_near_copies_keep_their_article(spark):
    base = paragraphs("a")
    near = [[f"edit {k} " + t if i == k % 6 else t for i, t in enumerate(base)] for k in range(12)]
    edited = [base] * 9 + [[*base[:5], base[5] + " more"]]
    mixed = [base] * 30 + [[*base[:5], base[5] + " more"]] + [paragraphs(f"o{k}b") for k in range(2)]
    # articles of their own that share a refrain inside, at no fixed place
    refrain = [[*(p := paragraphs(f"r{k}c", 7))[: 1 + k % 5], "The same refrain for all", *p[1 + k % 5 : 5 + 2 * (k % 2)]] for k in range(10)]
    got, want = extracted(spark, [near, edited, mixed, refrain])
    assert got == want


def test_html_fixed_text_never_empties_the_main_slot(spark):
    page = html_extract.parse(PAGE.format("<p>only this</p>"))
    at = page.elements[page.blocks[1].at]
    assert html_extract.extract(page, page.elements[at.parent].key, {html_extract._key(f"{at.key}\0only this")}) == "only this"


ARTICLE = " ".join(f"word{i}" for i in range(80))


def alone(html):
    return html_extract.extract(html_extract.parse(html), None, set())


def test_wrappers_keep_their_article():
    for names in ("content with-sidebar", "content has-sidebar", "post no-comments", "article search-result", "entry social", "layout two-col side-nav-open", "page form-page"):
        assert alone(f'<html><body><nav><a href=x>menu of all</a></nav><div class="{names}"><p>{ARTICLE}</p></div><footer>all ours</footer></body></html>') == ARTICLE, names
    assert alone(f"<body><article><p>{ARTICLE}</p><section class='related-work'><p>{ARTICLE}</p></section></article></body>") == f"{ARTICLE} {ARTICLE}"
    assert alone(f"<body><form action=x><div class=top-menu>menu</div><div class=content><p>{ARTICLE}</p></div><div class=footer>ours</div></form></body>") == ARTICLE
    assert alone(f"<body><object data=x><p>{ARTICLE}</p>") == ARTICLE
    assert alone(f"<body><article><p>{ARTICLE}</p><div hidden>not shown</div><p hidden>nor this</p></article></body>") == ARTICLE
    assert alone(f"<body><article><p>{ARTICLE}</p></article><div class=comments><article><p>{ARTICLE * 3}</p></article></div></body>") == ARTICLE
    assert alone(f"<body><div class=content><p>{ARTICLE}</p><div class='sidebar'><div class=text>beside the point</div></div><form>Sign up</form></div></body>") == ARTICLE
    assert alone("<body><article></article><form>Sign up for news</form><div class=comments><p>first of all</p></div></body>") == ""


def test_hostile_pages_take_linear_time():
    import time

    n = 200_000
    for unit in ('<a "x', "<div>", "<div><p>a", "<object>x", '<a =">"', "<!-- ", "</div>", "<li>a", "<b>a", "<a x='", "<td><p></li>", "&", "< ", "<![", "<script ", "<p></span>"):
        began = time.process_time()
        page = html_extract.parse(unit * (n // len(unit)) + "<p>end</p>")
        html_extract.extract(page, None, set())
        assert time.process_time() - began < 4, unit


def test_a_template_changes_the_result(spark):
    """Text that no tag or name gives away is known as the host's only by its template."""
    page = "<html><body><div class=x0>Menu of all pages here</div><div class=x1><p>{}</p><p>{}</p><p>Read more on our site</p></div><div class=x2>All rights are ours</div></body></html>"
    data = [(i, f"http://host/{i}", page.format(*(" ".join(f"w{i}k{k}j{j}" for j in range(20)) for k in range(2)))) for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)).collect()}
    for i, _, h in data:
        bare = alone(h)
        assert "Read more" in bare and got[i] == bare.replace(" Read more on our site", "")
