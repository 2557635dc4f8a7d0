"""Listing and detail pages as rows: adapters described by selectors, parsed in vectorised functions.

A selector is a chain of simple ones (``tag.class[attr*=value]``) with blanks for "somewhere inside".
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CARD = "array<struct<url:string,title:string,company:string,location:string,closing_date_raw:string,job_type:string,gender:string>>"
DETAIL = "struct<title:string,company:string,description:string,details:map<string,string>,apply_url:string,posting:string>"


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict, up: Node | None):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []

    def walk(self):
        for k in self.kids:
            if isinstance(k, Node):
                yield k
                yield from k.walk()

    def raw(self, skip=("script", "style"), without: tuple[Node, ...] = ()) -> str:
        return "".join(k if isinstance(k, str) else "" if k.tag in skip or k in without else ("\n" if k.tag in ("br", "p", "li", "div", "tr", "h1", "h2", "h3", "h4") else "") + k.raw(skip, without) for k in self.kids)

    def text(self, without: tuple[Node, ...] = ()) -> str:
        return " ".join(self.raw(without=without).split())

    def lines(self) -> str:
        return "\n".join(x for x in (" ".join(s.split()) for s in self.raw().split("\n")) if x)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = self.root = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.up is not None and n.tag != tag:
            n = n.up
        if n.up is not None:
            self.at = n.up

    def handle_data(self, data):
        self.at.kids.append(data)


def tree(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_SIMPLE = re.compile(r"([\w-]*)((?:\.[\w-]+)*)((?:\[[^\]]+\])*)$")


def _fits(n: Node, simple: str) -> bool:
    tag, classes, attrs = _SIMPLE.match(simple).groups()
    if tag and n.tag != tag or not set(classes.split(".")[1:]) <= set(n.attrs.get("class", "").split()):
        return False
    for name, op, value in re.findall(r"\[([\w-]+)(?:([*^]?=)[\"']?([^\"'\]]*)[\"']?)?\]", attrs):
        has = n.attrs.get(name)
        if has is None or op == "=" and has != value or op == "*=" and value not in has or op == "^=" and not has.startswith(value):
            return False
    return True


def find(n: Node, selector: str) -> list[Node]:
    """Descendants that fit, in document order; alternatives are separated by commas, ``a >> b`` is an ``a`` that holds a ``b``."""
    if ">>" in selector:
        outer, inner = selector.split(">>")
        return [x for x in find(n, outer.strip()) if find(x, inner.strip())]
    out = []
    for x in n.walk():
        for option in selector.split(","):
            *above, last = option.split()
            if not _fits(x, last):
                continue
            p = x.up
            for need in reversed(above):
                while p is not None and p is not n.up and not _fits(p, need):
                    p = p.up
                if p is None or p is n.up:
                    break
                p = p.up
            else:
                out.append(x)
                break
    return out


def first(n: Node, selector: str | None) -> Node | None:
    return next(iter(find(n, selector)), None) if selector else None


def text_of(n: Node | None) -> str | None:
    return (n.text() or None) if n is not None else None


@dataclass
class Adapter:
    """Where a board keeps what.  ``cards`` and ``rows`` are two forms of its listing, tried in that order."""

    source: str
    base: str
    cards: str = "li"
    link: str = "a[href]"
    not_links: str | None = None
    company: str | None = None
    location: str | None = None
    closing: str | None = None
    job_type: str | None = None
    gender: str | None = None
    rows: str | None = None  # table rows with the cells: -, title, company, location, closing day
    detail_root: str = "body"
    detail_title: str = "h1"
    detail_company: str | None = None
    pairs: tuple[tuple[str, str, str], ...] = (("tr", "th", "td"), ("dl", "dt", "dd"))  # (row, label, value)
    sections: str | None = None
    headed: tuple[tuple[str, str, str | None], ...] = ()  # (section, heading, body; None: all but the heading), forms tried in order
    needs: tuple[str, ...] = ()  # what a page of this board has: every one of these
    not_titles: str | None = None  # headings of sections that are left out
    title_prefix: str | None = None
    company_alone: bool = False  # the company's element holds others, which are no part of it
    closing_pattern: str | None = None  # found in the card's text
    gender_pattern: str | None = None
    other_meta: str | None = None  # the first of these that is not the company is the place
    apply: str | None = None
    fields: dict = field(default_factory=dict)

    def listing(self, html: str | None) -> list[dict]:
        root, out = tree(html), []
        for card in find(root, self.cards):
            bad = {id(x) for x in find(card, self.not_links)} if self.not_links else set()
            link = next((x for x in find(card, self.link) if id(x) not in bad and x.attrs.get("href")), None)
            if link is None:
                continue
            company, kind, whole = first(card, self.company), first(card, self.job_type), card.text()
            aside = tuple(k for k in company.kids if isinstance(k, Node)) if company and self.company_alone else (kind,) if kind else ()
            named = re.sub(r"[•·]+\s*$", "", company.text(without=aside)).strip() or None if company else None
            place = text_of(first(card, self.location)) or next((t for t in (x.text() for x in find(card, self.other_meta)) if t and t != named), None) if self.location or self.other_meta else None
            said = lambda pattern: next((m[1] for m in [re.search(pattern, whole, re.I)] if m), None) if pattern else None
            out.append({"url": urljoin(self.base, link.attrs["href"]), "title": text_of(link), "company": named, "location": place, "closing_date_raw": text_of(first(card, self.closing)) or said(self.closing_pattern), "job_type": text_of(kind), "gender": text_of(first(card, self.gender)) or said(self.gender_pattern)})
        if out or not self.rows:
            return out
        for row in find(root, self.rows):
            cells = find(row, "td")
            link = first(cells[1], "a[href]") if len(cells) >= 5 else None
            if link is not None:
                places = list(dict.fromkeys(t for t in (a.text() for a in find(cells[3], "a")) if t))
                out.append({"url": urljoin(self.base, link.attrs["href"]), "title": text_of(link), "company": text_of(cells[2]), "location": ", ".join(places) or text_of(cells[3]), "closing_date_raw": text_of(cells[4]), "job_type": None, "gender": None})
        return out

    def detail(self, html: str | None) -> dict | None:
        """A detail page's fields; None where its markup is not the board's."""
        root = tree(html)
        body = first(root, self.detail_root) or (root if self.detail_root == "body" else None)
        if body is None:
            return None
        if not all(find(root, x) for x in self.needs):
            return None
        details = {}
        for row, label, value in self.pairs:
            for r in find(body, row):
                labels = find(r, label)
                values = [v.text() for v in find(r, value)] if value else [r.text(without=tuple(labels[:1]))]
                for k, v in zip(labels, values, strict=False):
                    key = re.sub(r"^[^\w]+|:$", "", k.text())
                    if key and v and key not in details:
                        details[key] = v
        parts = [s.lines() for s in find(body, self.sections)] if self.sections else [] if self.headed else [body.lines()]
        for section, heading, text in self.headed:
            found = []
            for s in find(body, section) if not parts else []:
                heads = find(s, heading) if text else find(s, heading)[:1]
                for head in heads:
                    # of several headings in one section each has its body beside it
                    text_node = first(s if len(heads) == 1 else head.up, text) if text else None
                    title = re.sub(":$", "", head.text())
                    inner = text_node.lines() if text_node else "" if text else s.lines().removeprefix(head.text()).strip()
                    if title and inner and not (self.not_titles and re.fullmatch(self.not_titles, title, re.I)):
                        found.append(f"{title}\n{inner}")
            parts = parts or found
        posting = json_posting(root)
        if not details and not posting and not any(parts):
            return None
        apply = first(body, self.apply)
        title = text_of(first(root, self.detail_title)) or posting.get("title")
        if title and self.title_prefix:
            title = re.sub(f"^(?:{self.title_prefix})\\s*", "", title, flags=re.I)
        return {"title": title, "company": text_of(first(root, self.detail_company)) or (posting.get("hiringOrganization") or {}).get("name"), "description": "\n\n".join(p for p in parts if p) or posting.get("description"), "details": details, "apply_url": urljoin(self.base, apply.attrs.get("href", "")) if apply else None, "posting": json.dumps(posting) if posting else None}


def json_posting(root: Node) -> dict:
    """The first embedded JSON-LD job posting; blocks that are no JSON are passed over."""
    for s in find(root, "script[type=application/ld+json]"):
        try:
            found = json.loads(s.raw(skip=()))
        except ValueError:
            continue
        if isinstance(found, dict) and found.get("@type") == "JobPosting":
            return found
    return {}


def listing_rows(pages: DataFrame, adapter: Adapter, html: str = "html") -> DataFrame:
    """One raw row for each card of the listing pages, with its place."""

    @F.pandas_udf(CARD)
    def cards(s: pd.Series) -> pd.Series:
        return s.map(adapter.listing)

    other = [c for c in pages.columns if c not in (html, "url")]
    return pages.select(*other, F.posexplode(cards(html)).alias("position", "card")).select(*other, "position", F.lit(adapter.source).alias("source"), F.col("card.url").alias("source_url"), "card.*")


def detail_columns(html: Column, adapter: Adapter) -> Column:
    @F.pandas_udf(DETAIL)
    def detail(s: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys(("title", "company", "description", "details", "apply_url", "posting"))
        return pd.DataFrame([adapter.detail(x) or empty for x in s], columns=list(empty))

    return detail(html)


def first_occurrences(rows: DataFrame, page: str = "page", position: str = "position") -> DataFrame:
    """Rows of ordered pages whose url stood on no earlier page."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("url").orderBy(page, position)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def stalled_pages(rows: DataFrame, page: str = "page") -> DataFrame:
    """Pages that repeat: no new url on them, or the same set of urls as an earlier page."""
    fresh = first_occurrences(rows, page).groupBy(page).agg(F.count("*").alias("fresh"))
    prints = rows.groupBy(page).agg(F.sha1(F.array_join(F.array_sort(F.collect_set("url")), "\n")).alias("print"))
    earlier = prints.groupBy("print").agg(F.min(page).alias("first"))
    return prints.join(earlier, "print").join(fresh, page, "left").where((F.col("first") < F.col(page)) | F.col("fresh").isNull()).select(page)
