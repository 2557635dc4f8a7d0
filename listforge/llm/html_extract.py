"""Main text of web pages by deducing a host's template from equivalence classes of tokens.

A page is read into tokens: structural ones (the path of an element from the root, with its main class) and
text ones (a block's path with its text).  A token's occurrence vector says how often it stands in each page
of its host; tokens with equal vectors form an equivalence class.  Vectors are not built: a token's signature
is the exclusive or of a hash of (content, count) over the contents, which merges like any aggregate.  Near
copies of a page are one content: pages of a host whose texts' min-hash sketches agree in ``ALIKE`` of ``BINS``
places with that of the first page of a band they share are joined into components, and one page of each
component speaks for it.  Classes that stand in at least ``SHARE`` of a host's contents are valid.

The main slot is the element that holds most text of its own, net of links, over the contents of the host.  A
valid text nests in the structural class of its own element.  Where all text of that element's path is fixed,
it lies outside the slots and is part of the template; where the path has other text too, it is a slot, and the
text is fixed only if its class is that of a structural one and it stands at the same place among its
container's blocks, counted from the first or from the last, on every content.  Extraction keeps the blocks in the main slot without the template's fixed text and without furniture (elements whose tag, role or class names say
menu, advert, form, comment and so on); fixed text that would leave the main slot empty is kept.

Hosts with fewer than ``PAGES`` contents, and pages that lack their host's main slot, take the slot of the page
alone.  A host's template is as large as a page, not as the host: fixed tokens stand in most of its pages.

Defined cases: a null or empty html, and one without a slot with text, give the empty text; a page whose url has
no host belongs to the empty host; unclosed and stray tags are tolerated; repeated rows give equal rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.skew import bounded, spread_join
from .common import drop_path, lean, save, shingle_set, table

SHARE, PAGES = 0.9, 4
#: Characters of prose from which on an element that is named like furniture may be what wraps the page's text.
PROSE = 300
#: Places of a page's sketch, bands they are compared in, and places in which sketches of near copies agree.
BINS, BANDS, ALIKE = 32, 8, 22
#: Template rows up to which they are broadcast; beyond it pages and templates meet in a shuffled join.
SMALL = 200_000

#: Tags end at the first ">" outside quoted values; atomic, so that no text takes more than one pass.
TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>|<[!?/][^>]*+>|[^<]++|<", re.S)
#: The same where quotes do not balance.
LOOSE = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements of the HTML standard by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
SKIPPED = set("script style textarea noscript template svg iframe select object".split())
#: Those that swallow the rest of a page that does not close them; the others then count as ordinary elements.
SWALLOWS = set("script style textarea".split())
HIDDEN = set("head title button option datalist nav footer aside dialog menu".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
SCOPES = {"td", "th", "table", "body"}
#: Words that name furniture when a class, id or role ends with them: for good, or unless it wraps the page's text.
ALWAYS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus submenu "
    "breadcrumb breadcrumbs footer cookie cookies consent newsletter related recommended recommendations comment comments commentlist replies reply respond disqus "
    "pagination pager contentinfo complementary teaser teasers".split()
)
UNLESS = set("header masthead sidebar side aside widget notice notices alert alerts popup modal overlay subscribe subscription signup login search share sharing social form toolbar skip dialog".split())
#: Words that follow these without changing what is named, and words that say it is only spoken of.
HOLDERS = set("area areas bar bars block blocks box boxes button buttons body container content column group holder icons inner item items link links list lists outer panel posts row section slot slots thread unit widget widgets wrap wrapper zone".split())
MODIFIERS = set("with has no without is not hide show two three".split())
CONTENT = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry|story|content|main|body|text|prose)(?:$|[\s_-])", re.I)
#: Weight that an element passes on to the next one out, and levels after which nothing is left of it.
FADE, LEVELS = 0.7, 40


@dataclass(slots=True)
class Block:
    at: int  # place of the innermost open element in Page.elements, -1 outside all
    text: str
    linked: int  # characters inside links


@dataclass(slots=True)
class Element:
    key: int  # hash of the tags and main classes from the root
    parent: int
    tag: str
    furniture: int  # 0: none, 1: unless it wraps the page's text, 2: always
    prior: float
    hidden: bool = False


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


@lru_cache(1 << 16)
def named(names: str) -> tuple[int, bool]:
    """(furniture, whether it says header) by the words of class, id and role."""
    level, header = 0, False
    for token in names.split():
        words = [w.lower() for w in WORDS.findall(token)]
        if not words or words[0] in MODIFIERS:
            continue
        while len(words) > 1 and (words[-1] in HOLDERS or words[-1].isdigit()):
            words.pop()
        header |= words[-1] in ("header", "masthead")
        level = max(level, 2 if words[-1] in ALWAYS else 1 if words[-1] in UNLESS else 0)
    return level, header


def _key(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def parse(text: str) -> Page:
    """Elements and text blocks of a page, in order, in time and memory linear in its length."""
    page = Page()
    elements = page.elements
    stack: list[tuple[str, int]] = []  # (tag, place; -1 for inline elements)
    open_tags: Counter = Counter()
    scopes = [Counter()]  # tags open since the last cell, table or body
    parts: list[str] = []
    linked = depth = 0
    place = -1  # innermost element that is not inline
    absent: set[str] = set()

    def flush():
        nonlocal parts, linked
        if parts:
            joined = " ".join(entities.unescape("".join(parts)).split())
            if joined:
                page.blocks.append(Block(place, joined, min(linked, len(joined))))
            parts, linked = [], 0

    def push(tag: str, i: int):
        stack.append((tag, i))
        open_tags[tag] += 1
        if tag in SCOPES:
            scopes.append(Counter())
        scopes[-1][tag] += 1

    def pop_to(n: int):
        nonlocal depth, place
        while len(stack) > n:
            tag, i = stack.pop()
            if i >= 0:
                flush()
                place = elements[i].parent
            open_tags[tag] -= 1
            scopes[-1][tag] -= 1
            if tag in SCOPES:
                scopes.pop()
            depth -= tag == "a"

    def last(tag: str) -> int:
        return next(n for n in range(len(stack) - 1, -1, -1) if stack[n][0] == tag)

    # what follows the last ">" holds no tag; one that starts there never ends
    end = text.rfind(">") + 1
    cut = re.compile(r"<[a-zA-Z/!?]").search(text, end)
    stop = cut.start() if cut else len(text)
    match, pos = TOKEN.match, 0
    while pos < stop:
        m = match(text, pos, stop)
        start, pos = pos, m.end()
        tag = m[2]
        if tag is None:
            s = m[0]
            if s[0] != "<" or (s == "<" and not (pos < stop and (text[pos].isalpha() or text[pos] == "/"))):
                parts.append(s)
                linked += len(s) if depth else 0
            elif s == "<":  # from here on every ">" stands in quotes
                match, pos = LOOSE.match, start if match is not LOOSE.match else pos
            elif s == "<!--":
                at = text.find("-->", start + 2, stop)
                pos = at + 3 if at >= 0 else stop
            continue
        tag = tag.lower()
        attributes = m[3]
        closed = attributes.rstrip().endswith("/")
        if m[1]:
            if tag == "br":
                flush()
            if open_tags[tag] and (scopes[-1][tag] or not (tag in INLINE or tag in ("p", "li"))):
                pop_to(last(tag))
            continue
        if tag in SKIPPED and tag not in absent and not closed:
            over = re.compile(rf"</{tag}(?![a-zA-Z0-9])", re.I).search(text, pos, stop)
            if over:
                pos = text.find(">", over.end(), stop) + 1 or stop
                continue
            if tag in SWALLOWS:
                break
            absent.add(tag)
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag in INLINE:
            if not closed:
                push(tag, -1)
                depth += tag == "a"
            continue
        flush()
        if tag in CLOSES_P and open_tags["p"]:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == "p":
                    pop_to(n)
                    break
                if stack[n][0] not in INLINE:
                    break
        if tag in SIBLINGS:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] in SIBLINGS[tag]:
                    break
                if stack[n][0] == tag or (tag in ("dt", "dd") and stack[n][0] in ("dt", "dd")) or (tag in ("td", "th") and stack[n][0] in ("td", "th")):
                    pop_to(n)
                    break
        if closed and tag not in CLOSES_P and tag not in SIBLINGS:
            continue
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
        names = " ".join(filter(None, (found.get(k, "") for k in ("class", "id", "role"))))
        level, header = named(names) if names else (0, False)
        content = tag in ("article", "main") or found.get("itemprop") == "articleBody" or found.get("role") == "main"
        if tag in ("html", "body", "main") or (tag == "article" and level < 2):
            level = 0
        elif (tag == "header" or header) and level < 2:
            # a header inside the content holds its title
            level = 0 if _inside_content(elements, place) or CONTENT.search(names.replace("header", "")) else 1
        elif tag == "form":
            level = max(level, 1)
        if tag in HIDDEN or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
            level = 2
        prior = 3.0 if tag == "article" or found.get("itemprop") == "articleBody" else 2.5 if content else 2.0 if names and CONTENT.search(names) else 1.0
        first = found.get("class", "").split()[:1]
        label = tag + (f".{first[0]}" if first else f"#{found['id']}" if "id" in found else "")
        elements.append(Element(_key(f"{elements[place].key if place >= 0 else 0}/{label}"), place, tag, level, prior))
        place = len(elements) - 1
        push(tag, place)
    flush()
    hide(page)
    return page


def _inside_content(elements: list[Element], at: int) -> bool:
    for _ in range(LEVELS):
        if at < 0:
            return False
        if elements[at].prior > 1 and elements[at].tag not in ("html", "body"):
            return True
        at = elements[at].parent
    return False


def hide(page: Page) -> None:
    """Marks furniture and what stands in it.

    Furniture by tag or name that may be a wrapper is one, and stays, if it holds content by name or prose, and
    more than twice the text of all that stands outside furniture: it is then what the page is about.
    """
    elements = page.elements

    def mark(kept: set[int]):
        for i, e in enumerate(elements):
            e.hidden = (e.furniture > 0 and i not in kept) or (e.parent >= 0 and elements[e.parent].hidden)

    mark(set())
    if not any(e.furniture == 1 for e in elements):
        return
    outside = sum(max(0, len(b.text) - 2 * b.linked) for b in page.blocks if b.at < 0 or not elements[b.at].hidden)
    # text and prose by element, without furniture for good inside it; children come after their parents
    text, prose, content = [0] * len(elements), [0] * len(elements), [e.prior > 1 for e in elements]
    for b in page.blocks:
        if b.at >= 0:
            net = max(0, len(b.text) - 2 * b.linked)
            text[b.at] += net
            prose[b.at] += net if elements[b.at].tag in ("p", "article", "pre", "blockquote") else 0
    for i in range(len(elements) - 1, -1, -1):
        e = elements[i]
        if e.furniture == 2:
            text[i] = prose[i] = 0
            content[i] = False
        if e.parent >= 0:
            text[e.parent] += text[i]
            prose[e.parent] += prose[i]
            content[e.parent] = content[e.parent] or content[i]
    kept = {i for i, e in enumerate(elements) if e.furniture == 1 and text[i] > 2 * outside and (content[i] or prose[i] >= PROSE)}
    if kept:
        # of nested wrappers and of those side by side, those that hold more than half of the most text in one stay
        most = max(text[i] for i in kept)
        mark({i for i in kept if 2 * text[i] > most})


def slot_scores(page: Page) -> dict[int, float]:
    """Text net of links held by each open element of the page, shared with its ancestors by half a level."""
    own: dict[int, float] = defaultdict(float)
    elements = page.elements
    for b in page.blocks:
        i = b.at
        if i < 0 or elements[i].hidden:
            continue
        net = max(0.0, len(b.text) - 2 * b.linked)
        # a block counts fully for its paragraph's parent, less for elements further out
        own[i] += net * 0.2
        for _ in range(LEVELS):
            i = elements[i].parent
            if i < 0:
                break
            own[i] += net
            net *= FADE
    return {i: s * elements[i].prior for i, s in own.items() if elements[i].tag not in ("html", "body", "p", "li", "h1", "h2", "h3") or elements[i].prior > 1}


def sketch(page: Page) -> bytes:
    """Smallest hash of the 3-word shingles of the text outside furniture, in each of ``BINS`` ranges, one byte each."""
    x = shingle_set(" ".join(b.text for b in page.blocks if b.at < 0 or not page.elements[b.at].hidden), 3)
    if not len(x):
        return bytes(BINS)
    at = np.searchsorted(x, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
    filled = np.flatnonzero(np.diff(np.append(at, len(x))) > 0)
    # an empty range takes the next one's
    low = x[at[filled[np.searchsorted(filled, np.arange(BINS)) % len(filled)]]]
    return (low & np.uint64(255)).astype(np.uint8).tobytes()


def page_tokens(page: Page, content: int) -> dict[tuple[int, int], list]:
    """(kind, token) -> [vector's part of the signature, slot score, place's token, blocks, before, after].

    kind 0: structure, 1: text.  ``blocks`` counts the blocks right in a structural token's elements, or the text's
    own; ``before`` and ``after`` are the blocks of its container before and after a text.
    """
    counts: dict[tuple[int, int], int] = defaultdict(int)
    elements = page.elements
    for e in elements:
        counts[0, e.key] += 1
    blocks: dict[int, int] = defaultdict(int)
    held: dict[int, list[int]] = defaultdict(list)
    for n, b in enumerate(page.blocks):
        blocks[elements[b.at].key if b.at >= 0 else 0] += 1
        # the container is the innermost element around that of the text, which may be a paragraph of one block
        held[elements[b.at].parent if b.at >= 0 else -1].append(n)
    place = {n: (i, len(ns) - 1 - i) for ns in held.values() for i, n in enumerate(ns)}
    texts: dict[int, tuple[int, int, int]] = {}
    for n, b in enumerate(page.blocks):
        at = elements[b.at].key if b.at >= 0 else 0
        k = _key(f"{at}\0{b.text}")
        counts[1, k] += 1
        texts[k] = (at, *place[n])
    scores: dict[int, float] = defaultdict(float)
    for i, s in slot_scores(page).items():
        scores[elements[i].key] = max(scores[elements[i].key], s)
    return {
        (kind, k): [_key(f"{content} {n}"), scores.get(k, 0.0) if kind == 0 else 0.0, *((k, blocks[k], 0, 0) if kind == 0 else (texts[k][0], n, *texts[k][1:]))]
        for (kind, k), n in counts.items()
    }


def extract(page: Page, main: int | None, fixed: set[int]) -> str:
    """Blocks of the page's main slot, without furniture and the template's fixed text, joined by spaces."""
    scores = slot_scores(page)
    elements = page.elements
    there = [i for i, e in enumerate(elements) if main is not None and e.key == main and not e.hidden]
    if there:
        root = max(there, key=lambda i: (scores.get(i, 0.0), -i))
    elif scores:
        root = max(scores, key=lambda i: (scores[i], -i))
    else:
        root = -1
    # children come after their parents
    inside = [False] * len(elements)
    for i, e in enumerate(elements):
        inside[i] = i == root or (e.parent >= 0 and inside[e.parent])
    out, own = [], []
    for b in page.blocks:
        if root >= 0 and (b.at < 0 or not inside[b.at]) or b.at >= 0 and elements[b.at].hidden:
            continue
        out.append(b.text)
        if not fixed or _key(f"{elements[b.at].key if b.at >= 0 else 0}\0{b.text}") not in fixed:
            own.append(b.text)
    return " ".join(own or out)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def one_of_each(sketches: DataFrame) -> DataFrame:
    """(uid) of one page of each group of near copies of a host, from (host, doc, uid, sketch)."""
    contents, _ = save(sketches.groupBy("host", "doc").agg(F.min("uid").alias("uid"), F.min("sketch").alias("sketch")), "contents")
    size = BINS // BANDS
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64("host", i, F.substring(F.col("sketch"), i * size + 1, F.lit(size)))))
    banded = contents.select("doc", "sketch", band.alias("band"))
    first = banded.groupBy("band").agg(F.min(F.struct("doc", "sketch")).alias("f"), F.count("*").alias("k")).where("k > 1").select("band", F.col("f.doc").alias("b"), F.col("f.sketch").alias("other"))
    agree = F.expr(f"aggregate(sequence(1, {BINS}), 0, (n, i) -> n + if(substring(sketch, i, 1) = substring(other, i, 1), 1, 0))")
    pairs = banded.join(bounded(first, SMALL), "band").where("doc <> b").select(F.col("doc").alias("a"), "b", "sketch", "other").dropDuplicates(["a", "b"])
    edges, _ = save(pairs.where(agree >= ALIKE).select("a", "b"), "alike")
    if edges.isEmpty():
        return contents.select("uid")
    copies = components(edges, lambda df: save(df, "labels")[0]).where("id <> component").select(F.col("id").alias("doc"))
    return contents.join(copies, "doc", "left_anti").select("uid")


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, fixed): token of the main slot, and the hashes of fixed text, of each host with a template."""

    def run(batches):
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = text.as_py()
                if not content:
                    continue
                page, doc, uid = parse(content), _key(f"{host}\0{content}"), uid + 1
                rows.append((host, 2, 0, 0, 0.0, 0, 0, 0, 0, doc, uid, sketch(page)))
                for (kind, token), values in page_tokens(page, doc).items():
                    rows.append((host, kind, token, *values, None, uid, None))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = ["host", "kind", "token", "sign", "score", "at", "blocks", "before", "after", "doc", "uid", "sketch"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = "host string, kind int, token long, sign long, score double, at long, blocks long, before long, after long, doc long, uid long, sketch binary"
    read, read_at = save(pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(lean(run), schema), "read")
    chosen, _ = save(one_of_each(read.where("kind = 2").select("host", "doc", "uid", "sketch")), "chosen")
    tokens = read.where("kind < 2").join(bounded(chosen, SMALL), "uid", "left_semi")
    places = [f("before") for f in (F.min, F.max)] + [f("after") for f in (F.min, F.max)]
    merged = tokens.groupBy("host", "kind", "token").agg(
        F.count("*").alias("pages"), F.bit_xor("sign").alias("signature"), F.sum("score").alias("score"), F.min("at").alias("at"), F.sum("blocks").alias("blocks"),
        *[p.alias(n) for p, n in zip(places, ("b0", "b1", "a0", "a1"), strict=True)],
    )
    merged, _ = save(merged.where("pages > 1"), "tokens")
    drop_path(pages.sparkSession, read_at)
    sizes = merged.where("kind = 0").groupBy("host").agg(F.max("pages").alias("n")).where(F.col("n") >= PAGES)
    valid, _ = save(merged.join(sizes, "host").where(F.col("pages") >= SHARE * F.col("n")), "valid")
    main = valid.where("kind = 0").groupBy("host").agg(F.max(F.struct("score", "token")).alias("best"))
    # a path all of whose blocks are valid texts is fixed; one with other blocks is a slot
    text = valid.where("kind = 1")
    known = text.groupBy("host", "at").agg(F.sum("blocks").alias("known"))
    paths = valid.where("kind = 0").select("host", F.col("token").alias("at"), F.col("blocks").alias("all")).join(known, ["host", "at"]).select("host", "at", (F.col("known") < F.col("all")).alias("slot"))
    kinds = valid.where("kind = 0").select("host", "signature").distinct().withColumn("classed", F.lit(True))
    nested = text.join(paths, ["host", "at"]).join(kinds, ["host", "signature"], "left")
    edge = F.col("classed").isNotNull() & ((F.col("b0") == F.col("b1")) | (F.col("a0") == F.col("a1")))
    fixed = nested.where(~F.col("slot") | edge).groupBy("host").agg(F.collect_list("token").alias("fixed"))
    return main.join(fixed, "host", "left").select("host", F.when(F.col("best.score") > 0, F.col("best.token")).alias("main"), F.coalesce("fixed", F.array().cast("array<bigint>")).alias("fixed"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    found, _ = save(templates(pages), "templates")
    small = found.select(F.coalesce(F.sum(F.size("fixed") + 1), F.lit(0))).first()[0] <= SMALL
    rows = spread_join(pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")), found, "host", "url", "left", found.count() if small else -1)

    def run(batches):
        sets: dict[str, set] = {}
        for batch in batches:
            texts = []
            for text, main, fixed in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                key = str(main)
                if fixed.is_valid and len(fixed):
                    if (held := sets.get(key)) is None or held[0] != fixed:
                        sets = {key: (fixed, set(fixed.as_py()))}
                    chosen = sets[key][1]
                else:
                    chosen = set()
                texts.append(extract(parse(text.as_py() or ""), main, chosen))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "main", "fixed").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def op8_html(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
