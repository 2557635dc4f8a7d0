"""Entity resolution: listings of one vacancy become one row, in any order of the input.

Records first merge by canonical url, then by reference, then by role (title, company, place; other source only),
then by fingerprint (role and closing day); different references are never merged, and neither are two clusters.
The pass over records is greedy and in canonical order, so its result depends on that order alone.  Records interact
through equal keys only: connected components over the keys are independent of each other, are found with joins,
and each is replayed in order on its own.  A component of one record never reaches Python.

A component is a superset of its clusters.  It is as large as the records that share keys; a key shared by many records
(an url, a reference) names one vacancy, so these records are the copies of one row.  Both passes read sorted rows one
after the other: the copies of an url leave one record in memory, a component leaves its clusters.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.contacts import merged_method
from ..plans.components import components
from ..plans.skew import spread_join
from .normalize import REFERENCE, stable_id
from .schema import COLUMNS, LISTING, detail

#: Fields that a merge fills in, and those that count for completeness.
FILLED = "title company location post_date post_date_raw closing_date closing_date_raw category job_type gender vacancies salary application_method application_subject application_subject_type apply_url description".split()
COUNTED = "title company location post_date closing_date category job_type gender vacancies salary application_method application_subject apply_url description".split()
STAGES = ("exact", "reference", "role", "fingerprint")
#: Rows of a frame that goes back to Spark.
BATCH = 2_000


def source_rank(source: Column, priority: list[str]) -> Column:
    at = F.array_position(F.array(*[F.lit(p) for p in priority]), F.lower(text.squeeze(source)))
    return F.lpad(F.when(at > 0, at - 1).otherwise(len(priority)).cast("string"), 4, "0")


def listing_url(df_url: Column, df_source_url: Column) -> Column:
    return urls.canonical_url(F.coalesce(F.nullif(text.squeeze(df_source_url), F.lit("")), df_url))


def reference_text(details: Column) -> Column:
    """A reference without the words that say it is one."""
    return text.squeeze(text.rx(text.comparable(detail(details, REFERENCE)), text.word("vacancy|reference|ref|number|no"), " "))


def keys(df: DataFrame, priority: list[str]) -> DataFrame:
    """Adds the url, the order, and the three keys of each record; a key is null where a part is missing."""
    c = F.col
    step = df.withColumns({"_url": listing_url(c("url"), c("source_url")), "_title": text.comparable(c("title")), "_company": text.company_key(c("company")), "_place": text.location_key(c("location")), "_ref": reference_text(c("details"))})
    order = F.concat_ws("|", source_rank(c("source"), priority), F.lower(text.squeeze(c("source"))), c("_url"), c("_title"), text.squeeze(c("id")))
    whose = F.when(c("_company") != "", c("_company")).otherwise(c("_title"))
    full = (c("_title") != "") & (c("_company") != "") & (c("_place") != "")
    day = text.comparable(c("closing_date").cast("string"))
    return step.withColumns(
        {
            "_order": order,
            "_reference": F.when((F.length("_ref") >= 2) & (whose != ""), F.concat_ws("|", F.lit("reference"), "_ref", whose)),
            "_role": F.when(full, F.concat_ws("|", F.lit("role"), "_title", "_company", "_place")),
            "_fingerprint": F.when(full & (day != ""), F.concat_ws("|", F.lit("fingerprint"), "_title", "_company", "_place", day)),
        }
    )


def stable_records(df: DataFrame, priority: list[str]) -> DataFrame:
    """Records found in several places take the first place in canonical order, and an id that names the vacancy."""
    c = F.col
    keyed = keys(df, priority)
    place = lambda s, u: F.struct(source_rank(s, priority).alias("rank"), F.lower(text.squeeze(s)).alias("name"), u.alias("url"), s.alias("source"))
    own = F.when(c("source").isNotNull() & (c("_url") != ""), F.array(place(c("source"), c("_url")))).otherwise(F.array().cast("array<struct<rank:string,name:string,url:string,source:string>>"))
    others = F.filter(F.transform("also_found_on", lambda x: place(x["source"], urls.canonical_url(x["url"]))), lambda x: x["url"] != "")
    places = F.array_distinct(F.array_sort(F.concat(own, F.coalesce(others, F.array().cast("array<struct<rank:string,name:string,url:string,source:string>>")))))
    step = keyed.withColumn("_places", places)
    several = F.size(F.array_distinct(F.transform("_places", lambda x: F.concat_ws("|", x["name"], x["url"])))) > 1
    identity = F.coalesce("_reference", "_role", "_fingerprint")
    rest = F.array_sort(F.transform(F.slice("_places", F.lit(2), F.greatest(F.size("_places"), F.lit(1))), lambda x: F.struct(x["source"].alias("source"), x["url"].alias("url"))))
    return step.withColumns(
        {
            "id": F.when(several & identity.isNotNull(), stable_id(F.lit("logical"), identity, F.lit(""))).otherwise(c("id")),
            "source": F.when(several, c("_places")[0]["source"]).otherwise(c("source")),
            "source_url": F.when(several, c("_places")[0]["url"]).otherwise(c("source_url")),
            "url": F.when(several, c("_places")[0]["url"]).otherwise(c("url")),
            "also_found_on": F.when(several, rest).otherwise(c("also_found_on")),
        }
    ).select(*df.columns)


def channel(df: DataFrame) -> DataFrame:
    """Sets the application method to one that the record's own fields back."""
    c = F.col
    listed = F.concat(F.array(urls.canonical_url(c("source_url")), urls.canonical_url(c("url"))), F.transform("also_found_on", lambda x: urls.canonical_url(x["url"])))
    mailto = F.size(urls.mail_recipients(c("apply_url"))) > 0
    web = urls.is_web(c("apply_url")) & ~F.coalesce(F.array_contains(listed, urls.canonical_url(c("apply_url"))), F.lit(False))
    some = lambda a: F.exists(F.coalesce(F.col(a), F.array().cast("array<string>")), lambda x: x != "")
    return df.withColumn("application_method", merged_method(c("application_method"), mailto, some("apply_emails"), web, some("apply_phones")))


# --- the replay of one component, on plain rows -----------------------------------------------------------


def _fold(s) -> str:
    s = unicodedata.normalize("NFKC", " ".join(str(s or "").split())).lower().translate(str.maketrans(*text.LETTERS)).replace("ـ", "")
    s = re.sub(text.word(text.NOISE), " ", s).translate(str.maketrans(*text.EASTERN))
    return " ".join("".join(" " if unicodedata.category(ch)[0] in "PS" else ch for ch in s).split())


def _canonical(url) -> str:
    raw = " ".join(str(url or "").split())
    try:
        u = urlsplit(raw)
    except ValueError:
        return raw.rstrip("/")
    if u.scheme.lower() not in ("http", "https") or not u.netloc:
        return raw.rstrip("/")
    kept = "&".join(p for p in u.query.split("&") if p and not re.match(urls.TRACKING, p.partition("=")[0]))
    return f"{u.scheme.lower()}://{u.netloc.lower()}{u.path.rstrip('/') or '/'}" + (f"?{kept}" if kept else "")


def _id(*parts) -> str:
    return hashlib.sha1("|".join(str(p or "") for p in parts).encode()).hexdigest()[:16]


def _empty(v) -> bool:
    return v is None or v == "" or v != v


class Replay:
    """Merges records, given as dicts, under a source priority."""

    def __init__(self, priority: list[str]):
        self.rank = {s: i for i, s in enumerate(priority)}

    def order(self, r: dict) -> tuple:
        name = " ".join(str(r["source"] or "").split()).lower()
        return self.rank.get(name, len(self.rank)), name, self.url(r), _fold(r["title"]), r["id"] or ""

    @staticmethod
    def url(r: dict) -> str:
        return _canonical(r["source_url"] or r["url"])

    def newer(self, a: dict, b: dict) -> tuple[dict, dict]:
        def worth(r):
            seen = r["last_seen_at"] or r["scraped_at"]
            filled = sum(not _empty(r[k]) for k in COUNTED) + len(r["details"] or {}) / 20
            return (pd.Timestamp(seen).value if not _empty(seen) else 0, filled)

        x, y = worth(a), worth(b)
        return (a, b) if x > y or x == y and self.order(a) <= self.order(b) else (b, a)

    def usable(self, apply_url, listed: set[str]) -> bool:
        if _empty(apply_url):
            return False
        if apply_url.lower().startswith("mailto:"):
            return "@" in apply_url
        return apply_url.lower().startswith("http") and _canonical(apply_url) not in listed

    def merge(self, a: dict, b: dict, identity: str | None = None) -> dict:
        """One record of two; ``identity`` is the key they share, if it is not their url."""
        main, other = ((a, b) if self.order(a) <= self.order(b) else (b, a)) if identity else self.newer(a, b)
        out = dict(main)
        for k in FILLED:
            if _empty(out[k]) and not _empty(other[k]):
                out[k] = other[k]
        listed = {_canonical(u) for r in (main, other) for u in [r["source_url"], r["url"], *(x["url"] for x in r["also_found_on"] or [])] if u}
        first, second = main["apply_url"], other["apply_url"]
        out["apply_url"] = next((u for u in (first, second) if self.usable(u, listed)), first or second or None)
        for k in ("apply_emails", "apply_phones"):
            out[k] = list(dict.fromkeys([*(main[k] or []), *(other[k] or [])]))
        out["details"] = {**(other["details"] or {}), **(main["details"] or {})}
        if identity:
            for k, last in (("closing", True), ("post", False)):
                dated = [r for r in (a, b) if not _empty(r[f"{k}_date"])]
                if dated:
                    day = (max if last else min)(r[f"{k}_date"] for r in dated)
                    best = min((r for r in dated if r[f"{k}_date"] == day), key=self.order)
                    out[f"{k}_date"], out[f"{k}_date_raw"] = day, best[f"{k}_date_raw"] or str(day)
            out["scraped_at"] = max((x for x in (a["scraped_at"], b["scraped_at"]) if not _empty(x)), default=None)
        times = lambda *names: [r[n] for r in (a, b) for n in names if not _empty(r[n])]
        out["first_seen_at"] = min(times("first_seen_at", "scraped_at"), default=None)
        out["last_seen_at"] = max(times("last_seen_at", "scraped_at"), default=None)
        out["active"] = a["active"] is not False or b["active"] is not False
        out["missed_runs"] = min(int(a["missed_runs"] or 0), int(b["missed_runs"] or 0))
        if not out["missed_runs"]:
            out["lifecycle_status"] = "active"
        here = self.url(out)
        places = [(x["source"], _canonical(x["url"])) for x in [*(main["also_found_on"] or []), {"source": other["source"], "url": self.url(other)}, *(other["also_found_on"] or [])] if x["source"] and x["url"]]
        out["also_found_on"] = [{"source": s, "url": u} for s, u in sorted(set(places)) if u and u != here]
        if identity or len({(str(s).lower(), u) for s, u in [(out["source"], here), *((x["source"], x["url"]) for x in out["also_found_on"])]}) > 1:
            named = identity or next((min(k) for n in ("_reference", "_role", "_fingerprint") if (k := [r[n] for r in (a, b) if not _empty(r[n])])), None)
            out["id"] = _id("logical", named, "") if named else out["id"]
        return out

    def by_url(self, records: Iterable[dict]) -> dict:
        """One record of the copies of an url, in order; a record that is merged is not kept."""
        copies = iter(records)
        out = next(copies)
        first, more = out["_order"], 0
        for r in copies:
            out, more = self.merge(out, r), more + 1
        return {**out, "_first": first, "_exact": more}

    def clusters(self, records: Iterable[dict]) -> list[tuple[dict, dict[str, int]]]:
        """The greedy pass: clusters, each with its counts of merged records by key."""
        out: list[dict] = []
        counts: list[dict[str, int]] = []
        index: dict[str, dict[str, int]] = {"reference": {}, "role": {}, "fingerprint": {}}
        for r in records:
            mine = {k: r[f"_{k}"] for k in index if not _empty(r[f"_{k}"])}
            at = how = None
            for k in index:
                found = index[k].get(mine.get(k))
                if found is None:
                    continue
                if k != "reference" and r["_ref"] and out[found]["_ref"] and r["_ref"] != out[found]["_ref"]:
                    continue
                if k == "role" and out[found]["source"] == r["source"]:
                    continue
                at, how = found, k
                break
            if at is None:
                at = len(out)
                out.append(r)
                counts.append({"exact": int(r["_exact"])})
            else:
                kept = out[at]
                out[at] = self.merge(kept, r, mine[how])
                out[at]["_ref"] = kept["_ref"] or r["_ref"] if self.order(kept) <= self.order(r) else r["_ref"] or kept["_ref"]
                counts[at][how] = counts[at].get(how, 0) + 1
                counts[at]["exact"] += int(r["_exact"])
            for k, v in mine.items():
                index[k][v] = at
        return list(zip(out, counts, strict=True))


def _plain(pdf: pd.DataFrame) -> list[dict]:
    """Rows as dicts of plain values: nested columns come as JSON, missing values as None."""
    rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
    for r in rows:
        for k in ("apply_emails", "apply_phones", "details", "also_found_on", "relevance"):
            r[k] = json.loads(r[k]) if r[k] else None
    return rows


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[Iterator[dict]]:
    """The rows of each key, one at a time, of batches that are sorted by it."""
    rows = (r for pdf in batches for r in _plain(pdf))
    return (group for _, group in groupby(rows, key=lambda r: r[key]))


def _frames(rows: Iterator[dict], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows in frames of a bounded size."""
    rows = iter(rows)
    while held := list(islice(rows, BATCH)):
        yield _frame(held, names)


def _in_order(df: DataFrame, key: str, *order) -> DataFrame:
    """All rows of a key in one partition, sorted; Spark's sort spills, so no key has to fit into memory."""
    return df.repartition(key).sortWithinPartitions(key, *order)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    for r in rows:
        for k in ("apply_emails", "apply_phones", "details", "also_found_on", "relevance"):
            r[k] = None if r[k] is None else json.dumps(r[k], ensure_ascii=False)
    return pd.DataFrame(rows, columns=names)


NESTED = {"apply_emails": "array<string>", "apply_phones": "array<string>", "details": "map<string,string>", "also_found_on": "array<struct<source:string,url:string>>", "relevance": "struct<version:int,score:double,threshold:double,decision:string,reasons:array<string>>"}
FLAT = ", ".join(f"{n} {'string' if n in NESTED else next(x for x in LISTING.split(', ') if x.startswith(n + ' ')).split(' ', 1)[1]}" for n in COLUMNS)
KEYS = ["_order", "_ref", "_reference", "_role", "_fingerprint"]


def _pack(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*[F.to_json(n, {"ignoreNullFields": "false"}).alias(n) if n in NESTED else F.col(n) for n in COLUMNS], *more)


def _unpack(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*[F.from_json(n, NESTED[n]).alias(n) if n in NESTED else F.col(n) for n in COLUMNS], *more)


def resolve(df: DataFrame, priority: list[str] = (), keep=None) -> DataFrame:
    """Canonical listings (see ``schema``), one a vacancy, with ``merged``: how many records each key merged into it.

    ``priority``: sources whose fields and urls are preferred, best first.  Records without a url are dropped.
    """
    priority, keep = list(priority), keep or (lambda d: d.checkpoint())
    replay = Replay(priority)
    rows = keep(keys(channel(stable_records(df.select(*COLUMNS), priority)), priority).where("_url <> ''"))
    # copies are counted apart from the rows, so that a url of many rows sorts none of them
    copies = rows.groupBy("_url").agg(F.count("*").alias("_n"), F.min("_order").alias("_first"))
    counted = spread_join(rows, copies, "_url", "_order")
    single = counted.where("_n = 1").select(*COLUMNS, F.col("_first"), F.lit(0).cast("long").alias("_exact"))

    def copies_merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames((replay.by_url(g) for g in _groups(batches, "_url")), [*COLUMNS, "_first", "_exact"])

    copied = _in_order(_pack(counted.where("_n > 1"), *KEYS, "_url"), "_url", "_order", F.asc_nulls_last("id"))
    many = copied.mapInPandas(copies_merged, f"{FLAT}, _first string, _exact long")
    urls_done = keep(keys(channel(single.unionByName(_unpack(many, "_first", "_exact"))), priority).withColumn("_row", F.sha1("_url")))

    tokens = urls_done.select("_row", F.explode(F.array_compact(F.array("_reference", "_role", "_fingerprint"))).alias("key"))
    shared = tokens.groupBy("key").agg(F.min("_row").alias("b"), F.count("*").alias("n")).where("n > 1")
    edges = tokens.join(shared, "key").where("_row <> b").select(F.col("_row").alias("a"), "b")
    named = components(edges, keep)
    grouped = urls_done.join(named.withColumnRenamed("id", "_row"), "_row", "left")
    zero = F.struct(F.col("_exact").alias("exact"), *[F.lit(0).cast("long").alias(k) for k in STAGES[1:]])
    alone = grouped.where("component is null").select(*COLUMNS, zero.alias("merged"))

    def replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = ({**out, "_counts": json.dumps(n)} for g in _groups(batches, "component") for out, n in replay.clusters(g))
        return _frames(done, [*COLUMNS, "_counts"])

    linked = _in_order(_pack(grouped.where("component is not null"), *KEYS, "_url", "_row", "_first", "_exact", "component"), "component", "_first", "_url")
    several = linked.mapInPandas(replayed, f"{FLAT}, _counts string")
    counts = F.from_json("_counts", "exact long, reference long, role long, fingerprint long")
    filled = F.struct(*[F.coalesce(counts[k], F.lit(0).cast("long")).alias(k) for k in STAGES])
    return channel(alone.unionByName(_unpack(several, "_counts").withColumn("merged", filled).drop("_counts")))


def exact_copies(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(id, removed) of the smallest id of each group of rows with equal keys, told by digests."""
    return df.groupBy(F.sha2(key, 256).alias("_k")).agg(F.min(id_col).alias(id_col), (F.count("*") - 1).alias("removed")).drop("_k")


def best_days(df: DataFrame, cluster: str, day: str, id_col: str) -> DataFrame:
    """The latest and the earliest day of each cluster, and which row has it; ties go to the smaller id."""
    at = F.unix_date(F.col(day))
    return df.groupBy(cluster).agg(
        F.max(day).alias("latest_day"), F.min_by(id_col, F.struct(-at, id_col)).alias("latest_key"), F.min(day).alias("earliest_day"), F.min_by(id_col, F.struct(at, id_col)).alias("earliest_key"),
    )


def removed(resolved: DataFrame) -> DataFrame:
    """One row: records removed by each key."""
    sums = [F.coalesce(F.sum(f"merged.{k}"), F.lit(0)).alias(f"{k}_removed") for k in STAGES]
    return resolved.agg(*sums).withColumn("removed", sum((F.col(f"{k}_removed") for k in STAGES), F.lit(0)))


