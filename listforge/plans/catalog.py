"""Registered queries: every operator on the tables at hand, with equivalent SQL where SQL can express it.

The tables hold no job listings, so listings are made of orders: an order's customer is the company, its nation the
place, its priority the title, its date the closing day.  ``LISTINGS`` is the same table in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import contacts, dates, describe, numbers, text, urls
from ..operators import lifecycle, quality, relevance, resolve, summary
from ..operators import select as search
from ..operators.expand import numbered_positions
from ..operators.normalize import clean_details, normalize, stable_id
from ..operators.schema import detail, detail_of
from ..sources import html, paged
from ..sources.boards import SHOWN
from ..sources.feed import csv_rows
from .components import components

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}
TODAY = "1998-06-01"


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


LISTINGS = """listings as (
  select cast(o_orderkey as varchar) id, lower(c_mktsegment) source, o_orderpriority title, c_name company, n_name || ', Afghanistan' as location, c_mktsegment category,
         cast(o_orderdate as date) closing_date, cast(o_orderdate as date) - cast(20 + o_orderkey % 10 as int) post_date,
         case when o_orderstatus = 'F' then 'Closed' else 'open' end status, cast(o_orderkey % 14 as varchar) vacancies,
         case o_orderkey % 5 when 0 then null when 1 then 'Negotiable' when 2 then cast(o_orderkey % 900 + 100 as varchar) || ' - ' || cast(o_orderkey % 900 + 200 as varchar) || ' USD per month' when 3 then 'as per company scale' else cast(o_orderkey % 90 + 10 as varchar) || ',000 AFN monthly' end salary
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def listings(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    pay = (
        F.when(k % 5 == 0, None)
        .when(k % 5 == 1, "Negotiable")
        .when(k % 5 == 2, F.concat((k % 900 + 100).cast("string"), F.lit(" - "), (k % 900 + 200).cast("string"), F.lit(" USD per month")))
        .when(k % 5 == 3, "as per company scale")
        .otherwise(F.concat((k % 90 + 10).cast("string"), F.lit(",000 AFN monthly")))
    )
    day = F.to_date("o_orderdate")
    return joined.select(
        k.cast("string").alias("id"), F.lower("c_mktsegment").alias("source"), F.col("o_orderpriority").alias("title"), F.col("c_name").alias("company"), F.concat("n_name", F.lit(", Afghanistan")).alias("location"), F.col("c_mktsegment").alias("category"),
        day.alias("closing_date"), F.date_sub(day, (20 + k % 10).cast("int")).alias("post_date"), F.when(F.col("o_orderstatus") == "F", "Closed").otherwise("open").alias("status"), (k % 14).cast("string").alias("vacancies"), pay.alias("salary"),
    )


OPEN = f"lower(status) <> 'closed' and closing_date >= date '{TODAY}'"
COUNT = "case when cast(vacancies as int) > 0 then cast(vacancies as int) end"
KIND = "case when salary is null then 'undisclosed' when salary = 'Negotiable' then 'negotiable' when salary like 'as per%' then 'scale' else 'numeric' end"


# --- filters, facets, orders ---------------------------------------------------------------------------------


@query(f"with {LISTINGS} select id, closing_date from listings where {OPEN}")
def open_listings(spark, sf):
    return search.derived(listings(spark, sf), TODAY).where(search.is_open()).select("id", "closing_date")


@query(f"with {LISTINGS} select id, closing_date - date '{TODAY}' as days from listings where {OPEN} and closing_date <= date '{TODAY}' + 3")
def expiring_soon(spark, sf):
    return search.select(listings(spark, sf), TODAY, filter="expiring").select("id", F.col("_days").cast("long").alias("days"))


@query(f"with {LISTINGS} select id, date '{TODAY}' - post_date as age from listings where {OPEN} and date '{TODAY}' - post_date between 0 and 6")
def recent_window(spark, sf):
    return search.select(listings(spark, sf), TODAY, filter="recent").select("id", F.datediff("_today", "_posted").cast("long").alias("age"))


@query("with last as (select user_id, max(ts) seen from events group by 1) select user_id, date '2024-01-30' - cast(seen + interval '4 hours 30 minutes' as date) > 2 as stale from last")
def freshness_check(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    seen = last.select("user_id", dates.instant_text(F.col("ts").cast("timestamp")).alias("last_seen_at"))
    return search.derived(seen, "2024-01-30").select("user_id", search.needs_check(2).alias("stale"))


@query("select cast(ts + interval '4 hours 30 minutes' as date) as day_kabul, count(*) n from events group by 1")
def kabul_day_counts(spark, sf):
    return table(spark, sf, "events").groupBy(dates.kabul_day(F.col("ts").cast("timestamp")).alias("day_kabul")).agg(F.count("*").alias("n"))


@query("select doc_id from documents where contains(lower(text), 'the') and contains(lower(text), 'license')")
def term_search(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("description"))
    for c in ("title", "company", "location", "source", "category", "job_type"):
        docs = docs.withColumn(c, F.lit(None).cast("string"))
    return docs.withColumn("details", F.lit(None).cast("map<string,string>")).where(search.matches("  The LICENSE ")).select("doc_id")


@query(f"with {LISTINGS} select id, company, {COUNT} as openings from listings where {OPEN} and lower(location) = 'nation_3, afghanistan' and {KIND} = 'numeric' and {COUNT} between 2 and 5")
def facet_select(spark, sf):
    return search.select(listings(spark, sf), TODAY, location="NATION_3", salary="numeric", vacancy="2-5").select("id", "company", F.col("_openings").cast("int").alias("openings"))


@query("select case when p_size = 1 then '1' when p_size <= 5 then '2-5' when p_size <= 10 then '6-10' else '11+' end as bucket, count(*) n from part group by 1")
def bucket_histogram(spark, sf):
    count = numbers.vacancy_count(F.concat_ws(" ", F.col("p_size").cast("string"), F.lit("positions")))
    return table(spark, sf, "part").groupBy(numbers.vacancy_bucket(count).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"with {LISTINGS}, o as (select * from listings where {OPEN}) select count(*) filter ({KIND} <> 'undisclosed') listed, count(*) filter ({KIND} = 'numeric') comparable, count(*) filter ({KIND} = 'scale') as scale, count(*) filter ({KIND} = 'negotiable') negotiable, count({COUNT}) vacancies_listed, count(*) filter ({COUNT} = 1) single, count(*) filter ({COUNT} between 2 and 5) two_to_five, count(*) filter ({COUNT} >= 11) eleven_plus from o")
def facet_counts(spark, sf):
    s, v = (lambda n: F.col(f"salary.{n}").alias(n)), (lambda n, a=None: F.col(f"vacancies.{n}").alias(a or n))
    return search.facets(listings(spark, sf), TODAY).select(s("listed"), s("comparable"), s("scale"), s("negotiable"), v("listed", "vacancies_listed"), v("single"), v("two_to_five"), v("eleven_plus"))


@query(f"with {LISTINGS}, o as (select * from listings where {OPEN}) select 'company' as facet, company as value, count(*) as n from o group by 2 union all select 'location', split_part(location, ',', 1), count(*) from o group by 2 union all select 'category', 'Other Technology', count(*) from o having count(*) > 0")
def facet_values(spark, sf):
    return search.facet_values(listings(spark, sf), TODAY)


@query(f"with {LISTINGS} select count(*) total, count(*) filter (closing_date <= date '{TODAY}' + 3) expiring, count(*) filter (date '{TODAY}' - post_date between 0 and 6) recent from listings where {OPEN}")
def view_stats(spark, sf):
    return search.stats(listings(spark, sf), TODAY)


@query("select source as name, count(*) as n, min(n_chars) shortest, max(n_chars) longest from documents group by 1")
def source_counts(spark, sf):
    return lifecycle.source_counts(table(spark, sf, "documents"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest")).withColumnRenamed("source", "name")


@query("select event_type as name, count(*) as count, min(ts) oldest_seen_at, max(ts) latest_seen_at from events group by 1")
def source_summary(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.lit(None).cast("string").alias("last_seen_at"), F.col("ts").cast("timestamp").alias("scraped_at"), F.lit(None).cast("string").alias("first_seen_at"))
    out = summary.source_summary(e)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("oldest_seen_at", "latest_seen_at")})


@query("select count(distinct lower(trim(source))) as boards from documents")
def distinct_boards(spark, sf):
    return search.boards(table(spark, sf, "documents").select("source", F.lit(None).cast("array<struct<source:string,url:string>>").alias("also_found_on")))


@query(f"with {LISTINGS} select id, closing_date, row_number() over (order by closing_date, post_date desc, title, id) place from listings where {OPEN} qualify place <= 25")
def publish_order_topk(spark, sf):
    rows = search.derived(listings(spark, sf), TODAY).where(search.is_open())
    order = [*search.deadline_order(), F.col("id")]
    top = rows.orderBy(*order).limit(25)  # a top-k, so that numbering sees 25 rows
    return top.select("id", "closing_date", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query(f"with {LISTINGS}, o as (select *, {COUNT} n from listings where {OPEN}) select 'newest' as mode, id, row_number() over (order by post_date desc, closing_date, title, id) place from o qualify place <= 12 union all select 'vacancies', id, row_number() over (order by n desc nulls last, closing_date, post_date desc, title, id) place from o qualify place <= 12 union all select 'company', id, row_number() over (order by lower(company), closing_date, post_date desc, title, id) place from o qualify place <= 12")
def multi_sort_modes(spark, sf):
    rows = search.derived(listings(spark, sf), TODAY).where(search.is_open())
    out = None
    for mode in ("newest", "vacancies", "company"):
        order = [*search.order_by(rows, mode), F.col("id")]
        top = search.page(rows.orderBy(*order), 0).unionByName(search.page(rows.orderBy(*order), search.PAGE)).limit(12)
        part = top.select(F.lit(mode).alias("mode"), "id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))
        out = part if out is None else out.unionByName(part)
    return out


@query("with r as (select c_mktsegment segment, o_orderkey, row_number() over (partition by c_mktsegment order by o_totalprice desc, o_orderkey) rn, count(*) over (partition by c_mktsegment) n from orders join customer on o_custkey = c_custkey) select segment, o_orderkey, cast(rn as int) as rn, greatest(n - 5, 0) as more from r where rn <= 5")
def top_n_per_group(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("segment"), "o_orderkey", "o_totalprice")
    return summary.top_in_groups(joined, "segment", [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("segment", "o_orderkey", F.col("place").alias("rn"), "more")


@query(f"with {LISTINGS} select (select count(*) from listings where id = '7') as by_id, (select max(closing_date) from listings) as latest")
def deep_link(spark, sf):
    rows = listings(spark, sf).withColumn("url", F.lit(None).cast("string"))
    return search.by_key(rows, "7").agg(F.count("*").alias("by_id")).crossJoin(rows.agg(F.max("closing_date").alias("latest")))


# --- joins, sets, state --------------------------------------------------------------------------------------


@query("with k as (select distinct cast(user_id as varchar) || ':' || event_type || ':' || cast(event_id % 3 as varchar) as id, ts >= timestamp '2024-01-16' as late from events) select id from k where late and id not in (select id from k where not late)")
def new_rows_antijoin(spark, sf):
    e = table(spark, sf, "events")
    rows = lambda d: d.select(F.concat_ws(":", "user_id", "event_type", F.col("event_id") % 3).alias("id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("array<struct<source:string,url:string>>").alias("also_found_on")).distinct()
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    at = F.col("ts").cast("timestamp_ntz")
    return summary.new_rows(rows(e.where(at >= cut)), rows(e.where(at < cut))).select("id").distinct()


@query("select row_number() over (order by o_totalprice desc, o_orderkey) - 1 as position, o_orderkey, c_name from orders join customer on o_custkey = c_custkey qualify position < 20")
def hydrate_ids(spark, sf):
    o = table(spark, sf, "orders")
    top = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_totalprice", F.col("o_orderkey").cast("string").alias("id"))
    one = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), F.col("id").cast("long").alias("k")))), lambda x: x["k"].cast("string")).alias("ids"))
    feed = o.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey", "c_name")
    return summary.hydrate(one, feed, "ids").select(F.col("position").cast("long").alias("position"), "o_orderkey", "c_name")


@query("select 'lineitem without order' as check_name, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'label without document', count(*) from labels where doc_id not in (select doc_id from documents) union all select 'nation counts differ', count(*) from (select n_nationkey k, count(*) c from nation join customer on n_nationkey = c_nationkey group by 1) a full join (select n_nationkey k, count(*) c from nation join supplier on n_nationkey = s_nationkey group by 1) b using (k) where coalesce(a.c, 0) <> coalesce(b.c, 0)")
def ref_integrity(spark, sf):
    l, o, d, lab, c, s = (table(spark, sf, t) for t in ("lineitem", "orders", "documents", "labels", "customer", "supplier"))
    lost = lambda rows, name: rows.agg(F.lit(name).alias("check_name"), F.count("*").alias("n"))
    out = lost(quality.lost_references(l, "l_orderkey", o, "o_orderkey"), "lineitem without order")
    out = out.unionByName(lost(quality.lost_references(lab, "doc_id", d, "doc_id"), "label without document"))
    return out.unionByName(lost(quality.differing_counts(c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k")), "k"), "nation counts differ"))


CUT = "2024-01-16"


def _run(spark, sf, late: bool, at: str) -> DataFrame:
    at_ = F.col("ts").cast("timestamp_ntz")
    cut = F.lit(CUT).cast("timestamp_ntz")
    e = table(spark, sf, "events").where(at_ >= cut if late else at_ < cut)
    item = F.concat_ws("-", "user_id", F.col("event_id") % 2)
    url = F.concat(F.lit("https://x.example/"), item)
    raw = e.select(F.col("event_type").alias("source"), url.alias("url"), url.alias("source_url"), F.concat_ws(" ", F.col("event_type"), item).alias("title")).distinct()
    return raw.withColumns({"id": stable_id(F.col("source"), F.col("url")), "scraped_at": F.lit(at)})


@query("""with p as (select distinct event_type source, user_id, event_id % 2 e from events where ts < timestamp '2024-01-16'), f as (select distinct event_type source, user_id, event_id % 2 e from events where ts >= timestamp '2024-01-16'),
st as (select source, row_number() over (order by source) % 3 as k from (select distinct event_type source from events)), a as (select f.source, 'active' s, 0 as m, count(*) n from f group by 1 union all select p.source, 'active', 0, count(*) from p join f using (source, user_id, e) group by 1
union all select p.source, case st.k when 0 then 'unconfirmed' when 1 then 'source_unavailable' else 'unmanaged' end, case st.k when 0 then 1 else 0 end, count(*) from p anti join f using (source, user_id, e) join st using (source) group by 1, 2, 3)
select source, s as lifecycle_status, cast(m as int) as missed_runs, cast(sum(n) as bigint) as n from a group by 1, 2, 3""")
def lifecycle_reconcile(spark, sf):
    old = normalize(_run(spark, sf, False, "2024-01-15T00:00:00Z"), "2024-01-15T00:00:00Z")
    new = normalize(_run(spark, sf, True, "2024-01-31T00:00:00Z"), "2024-01-31T00:00:00Z")
    kinds = table(spark, sf, "events").select(F.col("event_type").alias("source")).distinct()
    k = F.row_number().over(Window.orderBy("source")) % 3
    status = kinds.withColumn("k", k).select("source", F.when(F.col("k") == 0, "healthy").when(F.col("k") == 1, "failed").otherwise("skipped").alias("status"))
    out = lifecycle.reconcile(old, new, status, "2024-01-31T00:00:00Z")
    return out.groupBy("source", "lifecycle_status", "missed_runs").agg(F.count("*").alias("n"))


@query("with a as (select event_type source, count(*) filter (ts < timestamp '2024-01-16') previous, count(*) filter (ts >= timestamp '2024-01-16') as current from events group by 1), b as (select *, row_number() over (order by source) k from a) select source, current, previous, case when k = 1 then 'failed' when k = 2 then 'partial' when previous >= 8 and current < greatest(1, ceil(previous * 0.2)) then 'major_drop' else 'healthy' end as status from b")
def source_health(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    k = F.row_number().over(Window.orderBy("source"))
    runs = e.select("source").distinct().withColumn("k", k).select("source", (F.col("k") != 1).alias("ok"), (F.col("k") == 2).alias("partial"))
    return lifecycle.health(runs, e.where(F.col("ts") >= cut), e.where(F.col("ts") < cut)).select("source", "current", "previous", "status")


@query("select user_id, min(ts) first_seen, max(ts) last_seen, bool_or(event_type = 'purchase') any_purchase, min(value) least_value from events group by 1")
def first_seen_last_seen(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return lifecycle.seen_span(e, "user_id", "ts", F.bool_or(F.col("event_type") == "purchase").alias("any_purchase"), F.min("value").alias("least_value"))


@query("select role, text, min(conv_id) as conv_id from conversations group by 1, 2")
def first_occurrence(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("url", F.concat_ws(":", "role", F.sha2("text", 256)))
    return html.first_occurrences(rows, "conv_id", "turn").select("role", "text", "conv_id")


@query("with p as (select event_id // 100 as page, user_id % 40 as item from events), first as (select item, min(page) page from p group by 1), n as (select page, count(*) as fresh from first group by 1) select distinct p.page from p left join n using (page) where n.fresh is null or page in (select page from (select page, min(page) over (partition by sig) m from (select page, string_agg(distinct cast(item as varchar), ',' order by cast(item as varchar)) sig from p group by 1)) where m < page)")
def repeated_page_check(spark, sf):
    return html.stalled_pages(table(spark, sf, "events").select(F.floor(F.col("event_id") / 100).cast("long").alias("page"), F.col("event_id").alias("position"), (F.col("user_id") % 40).cast("string").alias("url")))


@query("select user_id, arg_max(event_type, (ts, event_id)) as last_type, min(event_id) as first_event from events group by 1")
def last_write_wins(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    last = lifecycle.last_writes(e, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("last_type"))
    first = lifecycle.last_writes(e, ["user_id"], ["event_id"]).select("user_id", F.col("first_at.event_id").alias("first_event"))
    return last.join(first, "user_id")


@query("select o_custkey, max(cast(o_orderdate as date)) as latest_day, arg_min(o_orderkey, (-epoch(o_orderdate), o_orderkey)) as latest_key, min(cast(o_orderdate as date)) as earliest_day, arg_min(o_orderkey, (epoch(o_orderdate), o_orderkey)) as earliest_key from orders group by 1")
def best_date_per_cluster(spark, sf):
    return resolve.best_days(table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate")), "o_custkey", "day", "o_orderkey")


@query("with k as (select doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as t from documents) select min(doc_id) as doc_id, count(*) - 1 as removed from k group by t")
def exact_dedupe(spark, sf):
    return resolve.exact_copies(table(spark, sf, "documents"), F.lower(text.squeeze(F.col("text"))), "doc_id")


@query()
def entity_resolution(spark, sf):
    """Pages as listings: same url but for tracking, then same title and host."""
    p = table(spark, sf, "pages")
    title = F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1)
    host = F.regexp_extract("url", r"://([^/]+)", 1)
    raw = p.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.regexp_extract(host, r"\.(\w+)$", 1).alias("source"), "url", title.alias("title"), host.alias("company"), F.lit("Kabul").alias("location"), F.lit("2026-01-01").alias("closing_date"))
    out = resolve.resolve(normalize(raw, "2026-01-01T00:00:00Z"), ["com", "org", "net"])
    return out.select("id", "source", "url", "merged.*")


# --- texts ---------------------------------------------------------------------------------------------------


@query("select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as squeezed, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as n from documents")
def normalize_text(spark, sf):
    s = text.squeeze(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", s.alias("squeezed"), F.length(s).cast("long").alias("n"))


@query(f"with a as (select doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as t from documents), b as (select doc_id, regexp_replace(regexp_replace(t, '(^|[^a-z0-9_])({text.NOISE})($|[^a-z0-9_])', '\\1 \\3', 'g'), '(^|[^a-z0-9_])({text.NOISE})($|[^a-z0-9_])', '\\1 \\3', 'g') as t from a) select doc_id, trim(regexp_replace(regexp_replace(t, '[\\p{{P}}\\p{{S}}]+', ' ', 'g'), '\\s+', ' ', 'g')) as folded from b")
def comparable_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.comparable(F.col("text")).alias("folded"))


@query("with e as (select doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}'), lambda x: lower(x)))) as email from documents) select doc_id, email from e")
def email_extract(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(text.emails(F.col("text"), None)).alias("email")).where(text.is_email(F.col("email")))


_NUMBER = "lpad(cast(c_custkey as varchar), 6, '0')"


@query(f"select c_custkey, '+93700' || {_NUMBER} as phone from customer where c_custkey % 5 <> 4")
def phone_extract(spark, sf):
    """Numbers written in four ways, found in a text; a fifth one is an amount, with no word for a phone near it."""
    k, n = F.col("c_custkey") % 5, F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    said = F.when(k == 0, F.concat(F.lit("call 0700"), n)).when(k == 1, F.concat(F.lit("+93 (700) "), F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 3))).when(k == 2, F.concat(F.lit("0093-700-"), n)).when(k == 3, F.concat(F.lit("Mobile: 93700"), n, F.lit("; mobile 93700"), n)).otherwise(F.concat(F.lit("0700"), n, F.lit(" units")))
    return table(spark, sf, "customer").select("c_custkey", F.explode(contacts.phones(F.concat("c_name", F.lit(" of 10.0.70.1, "), said, F.lit(", 5 - 7")), None)).alias("phone"))


_TAGS = "'<[^>]+>', ' ', 'g')"
_HTML = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', ' ', 'gis'), '<style.*?</style>', ' ', 'gis'), '<br\\s*/?>', chr(10), 'gi'), '</(?:p|li|h[1-6]|div|tr|table|ul|ol)>', chr(10), 'gi'), {_TAGS}"


@query(f"with t as (select page_id, replace(replace(replace(replace(replace(replace({_HTML}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''') as t from pages) select page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as lines from t")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_lines(F.col("html")).alias("lines"))


_CANON = "regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\\?(utm_[^&]*|ref=[^&]*)$|&(utm_[^&=]*|ref|source)=[^&]*', ''), '/+(\\?|$)', '\\1')"


@query(f"select page_id, {_CANON} as canonical from pages")
def url_canonical(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query(f"select {_CANON} as canonical, min(page_id) as page_id, count(*) as n from pages group by 1")
def url_dedupe(spark, sf):
    return table(spark, sf, "pages").groupBy(urls.canonical_url(F.col("url")).alias("canonical")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query("select page_id, cast(list_max(list_transform(regexp_extract_all(url || ' ' || html, '[?&]page=(\\d{1,9})', 1), lambda x: cast(x as int))) as int) as last_page from pages")
def page_count(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.page_number(F.concat_ws(" ", "url", "html")).alias("last_page"))


@query("with l as (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as href from pages) select page_id, count(*) as links, count(distinct href) as targets from l group by 1")
def link_extract(spark, sf):
    links = table(spark, sf, "pages").select("page_id", F.explode(urls.links(F.col("html"))).alias("href"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("href").alias("targets"))


@query("with m as (select page_id, regexp_extract_all(html, '<li><a href=\"([^\"]+)\">[^<]*</a></li>', 1) as h, regexp_extract_all(html, '<li><a href=\"[^\"]+\">([^<]*)</a></li>', 1) as t from pages), l as (select page_id, unnest(range(len(h))) as i, h, t from m) select page_id, cast(i as int) as position, 'https://board.example' || h[i + 1] as url, replace(t[i + 1], '&amp;', '&') as title from l")
def listing_cards(spark, sf):
    """Cards of the pages' menus, through a board adapter."""
    board = html.Adapter(source="menu", base="https://board.example/", cards="nav li", link="a[href]")
    return html.listing_rows(table(spark, sf, "pages").select("page_id", "html"), board).select("page_id", "position", "url", "title")


@query("select doc_id, cast(least(3, cast(contains(' ' || t || ' ', ' license ') as int) + cast(contains(' ' || t || ' ', ' the ') as int) + cast(contains(' ' || t || ' ', ' und ') as int)) * 10 as int) as score from (select doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) t from documents)")
def phrase_score(spark, sf):
    t = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    return table(spark, sf, "documents").select("doc_id", (F.least(F.lit(3), F.size(text.phrases_in(t, ["license", "the", "und"]))) * 10).cast("int").alias("score"))


FLAG_WORDS = ["license", "copyright", "released under", "licensed under"]


@query()
def relevance_audit(spark, sf):
    """Decisions of the classifier, with a lexicon of its own, against labels."""
    lex = relevance.Lexicon(strong=FLAG_WORDS, support=["the", "die", "que"], body_role=["mit license", "public license"])
    docs = table(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n", -1).alias("title"), F.col("text").alias("description"))
    out = relevance.assess(docs, lex).join(table(spark, sf, "labels"), "doc_id")
    return out.groupBy("relevance.decision", "quality").agg(F.count("*").alias("n"))


@query("with j as (select doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '(?i)(^|[^a-z0-9_])([bm])\\s*\\.\\s*(s|sc)\\s*\\.', '\\1\\2\\3', 'g'), '(?i)(^|[^a-z0-9_])([bm])\\s*\\.\\s*(s|sc)\\s*\\.', '\\1\\2\\3', 'g') as t from documents) select doc_id, cast(len(list_filter(list_transform(string_split_regex(t, '[\\r\\n;!?•]+|\\.(?:\\s+|$)'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]'))) as bigint) as clauses from j")
def clause_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.clauses(F.col("text"))).cast("long").alias("clauses"))


@query()
def bundle_expand(spark, sf):
    """Two numbered positions put around each document's text, split again."""
    body = F.concat(F.lit("1. First officer - 2 positions\n"), F.col("text"), F.lit("\n2) Second officer\nVacancies: 3\nJob requirements\nNone"))
    roles = table(spark, sf, "documents").select("doc_id", F.explode(numbered_positions(body)).alias("r"))
    return roles.select("doc_id", "r.number", "r.title", "r.openings", F.length("r.text").alias("n"))


@query()
def describe_blocks(spark, sf):
    b = table(spark, sf, "documents").select("doc_id", F.explode(describe.description_blocks(F.col("text"))).alias("b"))
    return b.groupBy("doc_id", "b.type").agg(F.count("*").alias("n"))


# --- scalars -------------------------------------------------------------------------------------------------



@query("select o_orderkey, case when year(o_orderdate) >= 2000 then cast(o_orderdate as date) end as closing, cast(o_orderdate as date) as shown from orders")
def date_parse(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "d MMMM yyyy")).when(k == 2, F.date_format(d, "MMM d, yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", dates.closing_day(F.concat(F.lit("by "), raw)).alias("closing"), dates.shown_day(raw).alias("shown"))


@query(f"with {LISTINGS} select id, {KIND} as kind, cast(case when {KIND} = 'numeric' then case when salary like '%USD%' then cast(id as int) % 900 + 100 else (cast(id as int) % 90 + 10) * 1000 end end as double) as minimum, cast(case when {KIND} = 'numeric' then case when salary like '%USD%' then cast(id as int) % 900 + 200 else (cast(id as int) % 90 + 10) * 1000 end end as double) as maximum, case when {KIND} = 'numeric' then case when salary like '%USD%' then 'USD' else 'AFN' end end as currency from listings")
def salary_parse(spark, sf):
    s = listings(spark, sf).select("id", numbers.salary_text(F.col("salary")).alias("s"))
    pay = s.withColumn("pay", numbers.comparable_salary(F.col("s")))
    return pay.select("id", numbers.salary_kind(F.col("s"), F.col("pay")).alias("kind"), "pay.minimum", "pay.maximum", "pay.currency")


@query("select p_partkey, case p_partkey % 3 when 0 then p_size when 1 then p_size else 12 end as n from part")
def vacancy_parse(spark, sf):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("No. of jobs: "), size)).when(k == 1, F.concat(size, F.lit(" (several) positions"))).otherwise("a Twelve openings")
    return table(spark, sf, "part").select("p_partkey", numbers.vacancy_count(raw).cast("int").alias("n"))


@query("with s as (select p_partkey, unnest(list_distinct(list_filter(list_transform(string_split_regex(p_name || '; ' || p_brand || ' | ' || p_brand, '[,;|]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''))) as place from part) select place, count(*) as n from s group by 1")
def location_split(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit("; "), "p_brand", F.lit(" | "), "p_brand", F.lit(", Afghanistan")).alias("location"))
    return search.derived(parts, TODAY).select(F.explode("_places").alias("place")).groupBy("place").agg(F.count("*").alias("n"))


_TITLES = ["Senior Web Developer", "Fiber Network Technician", "Head of IT", "Officer", "Database Officer", "Back-end programmer", "ICT & Communication", "Product Service Delivery Lead", "Helpdesk", "IT  project manager", "Mobile money agent"]
_IN_SQL = "case p_partkey % 11 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(_TITLES)) + " end"


@query(f"with t as (select p_partkey, lower({_IN_SQL}) as title, lower({_IN_SQL} || case when p_partkey % 7 = 0 then ' runs the help desk' else '' end) as context from part) select p_partkey, case when regexp_matches(title, '\\b(software|web|frontend|front-end|backend|back-end|full[ -]?stack|mobile|wordpress|php|programmer|application)\\b') and regexp_matches(title, '\\b(developer|development|engineer|intern|specialist|programmer)\\b') then 'Software & Web' when regexp_matches(title, '\\b(network|telecom|fiber|ict\\s*(&|and)\\s*communication)\\b') then 'Network & Telecom' when regexp_matches(title, '\\b(head\\s+of\\s+it|product\\s*&?\\s*service\\s+delivery|it\\s+project\\s+manager)\\b') then 'IT Leadership' when regexp_matches(context, '\\b(database|technician|help\\s*desk|support)\\b') then 'IT Operations' else 'Other Technology' end as role from t")
def role_taxonomy(spark, sf):
    k = F.col("p_partkey")
    title = F.element_at(F.array(*[F.lit(t) for t in _TITLES]), (k % len(_TITLES) + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", title.alias("title"), F.when(k % 7 == 0, "runs the help desk").alias("description"))
    return search.derived(rows, TODAY).select("p_partkey", F.col("_role").alias("role"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def details_lookup(spark, sf):
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", F.coalesce(detail(clean_details(m), "(?i)^K$"), detail_of(m, "k")).alias("k"))


@query("select o_orderkey, substr(sha1(o_orderstatus || '|' || cast(o_custkey as varchar) || '|' || o_orderpriority), 1, 16) as id from orders")
def stable_ids(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", stable_id(F.col("o_orderstatus"), F.col("o_custkey"), F.col("o_orderpriority")).alias("id"))


@query("select c_custkey, cast((c_name <> '')::int + (c_mktsegment <> '')::int + (c_acctbal > 0)::int as int) as filled from customer")
def completeness_score(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", quality.completeness(F.col("c_name"), F.col("c_mktsegment"), F.when(F.col("c_acctbal") > 0, "y")).alias("filled"))


_RULES = f"""with {LISTINGS}, l as (select *, cast(id as bigint) k from listings) select 'url is missing' as rule, 'error' as severity, count(*) as n from l where k % 10 = 0 having count(*) > 0
union all select 'source_url is missing', 'error', count(*) from l where k % 10 = 0 having count(*) > 0 union all select 'application method is unknown to the schema', 'error', count(*) from l where k % 3 = 2 having count(*) > 0
union all select 'method email without an address', 'error', count(*) from l where k % 3 = 0 having count(*) > 0 union all select 'method web without a link', 'error', count(*) from l where k % 3 = 1 and k % 10 = 0 having count(*) > 0
union all select 'closing_date is no day', 'error', count(*) from l where closing_date < date '2000-01-01' having count(*) > 0 union all select 'post_date is no day', 'error', count(*) from l where post_date < date '2000-01-01' having count(*) > 0
union all select 'missed runs are negative', 'error', count(*) from l where k % 7 = 0 having count(*) > 0 union all select 'relevance is missing', 'error', count(*) from l having count(*) > 0
union all select 'description is missing', 'warning', count(*) from l where k % 2 = 1 having count(*) > 0 union all select 'expired', 'warning', count(*) from l where closing_date < date '{TODAY}' having count(*) > 0
union all select 'url is not unique', 'error', count(*) from (select k // 4 from l where k % 10 <> 0 group by 1 having count(*) > 1) having count(*) > 0"""


@query(_RULES)
def dq_violations(spark, sf):
    """All rules of a feed, over listings that break some of them."""
    k = F.col("id").cast("long")
    url = F.when(k % 10 != 0, F.concat(F.lit("https://x.example/"), F.floor(k / 4).cast("string")))
    at = F.lit("2024-01-01T00:00:00Z")
    rows = listings(spark, sf).withColumns({"url": url, "source_url": url, "apply_url": url, "application_method": F.element_at(F.array(F.lit("email"), F.lit("web"), F.lit("fax")), (k % 3 + 1).cast("int")), "missed_runs": F.when(k % 7 == 0, -1).otherwise(0), "description": F.when(k % 2 == 0, "d"), "lifecycle_status": F.lit("active"), "scraped_at": at, "first_seen_at": at, "last_seen_at": at})
    for n, t in (("apply_emails", "array<string>"), ("apply_phones", "array<string>")):
        rows = rows.withColumn(n, F.array().cast(t))
    return quality.violations(rows, TODAY).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query("with a as (select event_type, count(*) filter (ts < timestamp '2024-01-16') base, count(*) filter (ts >= timestamp '2024-01-16') as current from events group by 1) select event_type, cast(ceil(base * 0.65) as bigint) as least_allowed, current, current >= ceil(base * 0.65) as passes from a")
def baseline_gate(spark, sf):
    cut, at = F.lit("2024-01-16").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")
    a = table(spark, sf, "events").groupBy("event_type").agg(F.count_if(at < cut).alias("base"), F.count_if(at >= cut).alias("current"))
    least = quality.least_allowed(F.col("base"))
    return a.select("event_type", least.cast("long").alias("least_allowed"), "current", (F.col("current") >= least).alias("passes"))


@query("select doc_id, case when regexp_matches(c, '[,\"\\n]') then '\"' || replace(c, '\"', '\"\"') || '\"' else c end as cell from (select doc_id, case when regexp_matches(text, '^[=+\\-@\\t\\r]') then '''' || text else text end as c from documents)")
def csv_escape(spark, sf):
    return csv_rows(table(spark, sf, "documents").withColumn("cell", F.col("text")), ["doc_id", "cell"]).select(F.col("doc_id").cast("long").alias("doc_id"), "cell")


@query()
def mail_links(spark, sf):
    """Links with the whole text of every turn; DuckDB's url_encode writes ``~`` and ``*`` in another way."""
    link = urls.mail_link(F.concat("role", F.lit("@x.example")), F.col("text"), F.lit(True))
    return table(spark, sf, "conversations").select("conv_id", "turn", link.alias("link"))


@query(f"with {LISTINGS}, o as (select * from listings where {OPEN} and {KIND} = 'numeric'), k as (select company, title, min(cast(id as bigint)) as id, count(*) - 1 as removed from o group by 1, 2) select cast(k.id as varchar) as id, k.removed, closing_date, row_number() over (order by closing_date, post_date desc, o.title, k.id) as place from k join o on o.id = cast(k.id as varchar) qualify place <= 100")
def flagship(spark, sf):
    """Open listings with a salary that can be compared, one of each company and title, by their deadline: the first hundred."""
    rows = search.select(listings(spark, sf), TODAY, salary="numeric").withColumn("key", F.col("id").cast("long"))
    kept = resolve.exact_copies(rows, F.concat_ws("|", "company", "title"), "key")
    order = [*search.deadline_order(), F.col("key")]
    top = rows.join(kept, "key").orderBy(*order).limit(100)  # a top-k, so that numbering sees 100 rows
    return top.select("id", "removed", "closing_date", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("with recursive e as (select o_orderkey a, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) b from orders), u as (select a, b from e where b is not null union all select b, a from e where b is not null), r as (select distinct a as id, a as low from u union select u.b, r.low from r join u on u.a = r.id where r.low < u.b) select id, min(low) as component from r group by 1")
def connected_components(spark, sf):
    """Orders linked with the next one of their customer."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    edges = table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(order).alias("b"))
    return components(edges)


@query("select source, case lower(source) when 'acbar' then 'ACBAR' when 'kaarobar' then 'Kaarobar' else source end as shown, min(doc_id) as doc_id from (select doc_id, case doc_id % 4 when 0 then 'acbar' when 1 then 'Kaarobar' else source end as source from documents) group by 1")
def source_names(spark, sf):
    k = F.col("doc_id") % 4
    rows = table(spark, sf, "documents").select("doc_id", F.when(k == 0, "acbar").when(k == 1, "Kaarobar").otherwise(F.col("source")).alias("source"))
    return rows.groupBy("source").agg(F.min("doc_id").alias("doc_id")).select("source", search.source_name(F.col("source"), SHOWN).alias("shown"), "doc_id")


@query("select o_orderkey, strftime(o_orderdate, '%B %-d, %Y') as long_day, strftime(o_orderdate, '%b %-d, %Y') as short_day from orders")
def display_days(spark, sf):
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", dates.display_day(day).alias("long_day"), dates.display_day(day, True).alias("short_day"))


@query("with l as (select event_id // 100 as page, max(user_id % 13) as linked from events group by 1), s as (select page, linked, max(case when linked > page then linked end) over (order by page rows unbounded preceding) as known from l) select page, case when known is not null then greatest(known, linked) end as last, known is not null as known from s")
def last_page_known(spark, sf):
    pages = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 100).cast("long").alias("page")).agg(F.max(F.col("user_id") % 13).alias("linked"))
    return paged.last_pages(pages)


@query(f"with {LISTINGS} select id, closing_date from listings where closing_date >= date '1998-06-02'")
def legacy_open(spark, sf):
    return lifecycle.still_open_legacy(listings(spark, sf), "1998-06-01T19:30:00Z").select("id", "closing_date")


FLAGSHIP = flagship
