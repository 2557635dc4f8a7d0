"""Reconciling a run with the published state, the health of its sources, and what stops a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import REFERENCE
from .schema import COLUMNS, detail

GRACE, LEAST_BEFORE, DROP = 2, 8, 0.2


class RunAborted(RuntimeError):
    """The run is not published; the published state stays."""


def drop_floor(before: Column, share: float = DROP) -> Column:
    """The fewest rows that are no major drop from ``before``."""
    return F.greatest(F.lit(1), F.ceil(before * share))


def health(runs: DataFrame, current: DataFrame, published: DataFrame) -> DataFrame:
    """Runs (source, ok, partial, raw, error) with counts and a status: failed, partial, major_drop or healthy."""
    now = source_counts(current).withColumnRenamed("n", "current")
    before = source_counts(published).withColumnRenamed("n", "previous")
    both = runs.join(now, "source", "left").join(before, "source", "left").fillna(0, ["current", "previous"])
    dropped = (F.col("previous") >= LEAST_BEFORE) & (F.col("current") < drop_floor(F.col("previous")))
    return both.withColumn("status", F.when(~F.col("ok"), "failed").when(F.coalesce("partial", F.lit(False)), "partial").when(dropped, "major_drop").otherwise("healthy"))


def assert_healthy(sources: DataFrame, published: DataFrame, allow_major_drop: bool = False) -> None:
    """Raises ``RunAborted`` where the run must not replace what is published."""
    r = sources.agg(F.count_if("ok").alias("ok"), F.count_if(F.col("status") == "major_drop").alias("drops"), F.coalesce(F.sum("current"), F.lit(0)).alias("fresh"), F.coalesce(F.sum("raw"), F.lit(0)).alias("raw")).first()
    if not r.ok:
        raise RunAborted("no source succeeded")
    if r.drops and not allow_major_drop:
        raise RunAborted(f"{r.drops} sources lost most of their rows")
    if not r.fresh and (not r.raw or not published.isEmpty()):
        raise RunAborted("no fresh rows")


def source_counts(df: DataFrame, *more: Column, by: str = "source") -> DataFrame:
    """(``by``, n, ...) rows of each source, with further aggregates."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *more)


def seen_span(df: DataFrame, key: str, at: str, *more: Column) -> DataFrame:
    """(``key``, first_seen, last_seen, ...) of each key."""
    return df.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), *more)


def last_writes(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row by ``order`` of each key, and ``first_at``: the order of its first row, where it keeps its place."""
    others = [c for c in df.columns if c not in keys]
    at = F.struct(*order)
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*others), at).alias("_last"), F.min(at).alias("first_at"))
    return out.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others], "first_at")


def still_open_legacy(df: DataFrame, now: str) -> DataFrame:
    """Rows that the older rule keeps: no closing day, or one not before the day that is 270 minutes ahead of UTC."""
    day = F.date_format(F.to_timestamp(F.lit(now)) + F.expr("interval 270 minutes"), "yyyy-MM-dd")
    closing = F.col("closing_date").cast("string")
    return df.where(F.coalesce(closing, F.lit("")).isin("") | (closing >= day))


def _keys() -> Column:
    url = F.concat_ws("|", F.lit("u"), "source", F.coalesce("source_url", "url"))
    reference = detail(F.col("details"), REFERENCE)
    return F.array_compact(F.array(F.when(F.coalesce("source_url", "url").isNotNull(), url), F.when(reference.isNotNull(), F.concat_ws("|", F.lit("r"), "source", F.lower(reference)))))


def reconcile(published: DataFrame, fresh: DataFrame, sources: DataFrame, now: str, grace: int = GRACE) -> DataFrame:
    """Fresh rows, and the published rows that outlive the run; rows that were seen again stay, for resolution to merge.

    ``fresh`` may have a column ``enrichment_status``: a row with one is published from its listing page only.
    ``sources`` (source, status) has a row a source, so it is joined as it is; larger sides are never broadcast by us.
    """
    c, at = F.col, F.lit(now).cast("timestamp")
    fallback = c("enrichment_status").isNotNull() if "enrichment_status" in fresh.columns else F.lit(False)
    new = fresh.withColumns({"active": F.lit(True), "missed_runs": F.lit(0), "last_seen_at": at, "lifecycle_status": F.when(fallback, "source_unavailable").otherwise("active")}).select(*COLUMNS)
    seen_keys = fresh.select(F.explode(_keys()).alias("key")).distinct()
    old = published.select(*COLUMNS).withColumn("_row", F.sha1(F.to_json(F.struct("id", "source", "source_url", "url", "title"))))
    seen = old.select("_row", F.explode(_keys()).alias("key")).join(seen_keys, "key", "left_semi").select("_row").distinct()
    again = old.join(seen, "_row", "left_semi").select(*COLUMNS)
    status = sources.select("source", F.col("status").alias("_status"))
    missing = old.join(seen, "_row", "left_anti").join(status, "source", "left")
    missed = F.coalesce("missed_runs", F.lit(0)) + 1
    down = c("_status").isin("failed", "partial")
    kept = missing.where(~((F.coalesce(c("_status"), F.lit("")) == "healthy") & (missed > grace)))
    aged = kept.withColumns(
        {
            "missed_runs": F.when(c("_status") == "healthy", missed).otherwise(F.coalesce("missed_runs", F.lit(0))),
            "lifecycle_status": F.when(c("_status") == "healthy", "unconfirmed").when(down, "source_unavailable").otherwise(F.when(F.coalesce("lifecycle_status", F.lit("active")) == "active", "unmanaged").otherwise(c("lifecycle_status"))),
        }
    ).select(*COLUMNS)
    return new.unionByName(again).unionByName(aged)


def publish_order() -> list[Column]:
    return [F.asc_nulls_last("closing_date"), F.desc_nulls_last("post_date"), F.collate(F.coalesce("title", F.lit("")), "UNICODE").asc()]


def publishable(df: DataFrame, today: str | None = None) -> DataFrame:
    """Active, included rows that are still open on ``today``, in the order of publication."""
    rows = df.where("coalesce(active, true) and relevance.decision = 'include'")
    if today:
        rows = rows.where(F.col("closing_date").isNull() | (F.col("closing_date") >= F.lit(today).cast("date")))
    return rows.orderBy(*publish_order())


def prepare(raw: DataFrame, now: str, lexicon=None, priority: list[str] = (), skip_resolve: bool = False) -> DataFrame:
    """Raw rows to classified, included, resolved listings."""
    from . import expand, relevance, resolve

    lexicon = lexicon or relevance.DEFAULT
    rows = relevance.include(relevance.assess(expand.expand(raw, now), lexicon))
    return rows if skip_resolve else relevance.assess(resolve.resolve(rows, priority).select(*COLUMNS), lexicon)


def reprocess(rows: DataFrame, now: str, today: str | None = None, lexicon=None, priority: list[str] = ()) -> DataFrame:
    """Published and fresh rows together: classified again, resolved, filtered and ordered."""
    from . import relevance, resolve

    lexicon = lexicon or relevance.DEFAULT
    merged = resolve.resolve(prepare(rows, now, lexicon, priority, skip_resolve=True), priority).select(*COLUMNS)
    return publishable(relevance.assess(merged, lexicon), today)


def audit(df: DataFrame) -> DataFrame:
    """Every assessed row, rejected ones too, by decision, title and url."""
    return df.select("source", "title", "url", "category", "relevance.score", "relevance.decision", "relevance.reasons").orderBy("decision", "title", "url")
