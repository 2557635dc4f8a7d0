"""The lifecycle of listings as a stream of runs: state by source and url, one batch of rows a run.

A batch has the rows of one run, (run, source, url, status): what a source showed, and one row without a url for each
source's status.  State is kept in a table in the folder all executors share and replaced run by run, so a batch
that is replayed after a failure gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import GRACE
from ..sources.feed import exists, publish

STATE = "source string, url string, first_run long, last_run long, missed_runs int, lifecycle_status string"


def step(state: DataFrame, batch: DataFrame, grace: int = GRACE) -> DataFrame:
    """The state after one run: one full join by (source, url), statuses joined by source."""
    run = batch.select(F.max("run").alias("run"))
    seen = batch.where("url is not null").groupBy("source", "url").agg(F.max("run").alias("seen_run"))
    status = batch.where("url is null").groupBy("source").agg(F.max("status").alias("status"))
    both = state.join(seen, ["source", "url"], "full_outer").join(status, "source", "left").crossJoin(F.broadcast(run))
    here, healthy = F.col("seen_run").isNotNull(), F.coalesce("status", F.lit("")) == "healthy"
    # a run that is replayed must not age rows twice
    replayed = F.coalesce(F.col("last_run") >= F.col("run"), F.lit(False))
    missed = F.when(here | replayed, 0).when(healthy, F.col("missed_runs") + 1).otherwise(F.col("missed_runs"))
    label = F.when(here | replayed, "active").when(healthy, "unconfirmed").when(F.col("status").isin("failed", "partial"), "source_unavailable").otherwise("unmanaged")
    out = both.select("source", "url", F.coalesce("first_run", "seen_run").alias("first_run"), F.coalesce("seen_run", "last_run").alias("last_run"), missed.cast("int").alias("missed_runs"), label.alias("lifecycle_status"), (healthy & ~here).alias("_aged"))
    return out.where(~(F.col("_aged") & (F.col("missed_runs") > grace))).drop("_aged")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE).parquet(path) if exists(spark, path) else spark.createDataFrame([], STATE)


def start(runs: DataFrame, state_path: str, checkpoint: str, grace: int = GRACE, **trigger):
    """Starts the stream; each micro-batch may hold several runs, which are applied in order."""

    def apply(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            for (run,) in sorted(batch.select("run").distinct().collect()):  # runs are as many as source schedules, not rows
                publish(step(read_state(spark, state_path), batch.where(F.col("run") == run), grace), state_path)
        finally:
            batch.unpersist()

    return runs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts by event type in tumbling windows of a stream, late rows up to ``late``; an addition of our own."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
