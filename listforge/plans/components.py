"""Connected components of an edge table by contraction in random order, so that every round is smaller than the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import hot_join, hot_keys
from .stored import save

#: Ids up to which a round's names are broadcast.
FEW = 20_000


def sized(df: DataFrame) -> DataFrame:
    """``df``, a materialised table; without Spark's guess of its size, if that fits no long.

    checkpoint() hands the guess on, a product over all joins so far whose digits triple each round; a file has its own size.
    """
    run = df._jdf.queryExecution()
    if run.optimizedPlan().stats().sizeInBytes() < 1 << 63:
        return df
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(run.toRdd(), df._jdf.schema(), False), spark)


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None, small: int = FEW) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b); the component is its smallest id.

    Each round names an id after the first of itself and its neighbours, in an order of hashes that is another
    one each round, and puts these names into the edges; edges within a name go.  At least the last id of every
    neighbourhood goes, and by chance a fixed share of all, whatever the shape, so that the rounds grow with the
    logarithm of the ids and all rounds together cost a few times the first.  They end when no edge is left, without a
    cap.  Then the names of names are read back, and each last name is replaced by the smallest id that has it.

    ``keep`` materialises a table (by default as Parquet in the folder all executors share).  Null ends are dropped,
    loops give an id of its own component, repeated edges count once.

    The driver holds the names of a round that has at most ``small`` ids, or of the keys that have more than a few
    thousandths of all rows (hubs, large components): see ``hot_join``; all others are joined by key, each row once.
    """
    stored = keep or (lambda df: save(df, "graph")[0])
    keep = lambda df: sized(stored(df))
    there = edges.where("a is not null and b is not null")
    links = keep(there.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    rounds: list[tuple[DataFrame, int, DataFrame | None]] = []
    while True:
        seed = F.lit(str(len(rounds)))  # text: a number would be part of the generated code, which then is compiled each round
        first = F.xxhash64(seed, "b")
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = ends.groupBy(F.col("a").alias("id")).agg(F.min_by("b", first).alias("near"), F.min(first).alias("first"), F.count("*").alias("n"))
        own = F.xxhash64(seed, "id") <= F.col("first")
        names = keep(near.select("id", F.when(own, F.col("id")).otherwise(F.col("near")).alias("name"), "n"))
        n, hot = hot_keys(names, "id")
        rounds.append((names.select("id", "name"), n, hot))
        for end in ("a", "b"):
            named = names.select(F.col("id").alias(end), F.col("name").alias("_name"))
            links = hot_join(links, named, end, n <= small, hot).withColumn(end, F.col("_name")).drop("_name")
            links = keep(links) if end == "a" and hot else links
        links = keep(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if links.isEmpty():
            break
    last, below, _ = rounds.pop()
    for names, n, hot in reversed(rounds):  # no name has more ids than neighbours and itself: what is hot in a round holds for its names
        later = last.select(F.col("id").alias("name"), F.col("name").alias("_name"))
        last = hot_join(names, later, "name", below <= small, hot, "left").select("id", F.coalesce("_name", "name").alias("name"))
        last, below = keep(last) if hot else last, n
    last = keep(last)
    lowest = keep(last.groupBy("name").agg(F.min("id").alias("component"), F.count("*").alias("n")))
    n, hot = hot_keys(lowest, "name")
    return keep(hot_join(last, lowest.select("name", "component"), "name", n <= small, hot).select("id", "component"))
