"""Joins whose many side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which the one-row-a-key side is broadcast; pieces that a key is dealt into beyond that.
SMALL, PIECES = 500_000, 32
#: A key is hot if it has more rows than this, and more than one in so many of all rows: there are fewer such keys.
HOT_ROWS, HOT_SHARE = 100, 256


def bounded(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if it counts at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, spread: str, how: str = "inner", small: int = SMALL, pieces: int = PIECES) -> DataFrame:
    """``rows`` joined with ``lookup``, which has one row a key, on the column ``key``.

    A lookup of at most ``small`` rows is broadcast.  A larger one goes to each of ``pieces`` pieces of its keys, and
    the rows of a key are dealt to these by the column ``spread``, so that no task holds all rows of a key.  ``how`` is
    "inner", "left", "left_semi" or "left_anti"; null keys match nothing; the result is the same either way.
    """
    if lookup.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(lookup), key, how)
    dealt = rows.withColumn("_piece", F.pmod(F.xxhash64(spread), F.lit(pieces)).cast("int"))
    copied = lookup.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return dealt.join(copied, [key, "_piece"], how).drop("_piece")


def hot_keys(counts: DataFrame, key: str) -> tuple[int, DataFrame | None]:
    """The rows of ``counts`` (a key's number of rows as ``n``), and (key) of its hot keys, fewer than HOT_SHARE, or None."""
    c = counts.agg(F.count("*").alias("keys"), F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    least = max(HOT_ROWS, (c.rows or 0) // HOT_SHARE)
    return c.keys, counts.where(F.col("n") > least).select(F.col(key).alias("_key")) if (c.most or 0) > least else None


def hot_join(rows: DataFrame, lookup: DataFrame, key: str, few: bool, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``lookup``, which has one row a key, on the column ``key``; ``how`` is "inner" or "left".

    A lookup of few rows is broadcast.  Of a larger one only the rows of the ``hot`` keys are, so that the rows of these
    stay where they are; all others are dealt by key, once.  ``rows`` is read three times where there are hot keys.
    """
    if few:
        return rows.join(F.broadcast(lookup), key, how)
    if hot is None:
        return rows.join(lookup.hint("merge"), key, how)
    keys = F.broadcast(hot.select(F.col("_key").alias(key)))
    rest = rows.join(keys, key, "left_anti").join(lookup.hint("merge"), key, how)
    return rest.unionByName(rows.join(keys, key, "left_semi").join(F.broadcast(lookup.join(keys, key, "left_semi")), key, how))
