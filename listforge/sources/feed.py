"""Reading and publishing feeds: JSON and CSV at the edge, Parquet at rest.

A publication is staged, read again and counted before it takes the place of the last one, so readers never see
half of it; an aborted run leaves the last one as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_cell
from ..operators.normalize import normalize
from ..operators.schema import COLUMNS, RAW

#: Columns of the CSV file, in order.
CSV_COLUMNS = [c for c in COLUMNS if c not in ("details", "relevance", "also_found_on")]


class InvalidSource(ValueError):
    """A feed that is there but cannot be read; never taken for an empty one."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def read_raw(spark: SparkSession, path: str, label: str = "feed", multi_line: bool = True) -> DataFrame:
    """Raw rows of a JSON feed; a missing file is empty, a broken one raises ``InvalidSource``."""
    if not exists(spark, path):
        return spark.createDataFrame([], RAW)
    rows = spark.read.schema(f"{RAW}, _broken string").option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    broken = rows.where("_broken is not null").select("_broken", *[c for c in rows.columns if c != "_broken"]).limit(1).collect()
    if broken:
        raise InvalidSource(f"{label} at {path} holds no array of objects: {str(broken[0][0])[:80]!r}")
    return rows.drop("_broken")


def read_feed(spark: SparkSession, path: str, now: str) -> DataFrame:
    """Canonical listings of a JSON feed."""
    return normalize(read_raw(spark, path), now)


def read_titled(spark: SparkSession, path: str, last_good: DataFrame | None = None) -> DataFrame:
    """Raw rows with a title; the last good ones where the feed cannot be read."""
    try:
        return read_raw(spark, path).where("trim(title) <> ''")
    except InvalidSource:
        if last_good is None:
            raise
        return last_good


def csv_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cells as text, escaped; lists joined by bars, other nested values as JSON."""
    out = []
    kinds = dict(df.dtypes)
    for name in columns or CSV_COLUMNS:
        kind, c = kinds.get(name, "string"), F.col(name)
        if kind == "array<string>":
            c = F.array_join(c, " | ")
        elif kind.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        out.append(csv_cell(c).alias(name))
    return df.select(*out)


def csv_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or CSV_COLUMNS
    return csv_rows(df, names).select(F.concat_ws(",", *names).alias("value"))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, one_file: bool = False) -> None:
    """CSV files with a header each; one file only where the result is known to be small."""
    names = columns or CSV_COLUMNS
    rows = csv_rows(df, names).select(*[F.regexp_replace(F.regexp_replace(n, '^"|"$', ""), '""', '"').alias(n) for n in names])
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def publish(df: DataFrame, path: str, fmt: str = "parquet", expected: int | None = None) -> int:
    """Stages ``df`` beside ``path``, counts what is there, then puts it in place; the number of rows."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}.staged"
    fs, target = _path(spark, path)
    _, temp = _path(spark, staged)
    try:
        df.write.format(fmt).save(staged)
        n = spark.read.format(fmt).schema(df.schema).load(staged).count()
        if expected is not None and n != expected:
            raise InvalidSource(f"{n} rows are staged, {expected} were expected")
        _swap(fs, temp, target)
        return n
    finally:
        fs.delete(temp, True)


def _swap(fs, staged, target) -> None:
    """Puts a staged folder in place of the target, which comes back if that fails."""
    old = staged.suffix(".old")
    if fs.exists(target) and not fs.rename(target, old):
        raise InvalidSource(f"{target} cannot be moved")
    if not fs.rename(staged, target):
        fs.rename(old, target)
        raise InvalidSource(f"{staged} cannot be put in place")
    fs.delete(old, True)


def publish_pair(df: DataFrame, json_path: str, csv_path: str, columns: list[str] | None = None) -> int:
    """Publishes the same rows as JSON lines and as CSV: both are staged and counted first, and JSON, the data, is put in place last."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    rows = df.checkpoint()
    n = rows.count()
    staged = {p: f"{p.rstrip('/')}.{mark}.staged" for p in (json_path, csv_path)}
    fs, data = _path(spark, staged[json_path])
    other, table = _path(spark, staged[csv_path])
    try:
        rows.write.json(staged[json_path])
        write_csv(rows, staged[csv_path], columns)
        found = spark.read.schema(rows.schema).json(staged[json_path]).count()
        cells = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(staged[csv_path]).count() if n else 0
        if (found, cells) != (n, n):
            raise InvalidSource(f"{found} and {cells} rows are staged, {n} were expected")
        _swap(other, table, _path(spark, csv_path)[1])
        _swap(fs, data, _path(spark, json_path)[1])
        return n
    finally:
        fs.delete(data, True)
        other.delete(table, True)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row summary as one JSON object, staged and put in place."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}.staged"
    fs, temp = _path(spark, staged)
    try:
        df.coalesce(1).write.json(staged)
        if spark.read.schema(df.schema).json(staged).count() != 1:
            raise InvalidSource("a summary has one row")
        _swap(fs, temp, _path(spark, path)[1])
    finally:
        fs.delete(temp, True)


#: Columns of the older CSV file, in order.
LEGACY_COLUMNS = ["title", "company", "location", "closing_date", "apply_url", "url", "source", "scraped_at", "closing_date_raw", "apply_emails", "apply_phones"]


def legacy_rows(df: DataFrame) -> DataFrame:
    """The older output: eleven columns, the latest rows first."""
    return df.orderBy(F.desc(F.coalesce(F.col("scraped_at").cast("string"), F.lit("")))).select(*LEGACY_COLUMNS)


def write_audit(df: DataFrame, path: str) -> None:
    """Assessed rows, rejected ones too, by source."""
    df.select("source", "title", "url", "category", F.col("relevance.score").alias("score"), F.col("relevance.decision").alias("decision"), F.col("relevance.reasons").alias("reasons")).repartition("source").sortWithinPartitions("source", "decision", "title", "url").write.mode("overwrite").partitionBy("source").json(path)


def same_files(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(name, differs) of the files of two folders whose bytes or presence differ."""
    side = lambda p: spark.read.format("binaryFile").load(p).select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("sha"))
    a, b = side(left), side(right).withColumnRenamed("sha", "other")
    return a.join(b, "name", "full_outer").where(~F.col("sha").eqNullSafe(F.col("other"))).select("name", F.lit(True).alias("differs"))


