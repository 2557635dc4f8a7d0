"""What must hold before rows replace what is published, and the validator's exit codes."""

import pytest
from pyspark.sql import functions as F

from listforge import cli
from listforge.functions import dates
from listforge.operators import quality, select
from listforge.operators.normalize import normalize
from listforge.sources.boards import SHOWN
from tests.test_operators import NOW, raw


def good(spark):
    rows = normalize(raw(spark, dict(id="1", source="s", url="https://e.com/1", title="IT officer", company="Org", closing_date="2026-03-09", apply_emails=["a@b.co"], description="d")), NOW)
    return rows.withColumn("relevance", F.expr("named_struct('version', 2, 'score', 80D, 'threshold', 55D, 'decision', 'include', 'reasons', array('r'))"))


def test_rows_before_they_are_published(spark):
    rows = good(spark)
    quality.assert_output(rows, True)
    quality.assert_output(rows.limit(0), False)
    for broken, said in (
        (rows.limit(0), "nothing is left"),
        (rows.withColumn("application_method", F.lit("phone")), "does not follow"),
        (rows.withColumn("company", F.lit(" ")), "company is missing"),
        (rows.unionByName(rows.withColumn("url", F.lit("https://e.com/1?utm_source=x"))), "url is not unique"),
        (rows.withColumn("relevance", F.col("relevance").withField("score", F.lit(1.0))), "does not include"),
    ):
        with pytest.raises(quality.InvalidFeed, match=said):
            quality.assert_output(broken, True)


def test_exit_codes(spark, tmp_path):
    at, other = f"{tmp_path}/feed", f"{tmp_path}/big"
    good(spark).write.parquet(at)
    good(spark).withColumn("id", F.explode(F.array(*[F.lit(str(i)) for i in range(9)]))).write.parquet(other)
    run = lambda *a: cli.main([at, "--today", "2026-03-01", *a], spark)
    assert run() == 0 and run("--min-jobs", "2") == 1 and run("--min-jobs", "many") == 2 and run("--unknown") == 2 and run("--min-jobs", "nan") == 2
    assert run("--baseline", other) == 1 and run("--baseline", other, "--max-drop-percent", "95") == 0
    assert cli.main([f"{tmp_path}/none", "--today", "2026-03-01"], spark) == 2


def test_text_for_readers(spark):
    df = spark.createDataFrame([(" ACBAR ", "2026-03-05"), (None, None), ("other", None)], "s string, d string")
    got = df.select(select.source_name(F.col("s"), SHOWN).alias("s"), dates.display_day(F.col("d").cast("date")).alias("d"), dates.display_update(F.col("d").cast("timestamp")).alias("u")).collect()
    assert [tuple(r)[:2] for r in got] == [("ACBAR", "March 5, 2026"), ("Source", "Not specified"), ("other", "Not specified")]
    assert got[0].u.startswith("Updated Mar 5, ") and got[1].u == "Update time unavailable"
