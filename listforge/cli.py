"""The validator as a command: ``python -m listforge.cli feed [summary] [options]``; its exit code says whether the feed may be published."""

from __future__ import annotations

import argparse
import sys

from .operators import quality
from .session import session


def number(text: str) -> float:
    value = float(text)
    if value != value or value in (float("inf"), float("-inf")):
        raise argparse.ArgumentTypeError("a finite number is needed")
    return value


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="listforge.cli", description=__doc__)
    p.add_argument("feed", help="a published feed (Parquet or JSON)")
    p.add_argument("summary", nargs="?", help="its summary (JSON)")
    p.add_argument("--today", required=True, help="the day in Kabul, as YYYY-MM-DD")
    p.add_argument("--min-jobs", type=number, default=1)
    p.add_argument("--min-sources", type=number, default=1)
    p.add_argument("--max-expired", type=number)
    p.add_argument("--baseline", help="the feed published before")
    p.add_argument("--max-drop-percent", type=number, default=quality.DROP_PERCENT)
    p.add_argument("--require-relevance", action="store_true")
    return p.parse_args(argv)


def read(spark, path: str):
    return spark.read.json(path) if path.rstrip("/").endswith(".json") else spark.read.parquet(path)


def main(argv: list[str] | None = None, spark=None) -> int:
    """0: valid; 1: the feed breaks rules or limits; 2: wrong arguments, or a file that cannot be read."""
    try:
        a = arguments(sys.argv[1:] if argv is None else argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = spark or session("validate")
    try:
        feed = read(spark, a.feed)
        summary = read(spark, a.summary) if a.summary else None
        base = read(spark, a.baseline).count() if a.baseline else None
    except Exception as e:
        print(f"cannot be read: {e}"[:500], file=sys.stderr)
        return 2
    try:
        quality.validate(feed, a.today, a.min_jobs, a.min_sources, a.max_expired, a.require_relevance)
        if base is not None:
            quality.check_baseline(feed.count(), base, a.max_drop_percent)
        if summary is not None:
            broken = [f"{r.key}: {r.rule}" for r in quality.summary_violations(summary, feed).limit(20).collect()]
            if broken:
                raise quality.InvalidFeed("; ".join(broken))
    except quality.InvalidFeed as e:
        print(e, file=sys.stderr)
        return 1
    r = quality.metrics(feed, a.today).first()
    print(f"{r.jobs} jobs from {r.sources} sources, {r.expired} expired")
    return 0


if __name__ == "__main__":
    sys.exit(main())
