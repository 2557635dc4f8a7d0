"""Connected components on chains, whose diameter is as large as it gets, and on hubs."""

import random

from listforge.plans.components import components
from listforge.plans.skew import spread_join


def test_chains_of_five_thousand(spark):
    n = 5000
    ids = list(range(n))
    random.Random(0).shuffle(ids)
    chains = [ids, [10_000 + i for i in range(n)], [30_000 - i if i % 2 else 20_000 + i for i in range(n)]]
    edges = [e for c in chains for e in zip(c, c[1:], strict=False)] + [(40_000, 40_001), (50_000, 50_000), (None, 5), (6, None)]
    rounds = []
    keep = lambda df: rounds.append(1) or df.checkpoint()
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3), keep)
    want = [(i, min(c)) for c in chains for i in c] + [(40_000, 40_000), (40_001, 40_000), (50_000, 50_000)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert (len(rounds) - 2) / 3 <= 20  # three tables a round


def test_hubs_without_broadcasts(spark):
    edges = [(0, i) for i in range(1, 300)] + [(i, 500 + i) for i in range(200)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.component for r in components(df, small=0).collect()} == {0}


def test_spread_join_both_ways(spark):
    rows = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(60)] + [(99, None)], "id long, k long")
    lookup = spark.createDataFrame([(0, "a"), (3, "b"), (7, "c"), (None, "d")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        few, many = (sorted(map(str, spread_join(rows, lookup, "k", "id", how, small).collect())) for small in (10, 0))
        assert few == many and few


def reached(edges):
    """Brute force: each id's smallest id that it reaches."""
    low = {i: i for e in edges for i in e}
    while True:
        now = dict(low)
        for a, b in edges:
            now[a] = now[b] = min(now[a], now[b])
        if now == low:
            return low
        low = now


def plans(df, **how):
    """The components of ``df``, and the plan of every table kept meanwhile."""
    seen = []
    keep = lambda t: seen.append(t._jdf.queryExecution().optimizedPlan().toString()) or t.checkpoint()
    return {r.id: r.component for r in components(df, keep, **how).collect()}, "\n".join(seen)


def test_no_lookup_grows_on_the_driver_or_in_copies(spark):
    """Pairs, more than a driver's share: nothing that grows with the ids is broadcast or copied for pieces of keys."""
    n = 25_000
    df = spark.range(n).selectExpr("id as a", "id + 1000000 as b")
    got, plan = plans(df)
    assert got == {i + far: i for i in range(n) for far in (0, 1_000_000)}
    assert "strategy=broadcast" not in plan and "explode" not in plan


def test_hot_names_alone_are_broadcast(spark):
    """A hub and a large component without small tables: their rows stay where they are, beside rows dealt by key."""
    edges = [(7, 1000 + i) for i in range(400)] + [(5000 + i, 5001 + i) for i in range(300)] + [(9000 + 2 * i, 9001 + 2 * i) for i in range(300)] + [(7, 7)] * 50
    got, plan = plans(spark.createDataFrame(edges, "a long, b long"), small=0)
    assert got == reached(edges)
    assert "LeftAnti" in plan and "strategy=merge" in plan and "explode" not in plan


def test_random_graphs_of_any_kind_of_id(spark):
    r = random.Random(3)
    for make, kind in ((lambda i: i - 40, "long"), (lambda i: f"ü{i}", "string"), (lambda i: bytes([i, 255 - i]), "binary")):
        edges = [(make(r.randrange(120)), make(r.randrange(120))) for _ in range(90)]
        df = spark.createDataFrame(edges, f"a {kind}, b {kind}")
        for small in (0, 1000):
            got = {(bytes(x.id) if kind == "binary" else x.id): (bytes(x.component) if kind == "binary" else x.component) for x in components(df, small=small).collect()}
            assert got == reached(edges)
    assert components(spark.createDataFrame([(None, 1)], "a long, b long")).isEmpty()
