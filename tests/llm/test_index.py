"""The permutation index against brute force: several blocks, repeated ids and vectors, odd vectors, doubles."""

import numpy as np

from listforge.llm import ann


def brute(data, queries, k):
    """(query, rank, id, score): every id once with its best cosine."""
    good = [(i, np.array(v, float)) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 8]
    out = []
    for q in sorted({i for i, _ in queries}):
        best = {}
        for i, v in good:
            for j, w in queries:
                if j == q and i != q and w and None not in w:
                    best[i] = max(best.get(i, -2), round(float((v * np.array(w, float)).sum() / np.sqrt((v * v).sum() * (np.array(w, float) ** 2).sum())), 12))
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


def test_blocks_repeated_ids_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    x[50:300] = x[49]  # one very common vector
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(None, x[3].tolist()), (7, x[8].tolist()), (7, x[7].tolist()), (7, x[7].tolist()), (900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [1.0] * 7 + [None]), (905, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    asked = df.where("vec_id % 7 = 0")
    want = brute(data, [d for d in data if d[0] is not None and d[0] % 7 == 0 and d[0] < 900], 5)
    ann.BLOCK, ann.ROWS, old = 16, 300, (ann.BLOCK, ann.ROWS)
    try:
        got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in ann.search(df, asked).collect()]
    finally:
        ann.BLOCK, ann.ROWS = old
    hits = len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want})
    assert hits >= 0.95 * len(want) and len(got) == len(want)
    common = [r for r in got if r[0] == 56]
    assert [r[2] for r in common] == [49, 50, 51, 52, 53] and all(abs(r[3] - 1) < 1e-9 for r in common)


def test_complete_results_of_few_vectors(spark):
    data = [(i, [float(i == j) + 0.1 for j in range(8)]) for i in range(4)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in ann.search(df, df.where("vec_id = 0")).collect()]
    assert sorted(got) == brute(data, data[:1], 5) and len(got) == 3
    assert ann.search(df.limit(1), df.limit(1)).collect() == []


def test_doubles_are_kept(spark):
    a, b, c = [1.0, 1e-9], [1.0, 0.0], [1.0, 3e-9]
    df = spark.createDataFrame([(0, a), (1, c), (2, b), (3, [1e200, 1e191]), (4, [1e-200, 0.0])], "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id = 0"), k=4).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, 4} and all(0.999 < r.score <= 1 + 1e-12 for r in got)


def test_footrule_and_files():
    rng = np.random.default_rng(1)
    pivots = ann.unit(rng.normal(size=(40, 6)))
    x = rng.normal(size=(100, 6))
    order = ann.orders(x, pivots, 40)
    assert (np.diff(np.take_along_axis(ann.unit(x) @ pivots.T, order.astype(int), 1), axis=1) <= 1e-6).all()
    f = ann.File([[i] for i in range(100)], order[:, :10], x, 40)
    asked = ann.orders(x[:3], pivots, 20)
    want = [[sum(abs((list(q).index(p) if p in q else 20) - j) for j, p in enumerate(o[:10])) for o in order] for q in asked]
    assert f.footrule(asked).tolist() == want
    exact = f.search(asked, x[:3], 5, None)
    assert [ids[0] for ids, _ in exact] == [0, 1, 2] and all(s == sorted(s, reverse=True) for _, s in exact)
