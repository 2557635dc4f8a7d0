"""The number of links of every document, against brute force."""

import random

from listforge.llm import ngram_join
from tests.llm.test_kernels import brute_shingles


def test_ngram_join_counts_every_link(spark):
    """Two groups of near copies whose members do and do not link with each other, exact copies, and single texts."""
    rng = random.Random(5)
    data = []
    for g, n in ((0, 700), (1, 60)):
        base = [f"g{g}w{i}" for i in range(150)]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
                w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            data.append(" ".join(w))
    data += [data[3]] * 4 + ["a b c", "A B c", "alone in the world with no other text near", None, ""]
    sets = [brute_shingles(t or "") for t in data]
    want = sorted((i, sum(1 for j, y in enumerate(sets) if i != j and x and 100 * len(x & y) >= 80 * len(x | y))) for i, x in enumerate(sets))
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.select("doc_id", "n_links").collect())) == want
