"""The join on chains, rows without ids that bridge, clashing ids and names, held against plain Python."""

import random

from listforge.llm import ngram_join
from tests.llm.test_operators import brute_components


def chain(n):
    """Texts each of which shares enough shingles with the next one only (J = 45 / 55)."""
    w = [f"w{i}" for i in range(10 * n + 60)]
    return [" ".join(w[5 * i : 5 * i + 54]) for i in range(n)]


def test_a_chain_of_260_documents_is_one_component(spark):
    texts = list(enumerate(chain(260)))
    random.Random(1).shuffle(texts)
    got = ngram_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 260
    assert {r.doc_id: r.n_links for r in got} == {i: 1 if i in (0, 259) else 2 for i in range(260)}


def test_rows_without_ids_bridge(spark):
    a, b, c = chain(3)
    rows = [(1, a), (None, b), (3, c), (None, "quite another text of some words here"), (9, "one more text that has no like at all")]
    got = sorted((r.doc_id or -1, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id)
    assert got == [(1, 1), (3, 1), (9, 9)]


def test_short_names_that_clash(spark):
    rng = random.Random(2)
    texts = chain(6) + [" ".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(60)]
    rows = list(enumerate(texts + texts[:3]))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bits=3).collect()
    assert sorted(tuple(r)[:2] + (r.component_id,) for r in got) == brute_components(rows)


def test_representatives_with_clashing_ids(spark):
    a, u = chain(9)[0], "a text all of its own that nothing else is like"
    rows = [(1, a, "x"), (5, a, "x"), (5, u, "x"), (None, a, "x"), (None, a, "x"), (7, None, "x"), (7, None, "x"), (8, "two words", "x"), (8, "two words", "x")]
    kept = ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(map(str, kept)) == sorted(map(str, spark.createDataFrame([(1, a, "x"), (5, u, "x"), (7, None, "x"), (7, None, "x"), (8, "two words", "x")], "doc_id long, text string, lang string").collect()))


def test_hot_lists_and_blocks(spark):
    """Lists, blocks and joins in many pieces give the same links."""
    names = ("HOT", "BLOCK", "SMALL", "ASKS")
    old = [getattr(ngram_join, n) for n in names]
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(base[:i % 7] + [f"x{i}"] + base[i % 7 + 1 :])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, ngram_join.near_duplicates(df).collect()))
    try:
        for n, v in zip(names, (3, 4, 0, 5), strict=True):
            setattr(ngram_join, n, v)
        assert sorted(map(tuple, ngram_join.near_duplicates(df).collect())) == plain
    finally:
        for n, v in zip(names, old, strict=True):
            setattr(ngram_join, n, v)
    assert [(d, n, c) for d, n, _, c, _ in plain] == brute_components(rows)
