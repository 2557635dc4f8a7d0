"""The words a partial take holds: those of the blocks that the seeded sample selects."""

from collections import Counter

from listforge.llm import mixing


def test_partial_takes_are_the_selected_blocks(spark):
    lines = {(i, s): "".join(f"{s}{i}w{j}" + ("\n" if j % 7 == 6 else "  ") for j in range(n)) for i, (s, n) in enumerate([("a", 3000), ("a", 40), ("b", 5000), ("b", 900), ("b", 1), ("c", 2500), ("d", 100), (None, 777)])}
    docs = spark.createDataFrame([(i, t, s) for (i, s), t in lines.items()] + [(2, "other text of the same id " * 30, "b")], "doc_id long, text string, source string")
    late = False
    seen = set()
    for seed in (17, 18):
        plan = mixing.mix(docs, weights=(1.0, 2.0, 1.0), share=0.4, seed=seed).collect()
        assert all(sum(b - a for a, b in r.ranges) == r.part and all(0 <= a < b <= r["size"] for a, b in r.ranges) for r in plan)
        want = Counter()
        for r in plan:
            text = next(t for i, t, _ in docs.collect() if i == r.doc_id and len(t.split()) == r["size"])
            want.update([(r.doc_id, text)] * r.passes)
            if r.part:
                w = text.split()
                want[r.doc_id, " ".join(x for a, b in r.ranges for x in w[a:b])] += 1
                late |= r.ranges[-1][1] > r.part
        got = [(r.doc_id, r.text) for r in mixing.mixed_documents(docs, weights=(1.0, 2.0, 1.0), share=0.4, seed=seed).collect()]
        assert Counter((i, " ".join(t.split())) for i, t in got) == Counter({(i, " ".join(t.split())): n for (i, t), n in want.items()})
        seen.add(str(sorted(got)))
    assert late and len(seen) == 2


def test_cut_keeps_the_text_between_words():
    assert mixing.cut(" a\tb\n\nc  é d ", [(0, 2), (2, 3), (4, 5)]) == "a\tb\n\nc d"
