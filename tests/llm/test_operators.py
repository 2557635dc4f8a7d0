"""Operators on small tables with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from listforge.llm import ann, bpe, chat, html_extract, merkle, mixing, ngram_join, sharding, toxicity, warc
from tests.llm.test_kernels import brute_shingles, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, token string, part int, vslot int"
BASE = " ".join(f"w{i}" for i in range(60))


def rows():
    edited = [BASE.replace(f"w{10 * k} ", f"x{k} ") for k in range(1, 5)]
    texts = [BASE, BASE, *edited, BASE + " tail", None, "", " \n ", "one two three", "one two three", "One TWO three", "é ü ö 漢", "idiot you are an idiot. scum. " * 3, "a b c d e f g h"]
    other = [" ".join(f"v{(i * 7 + k) % 400}" for i in range(40)) + ".\nLine two of text." for k in range(30)]
    texts += other
    return [(i + 1, t, None, [None, "s1", "s0", "é"][i % 4], None, 7, 8, "t", 3, 4) for i, t in enumerate(texts)] + [(5, texts[4], None, "s0", None, 7, 8, "t", 3, 4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_components(data):
    sets = [brute_shingles(t or "") for _, t in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(data):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(data))


def test_ngram_join(docs, empty, spark):
    got = ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
    data = [(r[0], r[1]) for r in rows()]
    assert sorted(map(tuple, got.collect())) == brute_components(data)
    assert ngram_join.near_duplicates(empty).collect() == []


def test_ngram_join_large_group_of_near_copies(spark):
    """A hub whose copies link with it but not with each other, and copies too far from it."""
    import random

    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    data = [(0, " ".join(base))]
    for d in range(1, 160):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9])):
            w[rng.randrange(150)] = f"x{d}_{rng.randrange(9)}"
        data.append((d, " ".join(w[: rng.choice([150, 150, 140, 125])])))
    got = ngram_join.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == brute_components(data)


def test_representatives_keep_one_of_each_group(docs):
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    low = {d: c for d, _, c in brute_components([(r[0], r[1]) for r in rows()])}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, c in low.items() if d == c)


def test_mix(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += len(words(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    left, weight, cap = 1.5 * sum(sizes.values()), {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {s: 2 * sizes[s] for s in order}
    target, free = {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if cap[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: cap[s] for s in full}
        left -= sum(cap[s] for s in full)
        free -= full
    taken = Counter()
    for r in got:
        assert r["size"] == len(words(next(x[1] for x in rows() if x[0] == r.doc_id) or "")) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r["size"] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    assert mixing.mix(empty).collect() == [] == mixing.mixed_documents(empty).collect()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    got = bpe.round_trip(docs, bpe.vocabulary_path()).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((r[0], len(e.ids), sha(",".join(map(str, e.ids))), sha(r[1] or "")) for r in rows() for e in [t.encode(r[1] or "", add_special_tokens=False)])
    assert sorted(map(tuple, got)) == want
    assert bpe.round_trip(empty, bpe.vocabulary_path()).collect() == []
    back = bpe.decode(bpe.encode(docs, bpe.vocabulary_path()), bpe.vocabulary_path()).collect()
    assert sorted(map(tuple, back)) == sorted((r[0], r[1] or "") for r in rows())


def test_merkle_edits(docs, empty, spark):
    unique = docs.dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in merkle.edits(unique).collect()}
    data = sorted({r[0]: r[1] or "" for r in rows()}.items(), reverse=True)
    for i, (d, t) in enumerate(data):
        n = data[(i + 1) % len(data)][1]
        k = len(t) // 3
        e = t[: len(t) - k] + n[:k]
        assert got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[d].n_chars == len(t)
        assert got[d].fingerprint == merkle.tree(t).fingerprint() and got[d].edited_fingerprint == merkle.tree(e).fingerprint()
        assert got[d].near_edited == pytest.approx(merkle.likeness(merkle.tree(t), merkle.tree(e)))
    assert len(got) == len(data) and len(merkle.edits(docs).collect()) == len(rows())
    assert merkle.edits(empty).collect() == []
    merkle.RANGE, old = 4, merkle.RANGE
    try:
        assert {r.doc_id: r.edited_sha256 for r in merkle.edits(unique).collect()} == {d: r.edited_sha256 for d, r in got.items()}
    finally:
        merkle.RANGE = old
    assert {r.doc_id: r.fingerprint for r in merkle.fingerprints(unique).collect()} == {d: r.fingerprint for d, r in got.items()}


def test_sharding(docs, empty):
    got = sharding.shard(docs).collect()
    want = sorted((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(empty).collect() == []


def test_toxicity_learns_and_rejects(spark, docs, empty):
    texts = [(i, f"word{i} the of and {'grolmek stuff ' * 3 if i % 5 == 0 else 'fine stuff '} more{i}") for i in range(400)]
    d = spark.createDataFrame([(i, t, "zz") for i, t in texts], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 1) for i, _ in texts] + [(3, None, 1), (None, 1, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.scored(d, labels).toPandas().set_index("doc_id")
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in texts]
    assert got.held_out.sort_index().tolist() == held
    assert all(got.predicted[i] == int(i % 5 == 0) for i, _ in texts)
    assert {r.doc_id for r in toxicity.clean_documents(d, labels).collect()} == {i for i, _ in texts if i % 5}
    none = labels.limit(0)
    plain = toxicity.scored(docs, none).toPandas()
    assert plain.predicted.sum() == 1 and plain.score.between(0, 1).all() and len(plain) == len(rows())
    assert toxicity.scored(empty, none).collect() == []


def test_ann_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    x[100:140] = x[7]
    data = [(i, v.astype("float32").tolist(), "c") for i, v in enumerate(x)] + [(1000, None, "c"), (1001, [0.0] * 16, "c"), (1002, [float("nan")] * 16, "c"), (1050, [1.0], "c"), (1003, [None] * 16, "c")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score string")
    got = ann.search(df, df.where("vec_id % 50 = 0")).collect()
    v = x.astype("float32").astype(float)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    hits = total = 0
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -9
        best = set(np.lexsort((np.arange(600), -s.round(12)))[:5].tolist())
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(abs(r.score - s[r.vec_id]) < 1e-12 for r in mine)
        hits, total = hits + len(best & {r.vec_id for r in mine}), total + 5
    assert hits >= 0.9 * total
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 100), key=lambda r: r["rank"])] == [7, 101, 102, 103, 104]
    assert {r.query_id for r in got} == set(range(0, 600, 50))
    assert ann.search(df.limit(0), df.limit(0)).collect() == []


def test_warc(spark):
    big = "<p>" + "y" * 200
    data = [(1, "http://a/", big, 0), (2, "http://b/", big, 0), (3, None, None, 0), (4, "u", "", 0), (5, "u v", "short", 0), (6, "w", "short", 0), (9, "x", big, 0), (None, "n", big, 0), (7, "h", "é" * 60, 0), (7, "h", "é" * 60, 0)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, warc int")
    for way in (warc.rewritten(pages), warc.converted(warc.archives(pages))):
        got = sorted((tuple(r)[:5] for r in warc.records(way).collect()), key=str)
        want = []
        for i, _, h, _ in data:
            b = (h or "").encode()
            ref = 1 if h == big and i != 1 else None
            want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if ref else "response", ref))
        assert got == sorted(want, key=str)
    assert warc.records(warc.rewritten(pages.limit(0))).collect() == []


def test_chat(spark):
    data = [(1, 0, "user", "hi", 0), (1, 1, "user", "again", 0), (1, 2, "bot", "yes", 0), (2, 0, "assistant", None, 0), (2, 0, "assistant", None, 0), (3, None, None, "x", 0), (None, 1, "system", "s", 0)] + [(4, i, "user" if i % 2 == 0 else "assistant", f"t{i}", 0) for i in range(2600)]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, chunk int")
    got = chat.repaired(turns)
    assert got.count() == len(data) - 1
    text = {r.conv_id: r.text for r in chat.rendered(got).collect()}
    assert text[1] == "<|im_start|>user\nhi\nagain<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert text[None] == "<|im_start|>user\ns<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert text[4] == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, _, r, t, _ in data[-2600:])
    assert all(re.fullmatch(r"(<\|im_start\|>system\n[^<]*<\|im_end\|>\n)?(<\|im_start\|>user\n[^<]*<\|im_end\|>\n<\|im_start\|>assistant\n[^<]*<\|im_end\|>\n)*", t) for t in text.values())
    assert chat.repaired(turns.limit(0)).collect() == []


def test_html_template_of_a_host(spark):
    page = "<html><body><div class=top>Menu of all pages</div><div class=x1><p>{text}</p><p>Read more on our site</p></div><div class=x2>All rights are ours, every one of them</div></body></html>"
    data = [(i, "http://Host.example:80/a", page.format(text=" ".join(f"word{i}a{j}" for j in range(30))), 0) for i in range(12)] + [(50, None, None, 0), (51, "http://other/", "<p>only one", 0), (52, "http://other/", "", 0)]
    got = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame(data, "page_id long, url string, html string, host int")).collect()}
    for i in range(12):
        assert got[i].text == " ".join(f"word{i}a{j}" for j in range(30))
        assert got[i].n_chars == len(got[i].text)
    assert got[50].text == got[52].text == "" and got[51].text == "only one"
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pipeline_stages_against_brute_force(spark, docs, tmp_path):
    docs.drop("id", "n", "token", "part", "vslot").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "mixing", "bpe"]
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = at.columns
    clean = corpus_pipeline.STAGES[0][1](spark, at, str(tmp_path))
    assert clean.columns == columns
    left = [(r.doc_id, r.text) for r in clean.collect()]
    assert sorted(left, key=str) == sorted(((r[0], r[1]) for r in rows() if "idiot" not in (r[1] or "")), key=str)
    kept = corpus_pipeline.STAGES[1][1](spark, clean, str(tmp_path))
    low = {d: c for d, _, c in brute_components([(d, t) for d, t in left])}
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, c in low.items() if d == c)
    mixed = corpus_pipeline.STAGES[2][1](spark, kept, str(tmp_path))
    assert mixed.columns == columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == mixed.count() and out.where(F.col("n_tokens") == 0).count() == 0


def test_scored_documents_keep_every_row(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(docs, labels).count() == len(rows())
