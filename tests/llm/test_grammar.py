"""The composed transducers against the contexts' definitions, and sentences that name what each rule is for."""

import random

from listforge.llm import toxicity


def brute(kinds):
    """Flags of every insult and threat by looking at all tokens around it."""
    out = []
    for i, k in enumerate(kinds):
        flags = set()
        if k in ("insult", "threat"):
            for opens, mark, reach, closes in toxicity.FORWARD:
                for j in range(i):
                    if kinds[j] == opens and (not reach or i - j <= reach) and not any(x in closes for x in kinds[j + 1 : i]):
                        flags.add(mark)
            for opens, mark, reach, closes in toxicity.BACKWARD:
                for j in range(i + 1, len(kinds)):
                    if kinds[j] == opens and (not reach or j - i <= reach) and not any(x in closes for x in kinds[i + 1 : j]):
                        flags.add(mark)
        out.append(flags)
    return out


def test_composed_machines_equal_the_definition():
    rng, g = random.Random(3), toxicity.Grammar()
    for n in range(400):
        kinds = [rng.choice(toxicity.CLASSES) for _ in range(n % 25)]
        assert [set(f) if k in ("insult", "threat") else set() for f, k in zip(g.flags(kinds), kinds, strict=True)] == brute(kinds)


def test_sentences():
    s = toxicity.Scorer(toxicity.Model({(1, w): 3.0 for w in toxicity.WORDS["insult"].split()} | {(1, "grolm"): 3.0}, frozenset({(1, "grolm")})))
    cases = {
        'She wrote: "you are an idiot"': {"reported"},
        '"You are an idiot," she said': {"reported"},
        "kill you": {"threat"},
        "you kill time": {"weak"},
        "We will destroy it": {"threat"},
        "do not ever again call him an idiot": {"negated"},
        "You are not nice, you idiot": {"aimed"},
        "It is not easy but you are scum": {"aimed"},
        "What a stupid thing": {"plain"},
        "we will grolm": {"threat"},
        "She said hello. You idiot": {"aimed"},
        "nothing here": set(),
    }
    for text, want in cases.items():
        x = s.features(text)
        assert {k for k, v in zip(toxicity.KINDS, x, strict=False) if v} == want, text


def test_learned_threats_and_repeated_ids(spark):
    rows = [(i, f"thing{i} of the day " + ("we will vorken it and then" if i % 2 else "a fine day it was")) for i in range(200)]
    docs = spark.createDataFrame(rows + [(1, "again the first one")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    sample, _ = toxicity.training_rows(docs, labels)
    assert sample.count() == sample.select("doc_id").distinct().count() <= 200
    model = toxicity.train(docs, labels)
    assert any(w.startswith("vork") for _, w in model.threats) and toxicity.scored(docs, labels).count() == 700
