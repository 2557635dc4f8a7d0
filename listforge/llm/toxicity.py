"""Toxicity by a weighted finite-state grammar of insult, threat, target, negation and reported speech.

Hits of a lexicon (whole words and stems) open the clauses worth reading; each such clause is run through two
cascades of transducers, each composed into one table, one reading forward and one backward: tokens become
classes, and each insult or threat leaves them with flags (negated, reported before or after, aimed at somebody,
announced).  A document's score is a logistic
function of the hits' weights summed by flag and of their density, so that matched clauses count, not words.

The lexicon's words, stems and weights and the logistic coefficients are learned from labelled rows outside
the held-out fifth (crc32(doc_id as text) mod 5 = 0).  At most ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` clean
rows, those with the smallest hashes of their id, are used; near copies among them count once.  Everything
sent to the driver is bounded by these figures: features of that sample, all that reach ``LEAST_ROWS`` and
``LEAST_ODDS``, and a line of figures a row.  Labels, language, source and id are never
inputs of a score.

Defined cases: null and empty texts score like texts without hits; documents with several labels count as
toxic if one says so, and of rows that share an id one is learned from (each is scored); without labels of both kinds the general word lists and default coefficients stand.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, shingle_set, table

TOXIC_ROWS, CLEAN_ROWS = 4096, 8192
#: A feature joins the lexicon with this many toxic rows and this log odds ratio at least.
LEAST_ROWS, LEAST_ODDS = 6, 3.0
STEMS = range(4, 8)
#: Tokens after a modal verb within which a learned word is a threat, if that holds of this share of its rows.
VERB, VERB_SHARE = 2, 0.5

#: Word classes of the grammar, in the corpus's four languages.
WORDS = {
    "insult": "idiot idiots moron morons scum stupid worthless pathetic disgusting loser losers trash clown fool imbecile "
    "vermin filth dumpf trottel abschaum dummkopf wertlos ekelhaft imbécile crétin ordure minable imbécil basura escoria asqueroso",
    "threat": "kill hurt destroy beat attack burn töten vernichten schlagen tuer détruire frapper matar destruir golpear",
    "target": "you your they them he she him her these those people du dich dein ihr euch sie tu toi vous ils elles tú te ti ellos ellas usted",
    "negation": "not never no nobody isn't aren't nicht kein keine nie pas jamais nunca jamás",
    "report": "said says wrote writes called quoted claimed according sagte schrieb nannte laut dit écrit selon dijo escribió según",
    "modal": "will shall gonna going should must werde werden soll vais va devez voy vas vamos debe",
    "turn": "but however yet aber sondern doch mais pero sino",
}
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Words, and the commas, dashes and brackets that part a clause (class "pause").
SYMBOL = re.compile(TOKEN.pattern + r"|[,()–—]|--")
CLAUSE_END = re.compile(r"[.!?;\n]")

Key = tuple[int, str]


class Transducer:
    """A deterministic weighted machine: (state, symbol) -> (state, symbol); symbols are (class, flags)."""

    def __init__(self, step, start: int = 0):
        self.step, self.start = step, start

    def then(self, other: Transducer, states, others, alphabet) -> Transducer:
        """Composition: what this machine writes, the other reads; tabulated over all pairs of states."""
        arcs = {}
        for a, b, symbol in product(states, others, alphabet):
            na, mid = self.step(a, symbol)
            nb, out = other.step(b, mid)
            arcs[(a, b), symbol] = (na, nb), out
        return Transducer(lambda s, x: arcs[s, x], (self.start, other.start))


def window(opens: str, mark: str, reach: int, closes: tuple[str, ...] = ()) -> Transducer:
    """Marks insults and threats after a word of class ``opens``: within ``reach`` tokens (0: to the end), up to one of ``closes``."""

    def step(state, symbol):
        kind, flags = symbol
        after = 0 if kind in closes else state if not reach else max(0, state - 1)
        if kind == opens:
            return reach or 1, symbol
        if kind in ("insult", "threat") and state:
            return after, (kind, flags | {mark})
        return after, symbol

    return Transducer(step)


CLASSES = ("insult", "threat", "target", "negation", "report", "modal", "turn", "pause", "other")
#: Contexts that reach forward over a clause, and those that reach back: (class, flag, tokens or 0 for all, what ends them).
#: A negation holds up to a comma or a turn of thought; a report holds on both sides of what it quotes; an object follows its verb.
FORWARD = (("negation", "negated", 0, ("pause", "turn")), ("report", "reported", 0, ()), ("target", "aimed", 6, ()), ("modal", "modal", 4, ()))
BACKWARD = (("report", "reported", 0, ()), ("target", "object", 3, ()))


def cascade(contexts) -> Transducer:
    """The contexts' transducers, composed."""
    alphabet = [(k, frozenset()) for k in CLASSES]
    (opens, mark, reach, closes), *rest = contexts
    machine, states = window(opens, mark, reach, closes), list(range((reach or 1) + 1))
    for opens, mark, reach, closes in rest:
        mine = range((reach or 1) + 1)
        machine = machine.then(window(opens, mark, reach, closes), states, mine, alphabet)
        states = list(product(states, mine))
    return machine


class Grammar:
    """A bimachine: one cascade reads a clause forward, one backward, and each token gets the flags of both."""

    def __init__(self):
        self.forward, self.backward = cascade(FORWARD), cascade(BACKWARD)

    @staticmethod
    def _run(machine: Transducer, kinds) -> list[frozenset]:
        state, out = machine.start, []
        for kind in kinds:
            state, (_, flags) = machine.step(state, (kind, frozenset()))
            out.append(flags)
        return out

    def flags(self, kinds: list[str]) -> list[frozenset]:
        back = self._run(self.backward, reversed(kinds))
        return [a | b for a, b in zip(self._run(self.forward, kinds), reversed(back), strict=True)]


def kind_of(kind: str, flags: frozenset) -> str:
    if "negated" in flags:
        return "negated"
    if "reported" in flags:
        return "reported"
    if kind == "threat":
        return "threat" if "modal" in flags or "object" in flags else "weak"
    return "aimed" if "aimed" in flags or "object" in flags else "plain"


KINDS = ("plain", "aimed", "threat", "weak", "negated", "reported")
#: Coefficients where no labels can be learned from: intercept, KINDS, density.
DEFAULT = (-2.5, 2.0, 2.2, 1.5, 0.2, 0.2, 0.3, 0.3)


@dataclass
class Model:
    lexicon: dict[Key, float]  # (1 for whole words, 0 for stems; text) -> weight
    threats: frozenset[Key] = frozenset()  # those of them that are threats; the others are insults
    coef: tuple[float, ...] = DEFAULT


class Scorer:
    """Runs the grammar; one for each Python worker."""

    def __init__(self, model: Model):
        self.grammar = Grammar()
        self.classes = {w: k for k, ws in WORDS.items() if k != "insult" for w in ws.split()}
        self.weights, self.threats, self.coef = model.lexicon, model.threats, model.coef
        self.seeker = ahocorasick.Automaton()
        threats = {w: (1, w) for w in WORDS["threat"].split()}
        for key in [*model.lexicon, *threats.values()]:
            self.seeker.add_word(key[1], (key, len(key[1])))
        self.seeker.make_automaton()
        self.lengths = sorted({len(w) for whole, w in model.lexicon if not whole})

    def hit(self, token: str) -> tuple[str, float]:
        keys = [(1, token), *((0, token[:n]) for n in self.lengths if n < len(token))]
        w, key = max(((self.weights.get(k, 0.0), k) for k in keys), key=lambda x: x[0])
        if w:
            return "threat" if key in self.threats else "insult", w
        return self.classes.get(token, "other" if token[0].isalpha() else "pause"), 2.0

    def clauses(self, text: str) -> list[str]:
        """The clauses with a word of the lexicon or a threat."""
        at = set()
        for end, ((whole, _), n) in self.seeker.iter(text):
            start = end - n + 1
            if (start == 0 or not text[start - 1].isalpha()) and (not whole or end + 1 == len(text) or not text[end + 1].isalpha()):
                at.add(start)
        if not at:
            return []
        ends = [m.start() for m in CLAUSE_END.finditer(text)]
        places = sorted({bisect_right(ends, x - 1) for x in at})
        edges = [-1, *ends, len(text)]
        return [text[edges[i] + 1 : edges[i + 1]] for i in places]

    def features(self, text: str | None) -> list[float]:
        """log(1 + weight) by kind, and that of the weight in a hundred words."""
        total = dict.fromkeys(KINDS, 0.0)
        low = (text or "").lower()
        for clause in self.clauses(low):
            hits = [self.hit(token) for token in SYMBOL.findall(clause)]
            for (kind, w), flags in zip(hits, self.grammar.flags([k for k, _ in hits]), strict=True):
                if kind in ("insult", "threat"):
                    total[kind_of(kind, flags)] += w
        x = [np.log1p(total[k]) for k in KINDS]
        return [*x, np.log1p(sum(total.values()) * 600 / (len(low) + 60))]

    def score(self, x: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.coef[0] + np.dot(self.coef[1:], x), -30, 30))))


def held_out(id_col):
    return F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Labelled texts to learn from (bounded), and how many labelled rows of each kind there are."""
    rows = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y")).where(~held_out(F.col("doc_id")))
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    order = F.xxhash64("doc_id")
    picked = rows.where("y = 1").orderBy(order).limit(TOXIC_ROWS).unionByName(rows.where("y = 0").orderBy(order).limit(CLEAN_ROWS))
    # rows that share an id are one row, so that what is learned from is as bounded as the ids
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.max("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text")), counts


def _words(batches):
    """Words ("1") and stems ("0") of each text, and again ("3", "2") those that follow a modal verb."""
    modals = set(WORDS["modal"].split())
    for batch in batches:
        out = []
        for text in batch.column(0):
            low = (text.as_py() or "").lower()
            tokens = TOKEN.findall(low)
            after = {w for i, t in enumerate(tokens) if t in modals for w in tokens[i + 1 : i + 1 + VERB]}
            stems = lambda ws: {w[:n] for w in ws for n in STEMS if n < len(w)}
            words = set(tokens)
            out.append([*("1" + w for w in words), *("0" + w for w in stems(words)), *("3" + w for w in after), *("2" + w for w in stems(after))])
        group = [int(s[0]) >> 1 if len(s := shingle_set(t.as_py())) else 0 for t in batch.column(0)]
        yield pa.record_batch([batch.column(1), batch.column(2), pa.array(group, pa.int64()), pa.array(out, pa.list_(pa.string()))], ["y", "doc_id", "copy", "words"])


def learn_lexicon(sample: DataFrame, toxic: int, clean: int) -> Model:
    """The lexicon learned: every feature of the sample that reaches the bounds, insults and threats told apart by their place."""
    found = sample.select("text", "y", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(lean(_words), "y int, doc_id long, copy long, words array<string>")
    # the copy with the smallest id speaks for the others, so that every run learns the same
    found = found.groupBy("y", "copy").agg(F.min_by("words", "doc_id").alias("words"))
    counted = found.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (toxic + 1)) - F.log((F.col("neg") + 0.5) / (clean + 1))
    best = counted.where(F.col("pos") >= LEAST_ROWS).withColumn("odds", odds)
    best = best.where((F.col("odds") >= LEAST_ODDS) | F.col("word").rlike("^[23]")).collect()
    lexicon = {(int(r.word[0]), r.word[1:]): min(r.odds, 8.0) for r in best if r.word[0] in "01"}
    seen = {r.word: r.pos for r in best}
    threats = frozenset(k for k in lexicon if seen.get(f"{k[0] + 2}{k[1]}", 0) >= VERB_SHARE * seen[f"{k[0]}{k[1]}"])
    stems = {w for whole, w in lexicon if not whole}
    # a longer word of an accepted stem adds nothing
    covered = lambda w: any(w[:n] in stems for n in STEMS if n < len(w))
    learned = {k: v for k, v in lexicon.items() if not covered(k[1])}
    return Model({(1, w): 3.0 for w in WORDS["insult"].split()} | learned, threats & set(learned))


def _featured(model: Model):
    def run(batches):
        scorer = Scorer(model)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "y": pdf.y, "x": [scorer.features(t) for t in pdf.text]})

    return run


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weighted logistic regression by Newton steps; the intercept is not shrunk."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    shrink = np.diag([1e-3, *[ridge] * x.shape[1]])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + shrink, a.T @ (weight * (y - p)) - shrink @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    sample, counts = training_rows(docs, labels)
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        return Model({(1, w): 3.0 for w in WORDS["insult"].split()})
    model = learn_lexicon(sample, min(TOXIC_ROWS, counts[1]), min(CLEAN_ROWS, counts[0]))
    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y").mapInPandas(_featured(model), "doc_id long, y int, x array<double>").toPandas()
    rows = rows.sort_values("doc_id", ignore_index=True)  # sums in one order
    if rows.y.nunique() == 2:
        weight = np.where(rows.y == 1, counts[1] / (rows.y == 1).sum(), counts[0] / (rows.y == 0).sum())
        model.coef = fit(np.array(rows.x.tolist()), rows.y.to_numpy(float), weight * len(rows) / weight.sum())
    return model


def score_column(model: Model, text_col):
    """Score of a text column under ``model``, as a vectorised function."""

    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def run(batches):
            scorer = Scorer(model)
            for texts in batches:
                yield pa.array([scorer.score(scorer.features(t.as_py())) for t in texts], pa.float64())

        yield from lean(run)(parts)

    return F.arrow_udf(score, "double")(text_col)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = train(docs, labels)
    out = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below 0.5."""
    model = train(docs, labels)
    return docs.where(score_column(model, F.col("text")) < 0.5)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
