"""Document fingerprints: Merkle trees over sections, paragraphs and the pieces of paragraphs.

A text is sections (ending with an empty line), these are paragraphs (lines), these are pieces: up to a
sentence's end, or some 40 characters to the end of a word.  Every node is a hash over its children, so equal
texts, and only these, have equal roots, and comparing two trees from the root down leads only into branches
that differ.  A fingerprint is the root and the short hashes of all pieces in the tree's order, so that trees
can be compared without their texts:

    <root, 64 hex digits>:<piece, 8 hex digits each>|<next paragraph>|.../<next section>/...

The likeness of two fingerprints is the share of pieces they have in common (2 * common / (a + b)).

Neighbours: documents are dealt by ranges of their id, in descending order; the first document of each range
is also sent to the range before it, so each document meets its next one whatever the ranges.  A range holds
about ``RANGE`` documents.

Defined cases: a null text is empty; an empty text has one section with one paragraph without pieces, and is
like (1.0) empty texts only; documents with equal ids are ordered by text; null ids come last; the only
document of a table is its own next one.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, table

PIECE = re.compile(r"[^.!?]{1,40}[^\s.!?]*[.!?]*\s*|[.!?]+\s*")
RANGE, MOST_RANGES = 2000, 20_000


def _hash(kind: bytes, children: bytes) -> bytes:
    return hashlib.blake2b(children, digest_size=16, person=kind).digest()


@dataclass
class Tree:
    """paragraphs: (hash, pieces' hashes) by line; sections: (hash, first line, last line + 1)."""

    text: str
    paragraphs: list[tuple[bytes, list[bytes]]]
    sections: list[tuple[bytes, int, int]]
    root: str

    def fingerprint(self) -> str:
        return f"{self.root}:" + "/".join("|".join("".join(p[:4].hex() for p in pieces) for _, pieces in self.paragraphs[a:b]) for _, a, b in self.sections)

    def size(self) -> int:
        return sum(len(ps) for _, ps in self.paragraphs)


def _paragraph(line: str) -> tuple[bytes, list[bytes]]:
    pieces = [_hash(b"piece", x.encode()) for x in PIECE.findall(line)]
    return _hash(b"paragraph", b"".join(pieces)), pieces


def tree(text: str, before: Tree | None = None, same: int = 0) -> Tree:
    """The tree of a text; the first ``same`` lines are taken from the tree ``before``."""
    if same:
        at = -1
        for _ in range(same):
            at = text.index("\n", at + 1)
        paragraphs = before.paragraphs[:same] + [_paragraph(x) for x in text[at + 1 :].split("\n")]
    else:
        paragraphs = [_paragraph(x) for x in text.split("\n")]
    sections, start = [], 0
    for i, (_, pieces) in enumerate(paragraphs):
        if not pieces or i == len(paragraphs) - 1:
            sections.append((_hash(b"section", b"".join(h for h, _ in paragraphs[start : i + 1])), start, i + 1))
            start = i + 1
    root = hashlib.sha256(b"".join(h for h, _, _ in sections)).hexdigest()
    return Tree(text, paragraphs, sections, root)


def _unmatched(xs: list, ys: list, key) -> tuple[list, list]:
    """The members of both lists that are left when equal ones are matched, one for one."""
    left = Counter(map(key, ys))
    rest = []
    for x in xs:
        if left[key(x)] > 0:
            left[key(x)] -= 1
        else:
            rest.append(x)
    left = Counter(map(key, xs))
    other = []
    for y in ys:
        if left[key(y)] > 0:
            left[key(y)] -= 1
        else:
            other.append(y)
    return rest, other


def likeness(a: Tree, b: Tree) -> float:
    """Share of pieces in common, found from the root down: equal sections and paragraphs are matched as they are, and
    only branches that differ are opened.  Pieces go by the digits that fingerprints hold, so that the figure follows from these.
    """
    if a.root == b.root:
        return 1.0
    total = a.size() + b.size()
    if not total:
        return 0.0
    xs, ys = _unmatched(a.sections, b.sections, lambda s: s[0])
    xs, ys = _unmatched([p for _, i, j in xs for p in a.paragraphs[i:j]], [p for _, i, j in ys for p in b.paragraphs[i:j]], lambda p: p[0])
    xs, ys = _unmatched([h[:4] for _, ps in xs for h in ps], [h[:4] for _, ps in ys for h in ps], lambda h: h)
    # what is left unmatched is all that is not in common; texts that differ in the order of their pieces only are no equal texts
    return min(1 - (len(xs) + len(ys)) / total, 1 - 1 / (total + 1))


def differing(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Lines (of a, of b) where equal-numbered branches differ, found from the root down; -1 for a missing line."""
    if a.root == b.root:
        return []
    out = []
    for i in range(max(len(a.sections), len(b.sections))):
        x, y = (t.sections[i] if i < len(t.sections) else None for t in (a, b))
        if x and y and x[0] == y[0]:
            continue
        xs, ys = (range(s[1], s[2]) if s else range(0) for s in (x, y))
        for k in range(max(len(xs), len(ys))):
            p, q = (r[k] if k < len(r) else -1 for r in (xs, ys))
            if p < 0 or q < 0 or a.paragraphs[p][0] != b.paragraphs[q][0]:
                out.append((p, q))
    return out


def edited(text: str, following: str) -> tuple[str, int]:
    """The text whose last third is replaced by the start of the following one; how many whole lines it keeps."""
    k = len(text) // 3
    kept = text[: len(text) - k]
    return kept + following[:k], kept.count("\n")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every whole text."""

    def run(batches):
        for pdf in batches:
            texts = [t or "" for t in pdf.text]
            yield pd.DataFrame({id_col: pdf[id_col], "n_chars": [len(t) for t in texts], "fingerprint": [tree(t).fingerprint() for t in texts]})

    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")).mapInPandas(run, f"{id_col} long, n_chars long, fingerprint string")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents dealt by descending id into ranges: (part, last, id, text), sorted, each range with the next one's first."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranges = min(MOST_RANGES, rows.count() // RANGE + 1)
    cuts = np.unique(rows.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)) if ranges > 1 else np.empty(0)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        at = len(cuts) - np.searchsorted(cuts, ids.to_numpy(float, na_value=-np.inf), side="left")
        return pd.Series(at.astype(np.int32))

    parted = rows.withColumn("part", part_of("id"))
    # one row for each range: its first id, in descending order
    firsts = sorted((r.part, r.first) for r in parted.groupBy("part").agg(F.max("id").alias("first")).collect())
    if not firsts:
        return parted.select("part", F.lit(False).alias("last"), "id", "text")
    sent = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]
    heads = F.broadcast(docs.sparkSession.createDataFrame(sent, "head long, goes int"))
    own = F.struct(F.col("part"), F.lit(False).alias("last"))
    copy = F.struct(F.col("goes").alias("part"), F.lit(True).alias("last"))
    both = F.when(F.col("goes").isNull(), F.array(own)).otherwise(F.array(own, copy))
    dealt = parted.join(heads, F.col("id").eqNullSafe(F.col("head")), "left").select(F.explode(both).alias("to"), "id", "text").select("to.part", "to.last", "id", "text")
    return dealt.repartition(len(firsts), "part").sortWithinPartitions("part", "last", F.desc_nulls_last("id"), F.col("text").asc_nulls_first())


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness and that of the next document.

    ``edited_lines`` counts the lines where the two trees differ, ``first_edited`` is the first of them (from 0).
    """
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_lines", "first_edited"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def row(i, a: Tree, b: Tree) -> tuple:
        text, same = edited(a.text, b.text)
        e = tree(text, a, same)
        places = differing(a, e)
        return i, len(a.text), hashlib.sha256(text.encode()).hexdigest(), a.fingerprint(), e.fingerprint(), likeness(a, e), likeness(a, b), len(places), max(places[0]) if places else None

    def run(batches):
        part, held, closed, out, size = None, None, False, [], 0
        for batch in batches:
            for p, last, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if p != part:
                    part, held, closed = p, None, False
                if closed:
                    continue  # a second document with the id of the next range's first
                now = tree(text.as_py() or "")
                if held:
                    out.append(row(held[0], held[1], now))
                    size += len(held[1].text)
                held, closed = (i, now), last
                if size > 4 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    schema = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_lines long, first_edited long"
    return with_next(docs, id_col, text_col).mapInArrow(lean(run), schema)


def op1_merkle(spark, sf_dir: str) -> DataFrame:
    return edits(table(spark, sf_dir, "documents"))
