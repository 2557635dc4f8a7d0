"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order of the pivots nearest to it and posted in the inverted files of its
``POSTED`` nearest pivots.  A query visits the files of its own ``PROBES`` nearest pivots; in each file the
``RERANK`` vectors with the smallest footrule distance of the pivots' orders (the first ``DEPTH`` places of the
vector's, ``PLACES`` of the query's) are reranked by exact cosine, and the files' nearest are merged.

There are about ``GROWTH`` times the square root of the number of vectors as many pivots, ``PIVOTS`` at most and a
quarter of the vectors, taken from the ``SAMPLE`` rows with the smallest hashes of their id; every row is indexed.
A file so holds some sqrt(n) vectors, and a query reads PROBES files, not all rows: work grows as n ** 1.5 until
``PIVOTS`` binds.  Files of more than ``BLOCK`` vectors are cut into blocks, each of which a query of the file visits.

Equal vectors are one vector with its ``k`` + 1 smallest ids, which is all that any query can return of them; so a
vector that a third of all rows share is posted, and asked, once.  A query that found fewer than ``k`` others is
asked again of all files, with all their vectors reranked: results are complete.

Defined cases: vectors that are null, empty, zero, of another length than the first of the sample, or hold null or
non-finite components, and rows with a null id, take no part, as queries or as candidates; a candidate is every row
with another id than the query's; rows that share an id are each searched, and searched for, and count once with the
best score; equal scores go to the smaller id; an empty table, and one without a valid vector, give an empty result.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.skew import spread_join
from .common import lean, save, table

PIVOTS, SAMPLE, GROWTH = 16_384, 65_536, 18
POSTED, PROBES, DEPTH, PLACES, RERANK = 8, 128, 32, 128, 48
BLOCK = 4096
#: Rows of posted vectors and queries that a task gets about, and cells of (queries x vectors x places) held at once.
ROWS, CELLS = 40_000, 4_000_000


def pivot_count(n: int) -> int:
    return max(1, min(PIVOTS, GROWTH * isqrt(n), n // 4))


def scaled(x: np.ndarray) -> np.ndarray:
    """The vectors, those whose squares leave the range of doubles divided by their largest component."""
    with np.errstate(over="ignore", under="ignore"):
        square = (x * x).sum(axis=1)
    odd = ~np.isfinite(square) | (square < 1e-280)
    if odd.any():
        x = x.copy()
        x[odd] /= np.abs(x[odd]).max(axis=1)[:, None]
    return x


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, h1, h2) of the rows that take part; h1 and h2, 128 bits in all, name the vector."""
    kind = df.schema[vec_col].dataType.elementType.simpleString()
    vec = F.col(vec_col) if kind in ("float", "double") else F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where("id is not null and size(vec) > 0")
    rows = rows.where("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vec, x -> x <> 0)")
    return rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(h1, h2, ids, vec): each vector once, with its ``most`` smallest ids."""
    single = rows.groupBy("h1", "h2", "id").agg(F.first("vec").alias("vec"))
    low = single.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("n") <= most)
    return low.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of a list column of one length, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def binary(x: np.ndarray) -> pa.Array:
    """The rows of an array as binary values."""
    x = np.ascontiguousarray(x)
    size = x.strides[0] if len(x) else 1
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * size, size, dtype=np.int32)), pa.py_buffer(x)])


def orders(vectors: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    depth = min(depth, len(pivots))
    out = np.empty((len(vectors), depth), np.int16)
    for a in range(0, len(vectors), 2048):
        s = (unit(vectors[a : a + 2048]) @ pivots.T).astype(np.float32)
        top = np.argpartition(-s, depth - 1, axis=1)[:, :depth] if depth < len(pivots) else np.tile(np.arange(depth), (len(s), 1))
        top.sort(axis=1)
        out[a : a + 2048] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


class File:
    """A block of a pivot's inverted file, in the order of the vectors' smallest ids."""

    def __init__(self, ids: list[list[int]], order: np.ndarray, vectors: np.ndarray, n_pivots: int):
        by = sorted(range(len(ids)), key=lambda i: ids[i][0])
        self.ids, self.order, self.vectors, self.n_pivots = [ids[i] for i in by], order[by], vectors[by], n_pivots
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))

    def footrule(self, asked: np.ndarray) -> np.ndarray:
        """Sum over a vector's pivots of the difference of places; a pivot that the query lacks counts as last."""
        place = np.full((len(asked), self.n_pivots), asked.shape[1], np.int16)
        np.put_along_axis(place, asked.astype(np.int64), np.arange(asked.shape[1], dtype=np.int16)[None, :], 1)
        total = np.zeros((len(asked), len(self.order)), np.int32)
        for j in range(self.order.shape[1]):
            total += np.abs(place[:, self.order[:, j]] - np.int16(j))
        return total

    def search(self, asked: np.ndarray, queries: np.ndarray, most: int, rerank: int | None) -> list[tuple[list[int], list[float]]]:
        """(ids, scores) of the ``most`` nearest found for each query, equal scores by id."""
        out = []
        step = max(1, CELLS // (max(1, len(self.ids)) * 16 + self.n_pivots))
        for a in range(0, len(queries), step):
            q = queries[a : a + step]
            if rerank is not None and rerank < len(self.ids):
                at = np.sort(np.argpartition(self.footrule(asked[a : a + step]), rerank - 1, axis=1)[:, :rerank], axis=1)
            else:
                at = np.tile(np.arange(len(self.ids)), (len(q), 1))
            norm = np.sqrt((q * q).sum(axis=1))
            score = np.stack([(self.vectors[i] * v).sum(axis=1) / (self.norms[i] * n) for i, v, n in zip(at, q, norm, strict=True)])
            best = np.argsort(-score, axis=1, kind="stable")[:, :most]
            for i, s, b in zip(at, score, best, strict=True):
                found = sorted((-float(s[j]), x) for j in b for x in self.ids[i[j]])[:most]
                out.append(([x for _, x in found], [-v for v, _ in found]))
        return out


def visit(index: DataFrame, asked: DataFrame, pivots: np.ndarray, sizes: np.ndarray, most: int, probes: int, rerank: int | None) -> DataFrame:
    """(h1, h2, id, score): what the files of their nearest pivots hold near the queries."""
    dim, n_pivots = pivots.shape[1], len(pivots)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    names = ["pivot", "block", "kind", "h1", "h2", "ids", "prefix", "vec"]
    # floats are sent as such, which loses nothing
    kept = np.float32 if index.schema["vec"].dataType.elementType.simpleString() == "float" else np.float64
    schema = "pivot int, block int, kind int, h1 long, h2 long, ids array<long>, prefix binary, vec binary"

    def dealt(kind: int, places: int):
        def run(batches):
            for whole in batches:
                for a in range(0, whole.num_rows, 512):
                    batch = whole.slice(a, 512)
                    x = scaled(matrix(batch.column(3), dim))
                    order = orders(x, pivots, max(places, DEPTH if kind == 0 else PLACES))
                    post = order[:, :places]
                    row, pivot = np.repeat(np.arange(len(x)), post.shape[1]), post.ravel()
                    if kind == 0:
                        block = batch.column(0).to_numpy()[row].view(np.uint64) % blocks[pivot].astype(np.uint64)
                    else:
                        # a query goes to every block of a file
                        n = blocks[pivot]
                        block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        row, pivot = np.repeat(row, n), np.repeat(pivot, n)
                    at = pa.array(row)
                    columns = [pa.array(pivot.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(np.full(len(row), kind, np.int32))]
                    columns += [c.take(at) for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.list_(pa.int64())), binary(order[:, : DEPTH if kind == 0 else PLACES]), binary(x.astype(kept)))]
                    yield pa.record_batch(columns, names)

        return run

    cells = index.select("h1", "h2", "ids", "vec").mapInArrow(lean(dealt(0, POSTED)), schema)
    cells = cells.unionByName(asked.select("h1", "h2", F.array().cast("array<long>").alias("ids"), "vec").mapInArrow(lean(dealt(1, probes)), schema))

    def run(batches):
        now, file, ids, order, vectors = None, None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
            unpack = lambda i, t: np.frombuffer(b"".join(batch.column(i).to_pylist()), t).reshape(batch.num_rows, -1)
            x = unpack(7, kept).astype(np.float64)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if now != (now := tuple(keys[a, :2])):
                    file, ids, order, vectors = None, [], [], []
                prefix = np.frombuffer(b"".join(batch.column(6).slice(a, b - a).to_pylist()), np.int16).reshape(b - a, -1)
                if keys[a, 2] == 0:
                    ids += batch.column(5).slice(a, b - a).to_pylist()
                    order.append(prefix), vectors.append(x[a:b])
                    continue
                if file is None:
                    if not ids:
                        continue
                    file = File(ids, np.concatenate(order), np.concatenate(vectors), n_pivots)
                found = file.search(prefix, x[a:b], most, rerank)
                row = np.repeat(np.arange(a, b), [len(i) for i, _ in found])
                yield pa.record_batch([batch.column(3).take(pa.array(row)), batch.column(4).take(pa.array(row)), pa.array([i for f, _ in found for i in f], pa.int64()), pa.array([s for _, f in found for s in f], pa.float64())], ["h1", "h2", "id", "score"])

    visits = max(1, int((sizes.sum() + asked.count() * probes) // ROWS))
    return cells.repartition(visits, "pivot", "block").sortWithinPartitions("pivot", "block", "kind").mapInArrow(lean(run), "h1 long, h2 long, id long, score double")


def nearest(found: DataFrame, most: int) -> DataFrame:
    """(name, near): the ``most`` nearest (distance, id) found of each query's vector."""
    best = found.groupBy("h1", "h2", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id")
    best = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return best.groupBy(F.struct("h1", "h2").alias("name")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))).alias("near"))


def search(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, <id>, score): the ``k`` nearest found of each query, by cosine."""
    spark, schema = df.sparkSession, f"query_id long, rank int, {id_col} long, score double"
    rows, asked = usable(df, id_col, vec_col), usable(queries, id_col, vec_col)
    sample = rows.orderBy(F.xxhash64("id"), "id", "h1").limit(SAMPLE).select("vec").toArrow().column(0).combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], schema)
    dim = len(sample[0])
    rows, asked = (x.where(F.size("vec") == dim) for x in (rows, asked))
    index, _ = save(distinct_vectors(rows, k + 1), "vectors")
    names, _ = save(asked.select(F.struct("h1", "h2").alias("name"), F.col("id").alias("query_id")).distinct(), "queries")
    asked, _ = save(asked.groupBy("h1", "h2").agg(F.first("vec").alias("vec")), "asked")
    x = scaled(np.array([v for v in sample.to_pylist() if len(v) == dim], np.float64))
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    pivots = unit(x[: pivot_count(index.count())])

    def lengths(batches):
        total = np.zeros(len(pivots), np.int64)
        for batch in batches:
            total += np.bincount(orders(scaled(matrix(batch.column(0), dim)), pivots, POSTED).ravel(), minlength=len(pivots))
        yield pa.record_batch([pa.array(np.flatnonzero(total).astype(np.int32)), pa.array(total[total > 0])], ["pivot", "n"])

    sizes = np.zeros(len(pivots), np.int64)
    for r in index.select("vec").mapInArrow(lean(lengths), "pivot int, n long").groupBy("pivot").agg(F.sum("n").alias("n")).collect():
        sizes[r.pivot] = r.n
    near, _ = save(nearest(visit(index, asked, pivots, sizes, k + 1, PROBES, RERANK), k + 1), "near")
    full = near.where(F.size("near") > k).select("name")
    short, _ = save(asked.join(full, F.struct("h1", "h2") == full["name"], "left_anti"), "short")
    if not short.isEmpty():
        rest, _ = save(nearest(visit(index, short, pivots, sizes, k + 1, len(pivots), None), k + 1), "near")
        near = near.where(F.size("near") > k).unionByName(rest)
    met = spread_join(names, near, "name", "query_id").select("query_id", F.explode("near").alias("at")).where("at.id <> query_id")
    best = met.groupBy("query_id", F.col("at.id").alias(id_col)).agg(F.min("at.far").alias("far"))
    order = Window.partitionBy("query_id").orderBy("far", id_col)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", id_col, (-F.col("far")).alias("score"))


def op4_ann(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 50 = 0"))
