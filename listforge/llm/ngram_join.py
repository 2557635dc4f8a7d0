"""N-gram Jaccard join by T-occurrence search, exact at any size of data and of groups.

Two documents link when the Jaccard similarity of their shingle sets is at least 0.8 (9 * overlap >=
4 * (size + size)).  A set of ``s`` shingles can link only with sets it shares ceil(0.8 s) with, which
poses the T-occurrence problem over the inverted lists of its shingles.  It is solved in steps:

1. By hash order, the first p(s) = s - ceil(0.8 s) + l(s) shingles of two linked sets have at least
   min(l, l) in common (l(s) = 1 + s // 10).  Every set posts only these; a set with fewer than that of its
   posted shingles in any other set's postings links with nothing and leaves (``shared_counts``).  Chunks
   of documents count what they share among themselves and post each shingle once, so that a shingle of a
   third of all documents costs a list one entry a chunk.
2. The sets left count all their shingles in the same way: ``r``, those that another set has, bounds every
   overlap.  Sets with r < ceil(0.8 s) leave.
3. Of the rest, lists are ordered short to long, and the l - 1 longest lists of each set are skipped: a
   linked set also stands in one of the others.  Each set is first searched from the most central set it
   shares such a list with (the one with the highest r / s), which joins large groups of near copies into
   components along G edges instead of G * G.
4. Components are cut into chunks of about ``BLOCK`` sets or ``SHINGLES`` shingles, each an index of its own.  A set asks every chunk,
   of its own component too, that it shares a short list with and whose sizes leave a link possible, so what
   moves grows with the sets and the chunks asked, not with pairs.  A chunk answers with the number of
   documents linked, and one set of each other component linked.
5. ``divide_skip`` searches a chunk's inverted lists for a query: the short ones are merged (with a heap, or
   by sorting where they are long in sum), and counts that can still reach T are completed by binary probes
   of the long ones.

Links are counted, by sets and their copies, never listed as pairs.  No list, group or candidate count is
capped.  Sets have 128-bit digests: they go by 64 bits of these, and sets that agree in them by chance are
renamed (``renamed``).  Shingles are 64-bit hashes, compared within pairs of sets.  Lists of more than ``HOT``
sets, blocks of large components and copies of one text are dealt to many tasks.

Defined cases: null, empty and blank texts have the empty set and link with nothing; equal sets always
link; rows with the same doc_id are told apart by their text; a component's id is its smallest non-null
doc_id, null where it has none; rows with a null doc_id link, and join others, like all rows; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from heapq import merge
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.components import components
from ..plans.skew import bounded, spread_join
from .common import drop_path, keyed, lean, mix64, save, shingle_set, table

SHINGLE = 5
#: Postings that a chunk of documents, and a bucket of lists, hold about.
CHUNK, BUCKET = 1_000_000, 400_000
#: Sets, and shingles of these, that an index searched at once holds about.
BLOCK, SHINGLES = 512, 2_000_000
#: Sets that one copy of an index answers about.
ASKS = 1024
#: Rows (of one or two longs) up to which a table is broadcast; beyond it the join is shuffled.
SMALL = 500_000
#: Sets from which on a list is dealt to ``PIECES`` tasks.
HOT, PIECES = 4096, 32
#: Weight of a binary probe against a step of the merge when choosing how many lists are long.
MU = 0.0085
#: Entries of short lists up to which they are merged with a heap.
HEAP = 2000


def least_overlap(s):
    return (4 * s + 4) // 5


def extra(s):
    return 1 + s // 10


def posted(s):
    """Shingles, first by hash, that a set of size s > 0 posts."""
    return s - least_overlap(s) + extra(s)


def required(s):
    """Posted shingles that a set of size s shares at least with any set it links with."""
    return extra(least_overlap(s))


def digest(x: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """128-bit digest of a set: a name of ``bits`` bits, not 0, and the other half."""
    d = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True) >> (64 - bits) or 1, int.from_bytes(d[8:], "little", signed=True)


def shingle_table(docs: DataFrame, full: bool, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(doc_id, n, cid, proof, tokens): set size, digest, and the posted (or all) shingles as little-endian bytes."""

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = shingle_set(text.as_py(), SHINGLE)
                n = len(x)
                blob = x[: n if full else posted(n) if n else 0].tobytes()
                out.append((i, n, *(digest(x, bits) if n else (None, None)), blob))
                held += len(blob)
                if held > 8 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names, types = ["doc_id", "n", "cid", "proof", "tokens"], [pa.int64()] * 4 + [pa.binary()]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, n long, cid long, proof long, tokens binary")


def renamed(sets: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """``sets`` where those whose name stands in ``clashes`` (cid) get one that their whole digest gives."""
    if clashes is None:
        return sets
    named = spread_join(sets, clashes.withColumn("clash", F.lit(True)), "cid", "proof", "left", SMALL)
    own = F.coalesce(F.nullif(F.xxhash64("cid", "proof"), F.lit(0).cast("long")), F.lit(1).cast("long"))
    return named.withColumn("cid", F.when(F.col("clash"), own).otherwise(F.col("cid"))).select(sets.columns)


def in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (..., ``key``, cid, n) with ``block``: the sets of a key in blocks of about ``BLOCK`` sets or ``SHINGLES`` shingles."""
    blocks = rows.groupBy(key).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / SHINGLES)).alias("blocks")).where("blocks > 1")
    dealt = spread_join(rows, blocks, key, "cid", "left", SMALL)
    return dealt.withColumn("block", F.xxhash64(key, F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1))))).drop("blocks")


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return starts, np.diff(np.concatenate((starts, [len(sorted_values)])))


def shared_counts(sets: DataFrame, buckets: int) -> DataFrame:
    """(cid, shared): at least as many as the posted shingles of the set that another set posts too."""
    bits = max(1, (buckets - 1).bit_length())
    parts = min(4000, buckets // 8 + 1)

    def emit(refs: list, blobs: list, chunk: int):
        keep = np.unique(np.array(refs, np.int64), return_index=True)[1]
        tokens = [np.frombuffer(blobs[i], np.uint64) for i in keep]
        ref = np.repeat(np.array(refs, np.int64)[keep], [len(t) for t in tokens])
        token = mix64(np.concatenate(tokens))
        order = np.argsort(token, kind="stable")
        token, ref = token[order], ref[order]
        starts, sizes = _runs(token)
        many = np.repeat(sizes > 1, sizes)
        own, count = np.unique(ref[many], return_counts=True)
        # what is shared within the chunk is counted here; other chunks only hear that the shingle is shared
        token, ref = token[starts], np.where(sizes > 1, 0, ref[starts])
        at = np.searchsorted(token >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        rows = [b for b in range(1 << bits) if at[b] < at[b + 1]]
        out = [[*rows, (1 << bits) + chunk], [token[at[b] : at[b + 1]].tobytes() for b in rows] + [own.tobytes()], [ref[at[b] : at[b + 1]].tobytes() for b in rows] + [count.astype(np.int64).tobytes()]]
        return pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["bucket", "x", "y"])

    def post(batches):
        refs, blobs, held, chunk = [], [], 0, 0
        for batch in batches:
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                refs.append(c), blobs.append(t.as_py())
                held += len(blobs[-1]) >> 3
                if held >= CHUNK:
                    yield emit(refs, blobs, chunk)
                    refs, blobs, held, chunk = [], [], 0, chunk + 1
        if refs:
            yield emit(refs, blobs, chunk)

    def packed(cid, shared):
        """Counts as one row for each of the tables' parts, so that they are added up where they meet."""
        part = mix64(cid.view(np.uint64)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        cid, shared, part = cid[order], shared[order], part[order]
        starts, sizes = _runs(part) if len(part) else (np.empty(0, np.int64),) * 2
        cut = [slice(a, a + n) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        return pa.record_batch([pa.array(part[starts].astype(np.int64)), pa.array([cid[c].tobytes() for c in cut], pa.binary()), pa.array([shared[c].tobytes() for c in cut], pa.binary())], ["part", "x", "y"])

    def close(xs, ys):
        token, ref = np.concatenate(xs), np.concatenate(ys)
        order = np.argsort(token, kind="stable")
        token, ref = token[order], ref[order]
        starts, sizes = _runs(token)
        differ = np.minimum.reduceat(ref, starts) != np.maximum.reduceat(ref, starts)
        return packed(*np.unique(ref[np.repeat(differ, sizes) & (ref != 0)], return_counts=True))

    def count(batches):
        for (bucket,), rows in _sorted_runs(batches):
            if bucket >= 1 << bits:
                for x, y in rows:
                    yield packed(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64))
            else:
                yield close([np.frombuffer(x, np.uint64) for x, _ in rows], [np.frombuffer(y, np.int64) for _, y in rows])

    def total(batches):
        for _, rows in _sorted_runs(batches):
            cid, at = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x, _ in rows]), return_inverse=True)
            shared = np.bincount(at, weights=np.concatenate([np.frombuffer(y, np.int64) for _, y in rows])).astype(np.int64)
            yield pa.record_batch([pa.array(cid), pa.array(shared)], ["cid", "shared"])

    lists = sets.where("cid is not null").select("cid", "tokens").mapInArrow(lean(post), "bucket long, x binary, y binary")
    counts = lists.repartition(max(1, min(buckets, 4000)), "bucket").sortWithinPartitions("bucket").mapInArrow(lean(count), "part long, x binary, y binary")
    return counts.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lean(total), "cid long, shared long")


def _sorted_runs(batches):
    """((first column,), other columns of its rows) of batches sorted by their first column."""
    now, rows = None, []
    for batch in batches:
        for key, *rest in zip(*batch.columns, strict=True):
            key = key.as_py()
            if key != now:
                if rows:
                    yield (now,), rows
                now, rows = key, []
            rows.append(tuple(r.as_py() for r in rest))
    if rows:
        yield (now,), rows


def merged_counts(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids in order, how many of the lists hold each): a heap merge, or a sort where the lists are long in sum."""
    if not lists:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if sum(map(len, lists)) <= HEAP:
        runs = [(c, sum(1 for _ in run)) for c, run in groupby(merge(*(x.tolist() for x in lists)))]
        return np.array([c for c, _ in runs], np.int64), np.array([k for _, k in runs], np.int64)
    ids = np.sort(np.concatenate(lists), kind="stable")
    starts, counts = _runs(ids)
    return ids[starts], counts


def divide_skip(t: int, lists: list[np.ndarray], long_weight: float = MU) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of all ids that stand in at least ``t`` of the sorted lists."""
    empty = np.empty(0, np.int64)
    if t < 1 or len(lists) < t:
        return empty, empty
    lists = sorted(lists, key=len)
    n_long = min(t - 1, int(t / (long_weight * log2(max(2, len(lists[-1]))) + 1)))
    short, probed = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    ids, counts = merged_counts(short)
    good = counts >= t - n_long
    ids, counts = ids[good], counts[good]
    for done, x in enumerate(probed, 1):
        if not len(ids):
            break
        at = np.minimum(np.searchsorted(x, ids), len(x) - 1)
        counts = counts + (x[at] == ids)
        good = counts >= t - n_long + done
        ids, counts = ids[good], counts[good]
    return ids, counts


class SetIndex:
    """Inverted lists of a block of shingle sets."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sizes = ids, np.array([len(x) for x in sets])
        token = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(token, kind="stable")
        token, self.owner = token[order], owner[order]
        self.starts, sizes = _runs(token)
        self.stops = self.starts + sizes
        self.tokens = token[self.starts]

    def links(self, query: np.ndarray) -> list[int]:
        """Ids of the sets that link with the query set."""
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        lists = [self.owner[a:b] for a, b in zip(self.starts[at], self.stops[at], strict=True)]
        found, overlap = divide_skip(least_overlap(len(query)), lists)
        return [self.ids[i] for i in found[9 * overlap >= 4 * (len(query) + self.sizes[found])]]


def search(asks: DataFrame, members: DataFrame, full: DataFrame) -> DataFrame:
    """The links (a, b) between sets and the blocks they ask: ``asks`` (a, block), ``members`` (block, cid).

    ``full`` has the whole sets by cid.  A block's sets are sent once, a query's set once for each block it asks.
    """
    wanted = members.join(asks.select("block").distinct(), "block", "left_semi")
    index = wanted.join(full.select("cid", "tokens"), "cid").select("block", F.lit(0).alias("kind"), "cid", "tokens")
    query = asks.join(full.select(F.col("cid").alias("a"), "tokens"), "a").select("block", F.lit(1).alias("kind"), F.col("a").alias("cid"), "tokens")

    def run(batches):
        now, ids, sets, index, out = None, [], [], None, ([], [])
        for batch in batches:
            for block, kind, cid, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if block != now:
                    now, ids, sets, index = block, [], [], None
                x = np.frombuffer(x, np.uint64)
                if kind == 0:
                    ids.append(cid), sets.append(x)
                    continue
                index = index or SetIndex(ids, sets)
                good = [b for b in index.links(x) if b != cid]
                out[0].extend([cid] * len(good)), out[1].extend(good)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])
            out = ([], [])

    rows = index.unionByName(query).repartition("block").sortWithinPartitions("block", "kind", "cid")
    return rows.mapInArrow(lean(run), "a long, b long")


def count_links(asks: DataFrame, members: DataFrame, full: DataFrame) -> DataFrame:
    """(a, b, links) by set and block asked: documents of the block's sets that link, and sets of other components.

    ``asks`` (a, own, block), ``members`` (block, cid, component, copies).  Rows with a null ``b`` hold the number of
    links, the others one linked set of each component but ``own``.
    """
    # a block that many sets ask is an index of several tasks, each of which answers some of them
    parts, _ = save(asks.groupBy("block").agg(F.ceil(F.count("*") / ASKS).alias("parts")), "parts")
    members = members.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    asks = spread_join(asks, parts.where("parts > 1"), "block", "a", "left", SMALL).withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))))
    index = members.join(full.select("cid", "tokens"), "cid").select("block", "part", F.lit(0).alias("kind"), "cid", "tokens", "component", "copies")
    query = asks.join(full.select(F.col("cid").alias("a"), "tokens"), "a").select("block", "part", F.lit(1).alias("kind"), F.col("a").alias("cid"), "tokens", F.col("own").alias("component"), F.lit(0).cast("long").alias("copies"))

    def run(batches):
        now, ids, sets, held, index, out = None, [], [], {}, None, ([], [], [])
        for batch in batches:
            for block, part, kind, cid, x, component, copies in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (block, part) != now:
                    now, ids, sets, held, index = (block, part), [], [], {}, None
                x = np.frombuffer(x, np.uint64)
                if kind == 0:
                    ids.append(cid), sets.append(x)
                    held[cid] = (component, copies)
                    continue
                index = index or SetIndex(ids, sets)
                good = [b for b in index.links(x) if b != cid]
                if good:
                    others = {held[b][0]: b for b in good if held[b][0] != component}
                    out[0].extend([cid] * (1 + len(others))), out[1].extend([None, *others.values()])
                    out[2].extend([sum(held[b][1] for b in good), *[0] * len(others)])
            yield pa.record_batch([pa.array(x, pa.int64()) for x in out], ["a", "b", "links"])
            out = ([], [], [])

    rows = index.unionByName(query).repartition("block", "part").sortWithinPartitions("block", "part", "kind", "cid")
    return rows.mapInArrow(lean(run), "a long, b long, links long")


def short_lists(full: DataFrame, alive: DataFrame) -> DataFrame:
    """(token, cid, n, r, len): postings of the sets alive, without those unique to a set and those in its longest lists."""

    def run(batches):
        for batch in batches:
            tokens, cids, ns, rs = [], [], [], []
            for c, n, r, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                tokens.append(np.frombuffer(x, np.uint64)[: posted(n)].view(np.int64))
                k = len(tokens[-1])
                cids.append(np.full(k, c)), ns.append(np.full(k, n)), rs.append(np.full(k, r))
            if tokens:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (tokens, cids, ns, rs)], ["token", "cid", "n", "r"])

    lists = full.select("cid", "tokens").join(bounded(alive, SMALL), "cid").select("cid", "n", "r", "tokens").mapInArrow(lean(run), "token long, cid long, n long, r long")
    lists, _ = save(lists, "postings")
    length, _ = save(lists.groupBy("token").agg(F.count("*").alias("len")).where("len > 1"), "lengths")
    # rows of long lists meet their length in a broadcast (or spread) join, those of short ones in a shuffled one
    long = length.where(F.col("len") > HOT)
    if long.isEmpty():
        measured = lists.join(length, "token")
    else:
        rest = spread_join(lists, long.select("token"), "token", "cid", "left_anti", SMALL)
        measured = spread_join(lists, long, "token", "cid", "inner", SMALL).unionByName(rest.join(length.where(F.col("len") <= HOT), "token"))
    own = Window.partitionBy("cid")
    n = F.col("n")
    least = F.expr("(4 * n + 4) div 5")
    all_posted = n - least + 1 + F.expr("n div 10")
    ranked = measured.withColumn("place", F.row_number().over(own.orderBy("len", "token"))).withColumn("kept", F.count("*").over(own))
    # shingles that no other set posts come first in the order and use up places
    last = all_posted - (1 + F.expr("((4 * n + 4) div 5) div 10")) + 1
    return ranked.where(all_posted - F.col("kept") + F.col("place") <= last).select("token", "cid", "n", "r", "len")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of lists (token, cid, len) with the piece of their list that they belong to."""
    return rows.withColumn("piece", F.when(F.col("len") > HOT, F.pmod(F.xxhash64("cid"), F.lit(PIECES))).otherwise(0))


def _copied(rows: DataFrame) -> DataFrame:
    """Rows by list (token, len) for each piece of their list."""
    return rows.withColumn("piece", F.explode(F.when(F.col("len") > HOT, F.sequence(F.lit(0).cast("long"), F.lit(PIECES - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))).drop("len")


def _possible(n1, r1, n2, r2):
    """Whether sizes and shared shingles of two sets leave a link possible."""
    return (5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)) & (9 * F.least(r1, r2) >= 4 * (n1 + n2))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, n_links) of every document; see the module's text.

    class_id is the smallest doc_id with the same shingle set, component_id the smallest reachable by links, and
    n_links the number of other documents that the document links with.
    """
    spark = docs.sparkSession
    sets, sets_at = save(shingle_table(docs, False, id_col, text_col, bits), "shingles")
    classed = lambda x: x.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies"), (F.min("proof") != F.max("proof")).alias("clash"))
    classes, _ = save(classed(sets), "classes")
    clashes = classes.where("clash").select("cid")
    if clashes.isEmpty():
        clashes = None
    else:
        sets = renamed(sets, clashes)
        classes, _ = save(classed(sets), "classes")
    total = sets.select(F.sum(F.length("tokens")) / 8).first()[0] or 0
    shared = shared_counts(sets, int(total // BUCKET) + 1)
    left, _ = save(classes.join(shared, "cid").where(F.col("shared") >= 1 + F.expr("((4 * n + 4) div 5) div 10")).select("cid", "rep", "n"), "active")
    names, _ = save(sets.select("doc_id", "n", "cid"), "names")
    drop_path(spark, sets_at)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    again = texts.join(bounded(left.select(F.col("rep").alias("doc_id")).distinct(), SMALL), "doc_id", "left_semi")
    if not left.where("rep is null").isEmpty():
        again = again.unionByName(texts.where("doc_id is null"))
    full = renamed(shingle_table(again, True, bits=bits), clashes)
    full, _ = save(full.join(bounded(left.select("cid"), SMALL), "cid", "left_semi").dropDuplicates(["cid"]).select("cid", "tokens"), "sets")
    total = full.select(F.sum(F.length("tokens")) / 8).first()[0] or 0
    held = shared_counts(full, int(total // BUCKET) + 1).withColumnRenamed("shared", "r")
    alive, _ = save(left.select("cid", "n").join(held, "cid").where("r >= (4 * n + 4) div 5").select("cid", "n", "r"), "alive")
    lists, _ = save(short_lists(full, alive), "lists")

    # the most central set of each list
    pivot = lists.groupBy("token").agg(F.max_by(F.struct("cid", "n", "r"), F.struct(F.col("r") / F.col("n"), "cid")).alias("p"), F.max("len").alias("len"), F.count("*").alias("k")).where("k > 1")
    pivot = _copied(pivot.select("token", "len", F.col("p.cid").alias("a"), F.col("p.n").alias("an"), F.col("p.r").alias("ar")))
    stars = _dealt(lists).join(pivot, ["token", "piece"]).where((F.col("a") != F.col("cid")) & _possible(F.col("n"), F.col("r"), F.col("an"), F.col("ar"))).groupBy("cid", "a").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    stars, _ = save(stars.groupBy("cid").agg(F.max_by("a", F.struct("k", "a")).alias("a"), F.max("n").alias("n")), "stars")
    keep = lambda df: save(df, "labels")[0]
    rays, _ = save(in_blocks(stars, "a").select("a", "block", "cid"), "rays")
    first, _ = save(search(rays.select("a", "block").distinct(), rays.select("block", "cid"), full), "links")
    named = components(first, keep)

    labelled = alive.select("cid", "n").join(named.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    labelled, _ = save(labelled.join(stars.select("cid", "a"), "cid", "left"), "labelled")
    # small components share the blocks of the pivot that their sets were searched from
    large = labelled.groupBy("component").agg(F.count("*").alias("members")).where(F.col("members") * 4 >= BLOCK)
    labelled = spread_join(labelled, large, "component", "cid", "left", SMALL)
    labelled = labelled.withColumn("home", F.when(F.col("members").isNotNull(), F.col("component")).otherwise(F.coalesce("a", "component")))
    homes, _ = save(labelled.select("cid", "n", "component", "home"), "homes")
    labelled, _ = save(in_blocks(homes, "home").select("cid", "component", "block"), "blocks")
    inside, _ = save(lists.join(labelled, "cid"), "inside")
    x = _dealt(inside).select("token", "piece", F.col("cid").alias("a"), "n", "r", F.col("component").alias("own"))
    y = _copied(inside.groupBy("token", "block").agg(F.max("len").alias("len"), F.count("*").alias("k"), F.min("cid").alias("c0"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("r").alias("most")))
    # no set of the block can link unless some size of it fits, and some set shares enough
    fits = (5 * F.col("high") >= 4 * F.col("n")) & (4 * F.col("low") <= 5 * F.col("n")) & (4 * (F.col("n") + F.greatest(F.col("low"), F.expr("(4 * n + 4) div 5"))) <= 9 * F.least("r", "most"))
    other = (F.col("k") > 1) | (F.col("c0") != F.col("a"))
    asks = x.join(y, ["token", "piece"]).where(other & fits).select("a", "own", "block").distinct()
    members = labelled.select("block", "cid", "component").join(classes.select("cid", "copies"), "cid")
    more, _ = save(count_links(save(asks, "asks")[0], members, full), "links")
    joined = components(first.unionByName(more.where("b is not null").select("a", "b")), keep)
    counted = more.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("others"))

    named, _ = save(classes.join(joined.select(F.col("id").alias("cid"), "component"), "cid").select("cid", "rep", "copies", "component"), "named")
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = spread_join(named, lowest, "component", "cid", "inner", SMALL).select("cid", "rep", "copies", "component_id")
    copied = classes.where("copies > 1").join(linked.select("cid"), "cid", "left_anti").select("cid", "rep", "copies", F.col("rep").alias("component_id"))
    groups = linked.unionByName(copied).join(counted, "cid", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
    groups, _ = save(groups.select("cid", "rep", "component_id", "n_links"), "groups")
    # copies of one text may be a third of all rows
    out = spread_join(names.withColumn("at", F.monotonically_increasing_id()), groups, "cid", "at", "left", SMALL)
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id; all of those without shingles.

    Rows are told apart by a number of their own, so that repeated rows, rows that share a doc_id and rows
    without one are treated as the documents they are.
    """
    rows, _ = keyed(docs)
    groups = near_duplicates(rows.select("_row", "text"), "_row").where("n_links > 0").select("_row", "component_id")
    groups, _ = save(groups.join(rows.select("_row", "doc_id"), "_row"), "members")
    kept = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("k")).select(F.col("k._row").alias("_row"))
    dropped = groups.select("_row").join(kept, "_row", "left_anti")
    return rows.join(bounded(dropped, SMALL), "_row", "left_anti").select(docs.columns)


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
