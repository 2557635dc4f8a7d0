"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sizes are words.  Sources share ``share`` times all words by weight, but none gets more than ``cap`` times
its own; what is cut off is shared by weight among the others (water filling).  Blocks of ``BLOCK`` words go
to the sources by highest quotients, target / (2 k + 1), and each source's blocks to its shards in the same
way, by the shards' words; the words left over (less than a block a source, unless a cap binds) follow.  A
shard is a stream of its documents in seeded order.  It is taken whole as often as its quota allows, and the
rest of the quota is a systematic sample of its blocks with a seeded start, so what each document gives is a
closed formula of the place of its words in the stream: no block becomes a row.

A source has a shard for every ``LEAST`` blocks, ``SHARDS`` at most, so the apportionment handles a bounded number
of rows a source, and a source with a third of all rows is spread over that many.  One task holds a row of a few
numbers for each source (10 million hosts take some 500 MB).

Defined cases: a null text has no words; a null source is a source of its own, after all others; a document
without words and a source without words take 0; repeated rows, and rows that share an id, are separate documents
next to each other in the stream; an empty table gives an empty result.  Every figure depends on the rows and the seed only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Tuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from .common import hashable, keyed, lean, n_words, save, table

BLOCK, SHARDS = 64, 16_384
#: Blocks that a source's shard holds at least, before it is split.
LEAST = 1024


def sainte_lague(weights, seats: int, caps) -> np.ndarray:
    """Seats by highest quotients weight / (2 k + 1), first come first among equals, none above its cap.

    A divisor is found by bisection that gives out all seats but those of about equal quotients, and these go one by one.
    """
    w, caps = np.asarray(weights, float), np.asarray(caps, np.int64)
    got = np.zeros(len(w), np.int64)
    live = np.flatnonzero((w > 0) & (caps > 0))
    seats = int(min(seats, caps[live].sum()))
    if seats <= 0:
        return got
    ww, cc = w[live], caps[live]
    given = lambda d: np.minimum(np.floor(ww / d + 0.5), cc)
    low, high = float((ww / (cc + 1)).min()) / 2, 3 * float(ww.max())
    for _ in range(200):
        middle = (low * high) ** 0.5
        if not low < middle < high:
            break
        low, high = (low, middle) if given(middle).sum() <= seats else (middle, high)
    got[live] = given(high * (1 + 1e-9)).astype(np.int64)
    left = seats - int(got.sum())
    if left:
        open_ = live[got[live] < caps[live]]
        quotient = w[open_] / (2 * got[open_] + 1)
        # a source that gets one of these seats is among as many with the highest quotients
        first = open_[np.lexsort((open_, -quotient))[:left]]
        heap = [(-w[i] / (2 * got[i] + 1), i) for i in first.tolist()]
        heapq.heapify(heap)
        for _ in range(left):
            _, i = heapq.heappop(heap)
            got[i] += 1
            if got[i] < caps[i]:
                heapq.heappush(heap, (-w[i] / (2 * got[i] + 1), i))
    return got


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(skey, source_size, target) of sources (skey, source_size), by water filling over their running sums."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("skey"))) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", w).withColumn("cap", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    levels = ranked.withColumn("level", level).withColumn("full", F.col("cap") / F.col("w") <= F.col("level"))
    top = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return levels.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(top * F.col("w"))).select("skey", "source_size", "target")


def _source_quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("skey", ignore_index=True)
    want = pdf.target.round().astype("int64")
    return pdf.assign(want=want, blocks=sainte_lague(pdf.target, round(pdf.target.sum() / BLOCK), np.maximum(1, -(-want // BLOCK))))[["skey", "source_size", "target", "want", "blocks"]]


def _shard_quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    """Words each shard of one source gives: its blocks, then the source's remaining words where there is room."""
    pdf = pdf.sort_values("shard", ignore_index=True)
    room = pdf.room.to_numpy(np.int64)
    give = sainte_lague(pdf.words, int(pdf.blocks.iloc[0]), room // BLOCK) * BLOCK
    rest = int(pdf.want.iloc[0]) - int(give.sum())
    for i in np.argsort(-room, kind="stable"):
        step = int(np.clip(rest, -give[i], room[i] - give[i]))
        give[i] += step
        rest -= step
    return pdf.assign(give=give)[["skey", "shard", "words", "give"]]


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(id, source, size, source_size, target, taken, passes, part, ranges): words the mix takes of each document.

    ``passes`` counts whole copies; ``part`` the words of one further, partial take (taken = passes * size + part),
    which are those of the document's word ranges ``ranges`` (start, stop), in order.
    ``cap`` is a whole number, so that it bounds each document as it does its source.  ``row_col`` names a column
    with a number of each row's own, which the result carries as ``row``: ids need not be unique.
    """
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    # rows of one id keep their order in every run: by all their columns, and only then by their number
    tie = F.xxhash64(*[F.col(c) for c in hashable(docs) if c != row_col])
    number = F.col(row_col) if row_col else F.lit(0).cast("long")
    base, _ = save(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("skey"), n_words(F.col(text_col)).alias("size"), tie.alias("tie"), number.alias("row")), "sizes")
    sized = targets(base.groupBy("skey").agg(F.sum("size").alias("source_size")), tuple(weights), share, cap)
    sources, _ = save(sized.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_source_quotas, "skey string, source_size long, target double, want long, blocks long"), "sources")
    n_shards = F.least(F.lit(SHARDS), F.greatest(F.lit(1), (F.col("source_size") / (LEAST * BLOCK)).cast("int")))
    placed = base.join(sources.select("skey", "source_size", "target", n_shards.alias("n_shards")), "skey")
    mark = F.xxhash64(F.lit(seed), F.col("id"))
    placed, _ = save(placed.select("id", "row", "tie", "source", "skey", "size", "source_size", "target", mark.alias("mark"), F.pmod(F.shiftright(mark, 20), F.col("n_shards")).alias("shard")), "placed")
    shards = placed.groupBy("skey", "shard").agg(F.sum("size").alias("words")).join(sources.select("skey", "want", "blocks"), "skey").withColumn("room", F.col("words") * cap)
    quotas = shards.groupBy("skey").applyInPandas(_shard_quotas, "skey string, shard long, words long, give long")

    stream = Window.partitionBy("skey", "shard").orderBy("mark", F.col("id").asc_nulls_last(), "size", "tie", "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("stop", F.sum("size").over(stream)).join(quotas, ["skey", "shard"])
    rows = rows.withColumns({"full": F.expr("case when words = 0 then 0 else give div words end"), "rest": F.expr("case when words = 0 then 0 else give % words end")})
    rows = rows.withColumns({"nb": F.expr(f"words div {BLOCK}"), "rb": F.expr(f"rest div {BLOCK}"), "tail": F.expr(f"rest % {BLOCK}")})
    rows = rows.withColumn("phase", F.pmod(F.xxhash64(F.lit(seed), F.col("skey"), F.col("shard")), F.greatest(F.lit(1), F.col("nb") - F.col("rb"))))

    def among_first(t: str) -> str:
        """Words of the partial pass among the first t words of the shard's stream."""
        picked = lambda j: f"(case when nb = 0 then 0 else (least({j}, nb) * rb + phase) div nb end)"
        j = f"({t} div {BLOCK})"
        inside = f"(case when {j} < nb and {picked(f'{j} + 1')} > {picked(j)} then {t} % {BLOCK} else 0 end)"
        return f"({picked(j)} * {BLOCK} + {inside} + case when rb < nb then least({t}, tail) else least(greatest({t} - nb * {BLOCK}, 0), tail) end)"

    rows = rows.withColumn("part", F.expr(f"{among_first('stop')} - {among_first('(stop - size)')}"))
    # picked block number q is the first that brings the count of those picked to q
    picked = lambda j: f"((least({j}, nb) * rb + phase) div nb)"
    first, last = picked(f"((stop - size) div {BLOCK})"), picked(f"((stop + {BLOCK - 1}) div {BLOCK})")
    place = f"((q * nb - phase + rb - 1) div rb - 1) * {BLOCK}"
    blocks = f"case when nb > 0 and rb > 0 and {last} > {first} then transform(sequence({first} + 1, {last}), q -> struct({place} as start, {place} + {BLOCK} as stop)) else array() end"
    left = f"case when rb < nb then struct(0L as start, tail as stop) else struct(nb * {BLOCK} as start, nb * {BLOCK} + tail as stop) end"
    rows = rows.withColumn("spans", F.expr(f"concat(if(rb < nb, array({left}), cast(array() as array<struct<start:bigint,stop:bigint>>)), cast({blocks} as array<struct<start:bigint,stop:bigint>>), if(rb < nb, cast(array() as array<struct<start:bigint,stop:bigint>>), array({left})))"))
    own = "transform(spans, s -> struct(greatest(s.start - (stop - size), 0L) as start, least(s.stop - (stop - size), size) as stop))"
    rows = rows.withColumn("ranges", F.expr(f"filter({own}, s -> s.start < s.stop)"))
    taken = F.col("full") * F.col("size") + F.col("part")
    out = rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"), F.col("full").alias("passes"), "part", "ranges", "row")
    return out if row_col else out.drop("row")


def cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text's words in the ranges (start, stop), as they stand in it; a blank between ranges that do not touch."""
    b = text.encode("utf-8")
    blank = np.isin(np.frombuffer(b, np.uint8), np.array([9, 10, 11, 12, 13, 32], np.uint8))
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    joined: list[list[int]] = []
    for start, stop in ranges:
        if joined and joined[-1][1] == start:
            joined[-1][1] = stop
        else:
            joined.append([start, stop])
    return b" ".join(b[first[i] : last[j - 1]] for i, j in joined).decode("utf-8")


@F.pandas_udf(StringType())
def _cut(parts: Iterator[Tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    def run(batches):
        for text, starts, stops in batches:
            yield pd.Series([None if a is None else cut(t, list(zip(a, b, strict=True))) for t, a, b in zip(text, starts, stops, strict=True)], dtype=object)

    yield from lean(run)(parts)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document once a pass, and once more cut to the word ranges of a partial take.

    Returns the columns of ``docs``; n_chars, where there is one, follows the text.  Plan and rows meet by a number
    of each row's own, so that rows may share ids, sources and sizes.
    """
    rows, _ = keyed(docs)
    plan = mix(rows, row_col="_row", **options).where("taken > 0").select(F.col("row").alias("_row"), "passes", "part", "ranges")
    joined = rows.select("_row", F.struct(*[F.col(c) for c in docs.columns]).alias("_doc")).join(plan, "_row").drop("_row").withColumnRenamed("_doc", "_row")
    whole = F.array_repeat(F.lit(None).cast("array<struct<start:bigint,stop:bigint>>"), F.col("passes").cast("int"))
    takes = F.when(F.col("part") > 0, F.concat(whole, F.array("ranges"))).otherwise(whole)
    taken = joined.select("_row", F.explode(takes).alias("_part"))
    # whole passes do not leave the JVM
    partial = F.col("_part").isNotNull()
    text = F.when(partial, _cut(F.when(partial, F.col("_row.text")), F.col("_part.start"), F.col("_part.stop"))).otherwise(F.col("_row.text"))
    out = taken.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != "text"], text.alias("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
