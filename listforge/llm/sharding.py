"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into ``SLOTS`` slots once and for all.  A map, a table of (slot, shard, version), says
which shard holds a slot; only the map is edited when shards fill up or are added, and only the records of
edited slots move.  Bytes are aggregated by slot, so whatever the data, the driver sees ``SLOTS`` rows.

Defined cases: a null text has no bytes (size 1, CRC-32 of the empty string: 0); records with the same id
and text are numbered one after the other; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save, shared_dir, table

SLOTS = 4096


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, vslot) of every record; the slot depends on the record alone."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias(id_col), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return rows.withColumn("vslot", F.pmod(F.xxhash64(F.col(id_col), F.col("text_crc32")), F.lit(SLOTS)).cast("int"))


def slot_weights(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and records by slot: at most ``SLOTS`` rows."""
    return {r.vslot: (r.bytes, r.rows) for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}


def first_map(weights: dict[int, int], shards: int) -> dict[int, int]:
    """Version 1: largest slot first, each to the shard with the fewest bytes."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(SLOTS), key=lambda x: (-weights.get(x, 0), x)):
        total, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (total + weights.get(slot, 0), shard))
    return out


def rebalanced(old: dict[int, int], weights: dict[int, int], shards: int, slack: float = 0.01) -> dict[int, int]:
    """The next version for ``shards`` shards (0 to shards - 1): edits as few slots as it takes.

    Slots of shards that are gone move first; then the fullest shard gives slots to the emptiest until
    they differ by at most ``slack`` of the mean, or no slot narrows the gap.
    """
    new = dict(old)
    load = dict.fromkeys(range(shards), 0)
    for slot, shard in new.items():
        if shard < shards:
            load[shard] += weights.get(slot, 0)
    for slot in sorted((s for s, x in new.items() if x >= shards), key=lambda s: (-weights.get(s, 0), s)):
        new[slot] = min(load, key=lambda x: (load[x], x))
        load[new[slot]] += weights.get(slot, 0)
    mean = sum(load.values()) / shards
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, shard in new.items():
        held[shard].append(slot)
    for _ in range(2 * SLOTS):
        high, low = max(load, key=lambda x: (load[x], -x)), min(load, key=lambda x: (load[x], x))
        gap = load[high] - load[low]
        if gap <= slack * mean:
            break
        fits = [s for s in held[high] if 0 < weights.get(s, 0) < gap]
        if not fits:
            break
        slot = min(fits, key=lambda s: (abs(weights[s] - min(gap / 2, max(load[high] - mean, 0) or gap / 2)), s))
        held[high].remove(slot), held[low].append(slot)
        new[slot] = low
        load[high] -= weights[slot]
        load[low] += weights[slot]
    return new


def versions(spark: SparkSession, at: str) -> list[int]:
    """Versions of the map stored under the folder ``at``, in order; none where there is no folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def store_map(spark: SparkSession, at: str, shard_of: dict[int, int], version: int) -> int:
    """Writes a version of the map, (slot, shard, version), under ``at``; versions are never overwritten."""
    rows = [(slot, shard_of[slot], version) for slot in sorted(shard_of)]
    spark.createDataFrame(rows, "vslot int, shard int, version int").coalesce(1).write.parquet(f"{at}/v{version}")
    return version


def load_map(spark: SparkSession, at: str, version: int | None = None) -> tuple[dict[int, int], int]:
    """(slot to shard, version): the version asked for, or the last one."""
    found = versions(spark, at)
    if not found or (version is not None and version not in found):
        raise ValueError(f"no version {'of the map' if version is None else version} under {at}")
    version = found[-1] if version is None else version
    return {r.vslot: r.shard for r in spark.read.parquet(f"{at}/v{version}").collect()}, version


def grow(spark: SparkSession, at: str, weights: dict[int, int], shards: int) -> int:
    """Stores the next version of the map, edited for ``shards`` shards and the slots' present bytes."""
    shard_of, version = load_map(spark, at)
    return store_map(spark, at, rebalanced(shard_of, weights, shards), version + 1)


def numbered_map(spark: SparkSession, at: str, weights: dict[int, tuple[int, int]], version: int | None = None) -> DataFrame:
    """(vslot, shard, version, first): a stored map with the number of each slot's first record in its shard."""
    shard_of, version = load_map(spark, at, version)
    first, rows = dict.fromkeys(shard_of.values(), 0), []
    for slot in sorted(shard_of):
        shard = shard_of[slot]
        rows.append((slot, shard, version, first[shard]))
        first[shard] += weights.get(slot, (0, 0))[1]
    return spark.createDataFrame(rows, "vslot int, shard int, version int, first long")


def placed(rows: DataFrame, slot_map: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Records with their shard and their number in it, gapless from 0."""
    in_slot = Window.partitionBy("vslot").orderBy(F.col(id_col).asc_nulls_last(), "text_crc32", "size")
    numbered = rows.withColumn("n", F.row_number().over(in_slot) - 1)
    return numbered.join(F.broadcast(slot_map), "vslot").withColumn("slot", F.col("first") + F.col("n")).drop("n", "first")


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", at: str | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot, vslot, version): shards of nearly equal bytes.

    The map is kept under the folder ``at``: its first version is made there if it has none, and its last one is
    edited to a further version if it is for another number of shards; else it stays as it is.  Without a folder
    the map is made anew in the shared one.
    """
    spark = docs.sparkSession
    at = at or f"{shared_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    rows, _ = save(slotted(docs, id_col, text_col), "slotted")
    weights = slot_weights(rows)
    sizes = {s: w[0] for s, w in weights.items()}
    if not versions(spark, at):
        store_map(spark, at, first_map(sizes, shards), 1)
    elif {*load_map(spark, at)[0].values()} != {*range(shards)}:
        grow(spark, at, sizes, shards)
    return placed(rows, numbered_map(spark, at, weights), id_col)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version"))
