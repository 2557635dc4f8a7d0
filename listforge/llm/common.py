"""Shared helpers: tables, text chunks, vectorised word hashing."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stored import drop_path, save, shared_dir  # noqa: F401  operators take these from here

#: Word of the shared contracts: maximal run of anything but these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f``, a function of batches, giving what memory it used back when it ends: workers are kept for other tasks."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            _release()

    return run


def gather(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the CSR rows ``index`` of (flat, offsets); also the length of each."""
    lens = offsets[index + 1] - offsets[index]
    ends = np.cumsum(lens)
    if not len(ends) or not ends[-1]:
        return flat[:0], lens
    pos = np.arange(ends[-1], dtype=np.int64)
    pos += np.repeat(offsets[index] - (ends - lens), lens)
    return flat[pos], lens


def text_chunks(column: pa.Array, limit: int = 4 << 20):
    """(start, texts) of runs of about ``limit`` bytes of a text column, null as empty: no more are Python objects at once."""
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        total += n
        if total >= limit or i + 1 == len(column):
            yield start, [t or "" for t in column.slice(start, i + 1 - start).to_pylist()]
            start, total = i + 1, 0


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiply-xorshift hash, vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWER = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if _POWER.get("n", 0) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWER.update(
            n=size,
            up=np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE))]),
            down=np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, inverse))]),
        )
    return _POWER["up"][:n], _POWER["down"][:n]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word of the text, letters A-Z lower-cased, in order.

    Polynomial prefix sums over the UTF-8 bytes: no Python object per word.
    """
    b = np.frombuffer(text.encode("utf-8"), np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    blank = _BLANK[b]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return np.empty(0, np.uint64)
    up, down = _powers(len(b))
    total = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[b] * up)))
    h = (total[last] - total[first]) * down[first]
    return mix64(h + (last - first).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's ``n``-word shingles; of the whole sequence, if it has fewer words."""
    if not text:
        return np.empty(0, np.uint64)
    w = word_hashes(text)
    if not len(w):
        return np.empty(0, np.uint64)
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        h *= np.uint64(0x8EBC6AF09C88C6E3)
        h += w[i : len(w) - k + 1 + i]
    h = mix64(h)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def hashable(df: DataFrame) -> list[str]:
    """Columns that hash functions take: maps have no order of their own."""
    return [c for c, t in df.dtypes if "map<" not in t and t != "variant"]


def keyed(df: DataFrame, name: str = "_row") -> tuple[DataFrame, str]:
    """``df`` with a number of its own for each row, written down so that every later reading sees the same one."""
    return save(df.withColumn(name, F.monotonically_increasing_id()), "keyed")


def n_words(col):
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")
