"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of all new words of a chunk stand in one flat array.  Each round looks up every adjacent
pair by binary search over the sorted pair keys, takes the lowest rank of each word, and merges that
pair wherever it stands in the word; words without a known pair leave the array.  Words longer than
``LONG`` bytes, whose rounds would cost the square of their length, are merged with a heap over a
linked list instead: the same merges in the same order.

Defined cases: a null text counts as empty (0 tokens, digests of the empty string); special tokens
in a text become their own ids, as the tokenizers library does by default; repeated rows give
repeated rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather, lean, table, text_chunks

#: Fixed value: the pattern that splits text before the merges of this byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 512
#: Words whose merges a task remembers, and characters that it encodes at once, about.
MAX_WORDS, CHARS = 300_000, 1 << 20
NONE = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Numpy tables of one tokenizer file; their size is that of the vocabulary, not of the data."""

    keys: np.ndarray  # sorted pair keys, left << 32 | right
    ranks: np.ndarray
    merged: np.ndarray  # by rank
    first: np.ndarray  # id of each byte
    flat: np.ndarray  # bytes of all tokens
    offsets: np.ndarray
    digits: np.ndarray  # "id," of all tokens
    digit_offsets: np.ndarray
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, alphabet = data["model"]["vocab"], byte_alphabet()
        special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        tokens = [b""] * size
        for token, i in vocab.items():
            tokens[i] = bytes(alphabet[c] for c in token)
        for token, i in special.items():
            tokens[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        digits = [b"%d," % i for i in range(size)]
        ends = lambda xs: np.concatenate(([0], np.cumsum([len(x) for x in xs]))).astype(np.int64)
        return cls(
            keys[order], order.astype(np.int64), np.array([vocab[a + b] for a, b in pairs], np.int64),
            np.array([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int64),
            np.frombuffer(b"".join(tokens), np.uint8), ends(tokens), np.frombuffer(b"".join(digits), np.uint8), ends(digits), special,
        )

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """CSR of the ids of ``words`` (flat ids, offsets), by merge rounds over all of them at once."""
    lens = np.array([len(w) for w in words], np.int64)
    out: list = [None] * len(words)
    for i in np.flatnonzero(lens > LONG):
        out[i] = merge_long(vocab, words[i])
    short = np.flatnonzero((lens <= LONG) & (lens > 0))
    symbols = vocab.first[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
    owner = np.repeat(short, lens[short])
    while len(symbols):
        rank = np.full(len(symbols), NONE)
        rank[:-1] = np.where(owner[:-1] == owner[1:], vocab.rank_of(symbols[:-1], symbols[1:]), NONE)
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(symbols)])))
        lowest = np.minimum.reduceat(rank, starts)
        done = lowest == NONE
        if done.any():
            for w, s, n in zip(owner[starts[done]], starts[done], sizes[done], strict=True):
                out[w] = symbols[s : s + n]
            keep = np.repeat(~done, sizes)
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            lowest, sizes = lowest[~done], sizes[~done]
            if not len(symbols):
                break
        hit = rank == np.repeat(lowest, sizes)
        # in a run of hits (a a a ...) every second pair overlaps the one before it
        index = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), index, -1))
        hit &= (index - run) % 2 == 0
        at = np.flatnonzero(hit)
        symbols = symbols.copy()
        symbols[at] = vocab.merged[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    empty = np.empty(0, np.int64)
    out = [empty if x is None else x for x in out]
    return np.concatenate([empty, *out]), np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)


def merge_long(vocab: Vocabulary, word: bytes) -> np.ndarray:
    """Ids of one long word: lowest rank first, leftmost first, over a linked list."""
    ids = vocab.first[np.frombuffer(word, np.uint8)]
    ranks = vocab.rank_of(ids[:-1], ids[1:]).tolist()
    sym: list = ids.tolist()
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    table = dict(zip(vocab.keys.tolist(), vocab.ranks.tolist(), strict=True)) if n > 4 * LONG else None

    def rank(a: int, b: int) -> int:
        if table is not None:
            return table.get(a << 32 | b, int(NONE))
        key = a << 32 | b
        at = int(np.searchsorted(vocab.keys, key))
        return int(vocab.ranks[at]) if at < len(vocab.keys) and vocab.keys[at] == key else int(NONE)

    heap = [(r, i, sym[i], sym[i + 1]) for i, r in enumerate(ranks) if r != NONE]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = int(vocab.merged[r]), -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (x := rank(sym[i], sym[k])) != NONE:
                heapq.heappush(heap, (x, i, sym[i], sym[k]))
        if (h := before[i]) >= 0 and (x := rank(sym[h], sym[i])) != NONE:
            heapq.heappush(heap, (x, h, sym[h], sym[i]))
    return np.array([s for s in sym if s >= 0], np.int64)


class Codec:
    """Encoder and decoder with a bounded memory of words already merged."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.split = vocab, regex.compile(PATTERN)
        self.stop = regex.compile("|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True)))) if vocab.special else None
        self.clear()

    def clear(self) -> None:
        self.fresh: list[str] = []
        known = self

        class Index(dict):
            def __missing__(self, word):
                self[word] = at = len(self)
                known.fresh.append(word)
                return at

        self.index = Index()
        self.flat, self.offsets = np.empty(0, np.int64), np.zeros(1, np.int64)

    def words(self, text: str) -> list:
        if self.stop is None or not self.stop.search(text):
            return self.split.findall(text)
        out, at = [], 0
        for m in self.stop.finditer(text):
            out += self.split.findall(text[at : m.start()])
            out.append((m[0],))  # a tuple cannot be mistaken for a word
            at = m.end()
        return out + self.split.findall(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """CSR of the ids of ``texts``."""
        if len(self.index) > MAX_WORDS:
            self.clear()
        look, rows, counts = self.index.__getitem__, [], []
        for text in texts:
            words = self.words(text)
            counts.append(len(words))
            rows.append(np.fromiter(map(look, words), np.int64, len(words)))
        if self.fresh:
            plain = [b"" if isinstance(w, tuple) else w.encode() for w in self.fresh]
            flat, offsets = merge_words(self.vocab, plain)
            if not all(plain):
                parts = [np.array([self.vocab.special[w[0]]]) if isinstance(w, tuple) else flat[offsets[i] : offsets[i + 1]] for i, w in enumerate(self.fresh)]
                flat, offsets = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            self.offsets = np.concatenate((self.offsets, offsets[1:] + len(self.flat)))
            self.flat = np.concatenate((self.flat, flat))
            self.fresh.clear()
        index = np.concatenate([np.empty(0, np.int64), *rows])
        ids, lens = gather(self.flat, self.offsets, index)
        ends = np.concatenate(([0], np.cumsum(lens)))
        return ids, ends[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each row; bytes that are no UTF-8 become U+FFFD."""
        flat, lens = gather(self.vocab.flat, self.vocab.offsets, ids)
        return [self._utf8(x) for x in _rows(flat, lens, offsets)]

    @staticmethod
    def _utf8(x: bytes) -> bytes:
        try:
            x.decode()
            return x
        except UnicodeDecodeError:
            return x.decode(errors="replace").encode()

    def decimal(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Decimal ids of each row joined by commas."""
        flat, lens = gather(self.vocab.digits, self.vocab.digit_offsets, ids)
        return [x[:-1] for x in _rows(flat, lens, offsets)]


def _rows(flat: np.ndarray, lens: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    ends = np.concatenate(([0], np.cumsum(lens)))[offsets]
    data = flat.tobytes()
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _shipped(spark, path: str):
    """The vocabulary as a broadcast: its size is that of the file, whatever the data."""
    return spark.sparkContext.broadcast(Vocabulary.load(path))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids array<int>) of every whole text."""
    shipped = _shipped(df.sparkSession, path)

    def run(batches):
        codec = Codec(shipped.value)
        for batch in batches:
            for a, texts in text_chunks(batch.column(1), CHARS):
                ids, offsets = codec.encode(texts)
                yield pa.record_batch([batch.column(0).slice(a, len(texts)), pa.ListArray.from_arrays(offsets.astype(np.int32), ids.astype(np.int32))], [id_col, "token_ids"])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(lean(run), f"{id_col} long, token_ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, text) of rows of token ids, null as empty."""
    shipped = _shipped(df.sparkSession, path)

    def run(batches):
        codec = Codec(shipped.value)
        for batch in batches:
            rows = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
            texts = codec.decode(np.concatenate([np.empty(0, np.int64), *rows]), offsets)
            yield pa.record_batch([batch.column(0), pa.array([t.decode() for t in texts], pa.string())], [id_col, "text"])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col).alias("ids")).mapInArrow(lean(run), f"{id_col} long, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: (id, n_tokens, ids_sha256, decoded_sha256)."""
    shipped = _shipped(df.sparkSession, path)

    def run(batches):
        codec = Codec(shipped.value)
        for batch in batches:
            for a, texts in text_chunks(batch.column(1), CHARS):
                ids, offsets = codec.encode(texts)
                sha = [[hashlib.sha256(x).hexdigest() for x in f(ids, offsets)] for f in (codec.decimal, codec.decode)]
                yield pa.record_batch([batch.column(0).slice(a, len(texts)), pa.array(np.diff(offsets), pa.int64()), pa.array(sha[0]), pa.array(sha[1])], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(lean(run), f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary_path())
