"""Byte-level BPE encoding and decoding by merge ranks (operator 7).

A text is split by the vocabulary's pattern; a piece is a token if its bytes have
a rank, else its bytes are merged. Pieces are merged many at once: they are
bucketed by length into padded matrices of token ids, each row merges its
leftmost pair of least rank in every round (only the two ranks beside a merge are
looked up again), rows without a pair leave the matrix. Pairs are found in an
open-addressing hash table, ``(left, right) -> merged``, built from the ranks.
Pieces over ``LONG`` bytes take a heap over a linked list instead, which merges
in the same order in n log n. A bounded memo keeps the ids of pieces seen before.

Rows are encoded alone, in slices of a batch: memory is bounded by the memo and
the longest text. Nulls: a null text has no ids, like the empty one; a null
doc_id stays null; repeated rows give equal rows; other columns are not read.
The vocabulary file must be readable under the same path on every executor.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_rows, tidy

#: Bytes of a piece beyond which the heap is used; pieces remembered by each worker; the longest that is remembered.
LONG, MEMO, MEMO_LENGTH = 256, 100_000, 64
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, LONG)
NONE = np.iinfo(np.int32).max


class RankBpe:
    """An encoder of one rank file (base64 token and rank in each line)."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        # \\s of the pattern is Unicode's White_Space, as in the library that the vocabulary was made for
        self.findall = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.memo: dict[str, bytes] = {}
        self._build_pairs()

    def _build_pairs(self) -> None:
        left, right, made = [], [], []
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a = get(token[:k])
                if a is not None and (b := get(token[k:])) is not None:
                    left.append(a), right.append(b), made.append(rank)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        values = np.array(made, np.int32)
        self.pairs = dict(zip(keys.tolist(), made, strict=True))
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.table_keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.table_values = np.full(1 << self.bits, NONE, np.int32)
        self.probes, todo, step = 0, np.arange(len(keys)), 0
        while len(todo):  # every key tries its next slot; the first of those that find it free takes it
            slot = self._slot(keys[todo], step)
            free = self.table_keys[slot] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.table_keys[slot[first]], self.table_values[slot[first]] = keys[todo[first]], values[todo[first]]
            keep = np.ones(len(todo), bool)
            keep[first] = False
            todo, step = todo[keep], step + 1
        self.probes = step

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it has none or where a side is padding (negative)."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[at].astype(np.uint64) << np.uint64(32) | right[at].astype(np.uint64)
        for step in range(self.probes):
            slot = self._slot(keys, step)
            there = self.table_keys[slot]
            hit = there == keys
            out[at[hit]] = self.table_values[slot[hit]]
            rest = ~hit & (there != np.uint64(0xFFFFFFFFFFFFFFFF))
            if not rest.any():
                break
            at, keys = at[rest], keys[rest]
        return out

    def merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most ``width`` bytes each."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.full((len(pieces), width + 1), -1, np.int32)
        ids[np.arange(width + 1) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((len(pieces), width + 1), NONE, np.int32)
        rank[:, :-1] = self.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width)
        out: list[np.ndarray] = [None] * len(pieces)
        row, columns = np.arange(len(pieces)), np.arange(width)
        while len(row):
            at = rank.argmin(1)  # the first of equals: the leftmost
            n = np.arange(len(row))
            done = rank[n, at] == NONE
            if done.any():
                for r, x in zip(row[done].tolist(), ids[done], strict=True):
                    out[r] = x[x >= 0]
                keep = ~done
                row, ids, rank, at = row[keep], ids[keep], rank[keep], at[keep]
                if not len(row):
                    break
                n = np.arange(len(row))
            ids[n, at] = rank[n, at]
            later = columns > at[:, None]
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(later, rank[:, 1:], rank[:, :-1])
            ids[:, -1], rank[:, -1] = -1, NONE
            rank[n, at] = self.lookup(ids[n, at], ids[n, at + 1])
            has = at > 0
            rank[n[has], at[has] - 1] = self.lookup(ids[n[has], at[has] - 1], ids[n[has], at[has]])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, pairs = len(ids), self.pairs
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := pairs.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return np.array([x for x, on in zip(ids, alive, strict=True) if on], np.int32)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = np.array([r], np.int32)
            elif len(p) > LONG:
                out[i] = self.merge_long(p)
            else:
                buckets.setdefault(next(w for w in WIDTHS if len(p) <= w), []).append(i)
        for width, at in buckets.items():
            step = max(1, (1 << 21) // width)
            for k in range(0, len(at), step):
                part = at[k : k + step]
                for i, x in zip(part, self.merge_matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = x
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [self.findall(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, long = self.memo, {}
        fresh = [p for p in {p for pieces in split for p in pieces} if p not in memo]
        for p, ids in zip(fresh, self.merge([p.encode() for p in fresh]), strict=True):
            (memo if len(p) <= MEMO_LENGTH else long)[p] = ids.tobytes()
        if long:
            return [np.frombuffer(b"".join(memo[p] if len(p) <= MEMO_LENGTH else long[p] for p in pieces), np.int32) for pieces in split]
        return [np.frombuffer(b"".join(map(memo.__getitem__, pieces)), np.int32) for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(4)
def bpe_of(path: str) -> RankBpe:
    return RankBpe(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = bpe_of(path)
    for doc_ids, texts in text_rows(batches, ("doc_id", "text"), 256):
        ids = bpe.encode([t or "" for t in texts])
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        values = np.concatenate([*ids, np.empty(0, np.int32)])
        yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(values))], ["doc_id", "ids"])
    tidy()


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = bpe_of(path)
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            ids = batch.column(batch.schema.get_field_index("ids"))
            flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            out = [bpe.decode(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(batch.schema.get_field_index("doc_id")), ids, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: _encoded(batches, path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the bytes that the ids stand for."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, path), "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """What ``decode(encode())`` gives, in one step: one worker of a task holds the vocabulary, not two that outlive it."""
    kind = "doc_id long, ids array<int>, decoded binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: _decoded(_encoded(batches, path), path), kind)


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes, then the columns named."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(decode(encode(table(spark, sf_dir, "documents"), path), path))


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLES: dict[str, str] = {}
