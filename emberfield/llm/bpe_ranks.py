"""Byte-level BPE over a rank file, with a hierarchical-bitmap queue of merge ranks.

Method. The pieces of a pre-token form a linked list. Every adjacent pair that is a token stands in
the bucket of its rank, as its list position; a bitmap of three levels
tells by find-first-set which rank comes next. Popped positions whose pair has changed since
are stale and skipped. Many short pre-tokens share one list (their ends are not
linked), so one pop merges the same pair in all of them; a long pre-token
has a queue of its own, whose pops cost the same however long it is.
Distinct chunks of a slice are encoded once; see ``tokens``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from emberfield.llm.textbatch import encoded, flat, slices
from emberfield.llm.tokens import Memory, chunk_offsets, gathered

#: Pre-tokens of more bytes get a queue of their own.
LONG = 64
SLICE = 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class RankQueue:
    """Set of ranks with its minimum, as three bitmap levels of 64-bit words."""

    def __init__(self, size: int):
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0

    def add(self, rank: int) -> None:
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> int:
        """Remove and return the smallest rank; -1 if there is none."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = (a << 6) | ((word & -word).bit_length() - 1)
        word = self.low[b]
        rank = (b << 6) | ((word & -word).bit_length() - 1)
        self.low[b] &= word - 1
        if not self.low[b]:
            self.mid[a] &= ~(1 << (b & 63))
            if not self.mid[a]:
                self.top &= ~(1 << a)
        return rank


class Bpe:
    """Encoder and decoder of one rank file."""

    _made: dict[str, "Bpe"] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.table = [b""] * self.size
        for token, rank in ranks.items():
            self.table[rank] = token
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
        order = np.argsort(keys)
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        self.pairs = dict(zip(keys, values))
        self.memory = Memory()

    @classmethod
    def of(cls, path: str, pattern: str) -> "Bpe":
        """One per file and worker."""
        if path not in cls._made:
            cls._made[path] = cls(read_ranks(path), pattern)
        return cls._made[path]

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def encode_long(self, word: bytes) -> np.ndarray:
        """Ids of one pre-token by a queue of its own."""
        size, pairs = self.size, self.pairs
        token = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        held = [-1] * n
        buckets: dict[int, list[int]] = {}
        queue = RankQueue(size)

        def push(at: int) -> None:
            right = after[at]
            rank = pairs.get(token[at] * size + token[right], -1) if right < n else -1
            held[at] = rank
            if rank >= 0:
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [at]
                    queue.add(rank)
                else:
                    heapq.heappush(bucket, at)

        for at in range(n):
            push(at)
        while (rank := queue.pop()) >= 0:
            bucket = buckets.pop(rank)
            while bucket:
                at = heapq.heappop(bucket)
                if held[at] != rank:
                    continue  # stale
                right = after[at]
                held[right] = -1
                token[at], after[at] = rank, after[right]
                if after[at] < n:
                    before[after[at]] = at
                lower = False
                for side in (before[at], at):
                    if side >= 0:
                        push(side)
                        lower |= -1 < held[side] < rank
                        if held[side] == rank and buckets.get(rank):
                            heapq.heappush(bucket, side)
                buckets.pop(rank, None)
                if lower:
                    break
            if bucket:
                # A lower rank comes first; the rest of this bucket waits.
                buckets[rank] = bucket
                queue.add(rank)
            elif rank not in buckets and self._has(queue, rank):
                self._drop(queue, rank)
        out, at = [], 0
        while at < n:
            out.append(token[at])
            at = after[at]
        return np.array(out, np.uint32)

    @staticmethod
    def _has(queue: RankQueue, rank: int) -> bool:
        return bool(queue.low[rank >> 6] >> (rank & 63) & 1)

    @staticmethod
    def _drop(queue: RankQueue, rank: int) -> None:
        queue.low[rank >> 6] &= ~(1 << (rank & 63))
        if not queue.low[rank >> 6]:
            queue.mid[rank >> 12] &= ~(1 << ((rank >> 6) & 63))
            if not queue.mid[rank >> 12]:
                queue.top &= ~(1 << (rank >> 12))

    def encode_many(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of many short pre-tokens that share one list and one queue."""
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(ends) else 0
        token = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        held = np.full(n + 1, -1, np.int64)
        linked = np.flatnonzero(after >= 0)
        held[linked] = self._pair_ranks(token[linked], token[after[linked]])
        alive = np.ones(n, bool)
        buckets: dict[int, list[np.ndarray]] = {}
        queue = RankQueue(self.size)

        def push(at: np.ndarray) -> None:
            ranks = held[at]
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            first = [0, *cuts.tolist()]
            for rank, a, b in zip(ranks[first].tolist(), first, [*first[1:], len(at)]):
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [at[a:b]]
                    queue.add(rank)
                else:
                    bucket.append(at[a:b])

        push(linked)
        while (rank := queue.pop()) >= 0:
            own = buckets.pop(rank)
            at = own[0] if len(own) == 1 else np.concatenate(own)
            at = at[held[at] == rank]  # the others are stale
            if len(at) > 1:
                at = np.unique(at)
                of = word[at]
                first = np.ones(len(at), bool)
                first[1:] = of[1:] != of[:-1]
                if not first.all():
                    # The leftmost of each pre-token now; a merge may bring up a lower rank before the next.
                    buckets[rank] = [at[~first]]
                    queue.add(rank)
                    at = at[first]
            if not len(at):
                continue
            right = after[at]
            far = after[right]
            token[at], after[at] = rank, far
            alive[right] = False
            held[right] = -1
            some = far >= 0
            before[far[some]] = at[some]
            held[at] = -1
            held[at[some]] = self._pair_ranks(token[at[some]], token[far[some]])
            left = before[at]
            left = left[left >= 0]
            held[left] = self._pair_ranks(token[left], token[after[left]])
            push(np.concatenate((left, at)))
        counts = np.concatenate(([0], np.cumsum(alive)))[ends]
        return np.split(token[alive].astype(np.uint32), counts[:-1])

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        parts = [[w.encode() for w in self.pattern.findall(c.decode("utf-8"))] for c in chunks]
        known: dict[bytes, np.ndarray] = {}
        for w in {w for p in parts for w in p}:
            rank = self.ranks.get(w)
            if rank is not None:
                known[w] = np.array([rank], np.uint32)
            elif len(w) > LONG:
                known[w] = self.encode_long(w)
            else:
                known[w] = None
        short = [w for w, ids in known.items() if ids is None]
        known.update(zip(short, self.encode_many(short)))
        return [b"".join([known[w].tobytes() for w in p]) for p in parts]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, and the bounds of each row; null rows are empty."""
        data, offsets = flat(column)
        cuts = chunk_offsets(data, offsets)
        codes, chunks = encoded(data, cuts)
        made = self.memory.looked_up(chunks, self._encode)
        ends = np.concatenate(([0], np.cumsum([len(m) // 4 for m in made]))).astype(np.int64)
        values, bounds = gathered(np.frombuffer(b"".join(made), np.uint32), ends, codes)
        return values, bounds[np.searchsorted(cuts, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.table.__getitem__, ids.tolist()))


def _coded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, carried: list[str], keep: bool):
    bpe = Bpe.of(path, pattern)
    for part in slices(batches, "text", SLICE):
        ids, bounds = bpe.encode(part.column("text"))
        rows: dict[str, list] = {k: [] for k in ("ids_sha256", "decoded_sha256", "ids", "decoded")}
        for a, b in zip(bounds[:-1], bounds[1:]):
            raw = ids[a:b].astype("<u4").tobytes()
            back = bpe.decode(ids[a:b])
            rows["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
            rows["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            if keep:
                rows["ids"].append(raw)
                rows["decoded"].append(back)
        columns = {c: part.column(c) for c in carried} | {"n_tokens": pa.array(np.diff(bounds).astype(np.int64))}
        columns |= {k: pa.array(rows[k], pa.string()) for k in ("ids_sha256", "decoded_sha256")}
        if keep:
            columns |= {k: pa.array(rows[k], pa.binary()) for k in ("ids", "decoded")}
        yield pa.record_batch(columns)


def encode_decode(docs: DataFrame, ranks: str, pattern: str, keep: bool = False) -> DataFrame:
    """Encode every text and decode the ids: ``n_tokens, ids_sha256, decoded_sha256`` beside the other columns.

    With ``keep`` also ``ids`` (little-endian 32-bit) and ``decoded`` as bytes. The text column is
    left out; columns of the added names are replaced. A null text is empty.
    """
    added = {"text", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"}
    carried = [c for c in docs.columns if c not in added]
    frame = docs.select(*[F.col(f"`{c}`") for c in carried], "text")
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != "text"]
        + ["n_tokens long, ids_sha256 string, decoded_sha256 string"]
        + ["ids binary, decoded binary"] * keep
    )
    return frame.mapInArrow(lambda it: _coded(it, ranks, pattern, carried, keep), schema)
