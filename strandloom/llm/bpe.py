"""Byte-level BPE: merges by rank through a queue whose ranks are found in a hierarchical bitmap.

The pre-tokens that a worker has not met before are laid behind each other, a gap after each, as
one linked list of tokens. Each merge rank that some adjacent pair has is a bucket of list
positions; two levels of bitmaps say which buckets hold anything, so that finding the lowest rank is
two find-first-set steps however long the list is. A merge leaves the entries of the pairs that it
broke where they are: they are known to be stale by their rank and skipped when they come up. No
merge crosses a gap, so the order by (rank, position) over the whole list is, within each
pre-token, the order that the pre-token alone would have. n bytes take O(n log n) steps.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandloom.llm.common import Step, with_arrow

#: Bits of a leaf of the bitmap.
LEAF = 256
#: Pre-tokens of one generation of a worker's memory; two generations are held.
REMEMBERED = 150_000
#: Pre-tokens longer than this are not kept.
LONGEST_REMEMBERED = 64


def first_ranks(ranks: dict[bytes, int]) -> np.ndarray:
    """The merge rank of each pair of bytes, at 256 times the first plus the second; -1: none."""
    out = np.full(1 << 16, -1, np.int64)
    for token, rank in ranks.items():
        if len(token) == 2:
            out[token[0] << 8 | token[1]] = rank
    return out


def merge_all(pieces: list[bytes], ranks: dict[bytes, int], pairs: np.ndarray) -> list[bytes]:
    """The ids of each pre-token (none empty) as little-endian unsigned 32-bit integers."""
    if not pieces:
        return []
    buf = b"\0".join(pieces) + b"\0"
    n = len(buf)
    code = np.frombuffer(buf, np.uint8).astype(np.int64)
    gap = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
    rank = np.full(n, -1, np.int64)  # of the pair that starts here; -1: none
    rank[:-1] = pairs[code[:-1] << 8 | code[1:]]
    rank[gap] = rank[gap - 1] = -1
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)[code]
    single[gap] = -1
    ids, queued = single.tolist(), rank.tolist()
    after = np.arange(1, n + 1)
    after[gap] = -1
    before = np.arange(-1, n - 1)
    before[gap[:-1] + 1] = -1
    end, prev = after.tolist(), before.tolist()
    at = np.flatnonzero(rank >= 0)
    at = at[np.argsort(rank[at], kind="stable")]
    found, cuts = np.unique(rank[at], return_index=True)
    # positions in ascending order are heaps already
    buckets: dict[int, list[int]] = {r: x.tolist() for r, x in zip(found.tolist(), np.split(at, cuts[1:]), strict=False)}
    leaves: dict[int, int] = {}
    top = 0
    for r in buckets:
        leaves[r // LEAF] = leaves.get(r // LEAF, 0) | 1 << r % LEAF
        top |= 1 << r // LEAF
    get, bucket_of = ranks.get, buckets.get
    while top:
        k = (top & -top).bit_length() - 1
        leaf = leaves[k]
        r = k * LEAF + (leaf & -leaf).bit_length() - 1
        bucket = buckets[r]
        while bucket:
            i = heappop(bucket)
            if queued[i] != r:
                continue  # stale
            j = end[i]  # the token that joins
            e = end[i] = end[j]
            ids[i] = r
            ids[j] = queued[j] = -1
            lowest = r
            if (stop := end[e]) < 0:
                queued[i] = -1
            else:
                prev[e] = i
                if (q := get(buf[i:stop])) is None:
                    queued[i] = -1
                else:
                    queued[i] = q
                    if (b := bucket_of(q)) is None:
                        buckets[q] = [i]
                        leaves[q // LEAF] = leaves.get(q // LEAF, 0) | 1 << q % LEAF
                        top |= 1 << q // LEAF
                    else:
                        heappush(b, i)
                    if q < lowest:
                        lowest = q
            if (a := prev[i]) >= 0:
                if (q := get(buf[a:e])) is None:
                    queued[a] = -1
                else:
                    queued[a] = q
                    if (b := bucket_of(q)) is None:
                        buckets[q] = [a]
                        leaves[q // LEAF] = leaves.get(q // LEAF, 0) | 1 << q % LEAF
                        top |= 1 << q // LEAF
                    else:
                        heappush(b, a)
                    if q < lowest:
                        lowest = q
            if lowest < r:
                break  # a lower rank has come up
        if not bucket:
            del buckets[r]
            leaf = leaves[k] & ~(1 << r % LEAF)
            leaves[k] = leaf
            if not leaf:
                top &= ~(1 << k)
    left = np.asarray(ids, np.int64)
    flat = left[left >= 0].astype("<u4").tobytes()
    stops = (4 * np.cumsum(left >= 0)[gap]).tolist()
    return [flat[a:b] for a, b in zip([0, *stops], stops, strict=False)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    return np.frombuffer(merge_all([piece], ranks, first_ranks(ranks))[0], "<u4").tolist()


class Vocabulary:
    """Ranks, their pattern, and the ids of pre-tokens met before."""

    #: Bytes of new pre-tokens that are merged in one list.
    SPAN = 1 << 14

    def __init__(self, rank_file: bytes, pattern: str, remembered: int = REMEMBERED):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x)}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.binary())
        self.pairs = first_ranks(self.ranks)
        self.find = regex.compile(pattern).findall
        self.remembered = remembered
        #: The ids of pre-tokens met lately, and of those met before them.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        at = 0
        while at < len(new):
            raw, size = [], 0
            while at + len(raw) < len(new) and size < self.SPAN:
                raw.append(new[at + len(raw)].encode())
                size += len(raw[-1])
            out |= zip(new[at : at + len(raw)], merge_all(raw, self.ranks, self.pairs), strict=True)
            at += len(raw)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; none for null."""
        split = [self.find(t) if t else [] for t in texts]
        young, old = self.young, self.old
        missing = [p for p in dict.fromkeys(chain.from_iterable(split)) if p not in young]
        new = [p for p in missing if p not in old]
        young |= {p: old[p] for p in missing if p in old}
        young |= self._learn(new)
        get = young.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in split]
        for p in new:
            if len(p) > LONGEST_REMEMBERED:
                del young[p]
        if len(young) > self.remembered:
            self.young, self.old = {}, young
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of ``ids[offsets[k]:offsets[k + 1]]`` for each k."""
        taken = self.tokens.take(pa.array(ids))
        _, ends, data = taken.buffers()
        cuts = np.frombuffer(ends, np.int32)[taken.offset : taken.offset + len(taken) + 1][offsets].astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(cuts.tobytes()), data])


_loaded: dict[bytes, Vocabulary] = {}


def vocabulary(rank_file: bytes, pattern: str) -> Vocabulary:
    """One for each worker process."""
    key = hashlib.sha256(rank_file + pattern.encode()).digest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(rank_file, pattern)
    return _loaded[key]


def _lists(parts: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def read_ranks(path: str) -> bytes:
    """A rank file of the driver's; its size is that of a vocabulary, not of the data."""
    with open(path, "rb") as f:
        return f.read()


def encode_step(spark: SparkSession, rank_path: str, pattern: str, text: str = "text", ids: str = "ids") -> Step:
    shared = spark.sparkContext.broadcast(read_ranks(rank_path))

    def fn(texts: pa.Array) -> list[pa.Array]:
        v = vocabulary(shared.value, pattern)
        return [_lists(v.encode(texts.to_pylist()))]

    return Step((text,), (T.StructField(ids, T.ArrayType(T.IntegerType())),), fn)


def decode_step(spark: SparkSession, rank_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> Step:
    shared = spark.sparkContext.broadcast(read_ranks(rank_path))

    def fn(lists: pa.Array) -> list[pa.Array]:
        v = vocabulary(shared.value, pattern)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return [v.decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))]

    return Step((ids,), (T.StructField(decoded, T.BinaryType()),), fn)


def encode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (array of int): every text whole, each match of ``pattern`` merged by itself.

    Null and empty texts have no ids; texts of any length are encoded whole, and repeated rows each by
    itself. Columns called like the result give way to it. What a worker remembers of earlier texts
    saves time only.
    """
    return with_arrow(docs, encode_step(docs.sparkSession, rank_path, pattern, text, ids))


def decode(rows: DataFrame, rank_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with ``decoded`` (binary), the bytes that the ids stand for; null ids give no bytes."""
    return with_arrow(rows, decode_step(rows.sparkSession, rank_path, pattern, ids, decoded))
