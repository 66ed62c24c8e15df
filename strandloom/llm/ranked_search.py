"""Ranked search over a K2-treap of the term-document grid.

The index has one row for each run of documents (a shard): a grid of its terms by its documents, in
which a posting is a point whose value is its impact, the term's part of the score before the term's
weight. The grid is a quadtree that is a heap as well: a cell keeps its largest point, which is taken
out of the quarters below, and a cell without points does not exist, so that there are as many nodes
as postings. A level is four arrays: where the point is, its impact, and the four bits that say
which quarters exist; where a node's children begin on the next level follows from counting bits.
Rows are ordered by their largest impact, so that a cell's maximum is near that of each of its rows.

A search descends the rows of all terms of an item together, over ranges of documents: the bound of
a range is the sum over the terms of their weight times the larger of their cell's maximum and of the
points of the row met higher up. The range with the highest bound goes first; below ``WHOLE``
documents a range is scored out at once. It ends when no range can reach the k best found, which a
task carries from shard to shard.

Scores are integers: with N documents that have terms, L terms in all, n terms in a document, df
documents that hold a term, and tf times it occurs, the impact is 10**9 * tf div (1000 * tf + 12 * m)
with m = 75 + 25 * n * N div L, and the weight floor(1000 * ln((2 * N + 2) / (2 * df + 1))).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush, heapreplace
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import small_batches
from strandloom.operators.ranks import running_before
from strandloom.session import stash

#: A term is a run of ASCII letters and digits and of anything that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CLEAN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
#: A shard takes documents up to so many, or so many bytes of text, but a whole document at least.
SHARD_DOCS, SHARD_BYTES = 4096, 6 << 20
#: Ranges of so many documents (a power of two) are scored out at once.
WHOLE = 256
#: Bytes of item texts that are searched for in one pass over the index.
ROUND_BYTES = 16 << 20
INDEX = "ids array<long>, terms binary, dfs binary, nodes binary, sizes array<int>"
_BITS = np.array([bin(x).count("1") for x in range(16)], np.int64)


@dataclass
class Treap:
    """Level by level: ``row``, ``col`` and ``value`` of each node's point, the ``mask`` of its quarters and the place of its first child."""

    height: int
    row: list[np.ndarray]
    col: list[np.ndarray]
    value: list[np.ndarray]
    mask: list[np.ndarray]
    first: list[np.ndarray]


def _interleaved(row: np.ndarray, col: np.ndarray, height: int) -> np.ndarray:
    out = np.zeros(len(row), np.int64)
    for b in range(height):
        out |= (row >> b & 1) << (2 * b + 1) | (col >> b & 1) << (2 * b)
    return out


def build_treap(row: np.ndarray, col: np.ndarray, value: np.ndarray) -> Treap:
    """The treap of distinct points (at least one)."""
    height = max(1, int(max(row.max(), col.max())).bit_length())
    place = _interleaved(row, col, height)
    order = np.argsort(place)
    row, col, value, place = row[order], col[order], value[order], place[order]
    rank = value * (len(row) + 1) + np.arange(len(row))[::-1]  # no two alike
    parent, levels = np.zeros(len(row), np.int64), []
    for level in range(height + 1):
        cell = place >> 2 * (height - level)
        new = np.concatenate([[True], cell[1:] != cell[:-1]])
        starts = np.flatnonzero(new)
        if level:
            quarters = np.bincount(parent[starts], weights=1 << (cell[starts] & 3), minlength=len(levels[-1][0]))
            levels[-1][3][:] = quarters.astype(np.uint8)
        number = np.cumsum(new) - 1
        top = rank == np.maximum.reduceat(rank, starts)[number]
        levels.append((row[top], col[top], value[top], np.zeros(len(starts), np.uint8)))
        if top.all():
            break
        row, col, value, place, rank, parent = (x[~top] for x in (row, col, value, place, rank, number))
    return _treap(height, levels)


def _treap(height: int, levels: list[tuple]) -> Treap:
    firsts = [np.cumsum(_BITS[mask]) - _BITS[mask] for *_, mask in levels]
    return Treap(height, *([x[k] for x in levels] for k in range(4)), firsts)


#: How many quarters exist before quarter q of a mask.
_RANK = np.array([[bin(m & (1 << q) - 1).count("1") for q in range(4)] for m in range(16)], np.int64)


def search(treap: Treap, rows: np.ndarray, weights: np.ndarray, offer, least, whole: int = WHOLE) -> None:
    """Score the documents that hold some of ``rows``, best bounds first.

    ``offer(cols, scores)`` is given documents with their whole scores; ``least()`` is the score below
    which none is wanted any more.
    """
    none = np.zeros(0, np.int64)
    heap: list[tuple] = []
    count = 0

    def push(level: int, block: int, term: np.ndarray, node: np.ndarray, seen: tuple) -> None:
        """``term`` numbers the rows whose path goes on at ``node``; ``seen`` are points of the rows met above: term, column, value."""
        nonlocal count
        most = np.zeros(len(rows), np.int64)
        if len(seen[0]):
            np.maximum.at(most, seen[0], seen[2])
        if len(term):
            most[term] = np.maximum(most[term], treap.value[level][node])
        bound = int((most * weights).sum())
        if bound > 0 and bound >= least():
            count += 1
            heappush(heap, (-bound, count, level, block, term, node, seen))

    def step(level: int, term: np.ndarray, node: np.ndarray, seen: tuple) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The points of the rows at these nodes join ``seen``; the quarters of each path, left ones then right ones, follow."""
        if not len(term):
            return none, none, seen
        hit = treap.row[level][node] == rows[term]
        if hit.any():
            at = node[hit]
            seen = (np.concatenate([seen[0], term[hit]]), np.concatenate([seen[1], treap.col[level][at]]), np.concatenate([seen[2], treap.value[level][at]]))
        if level == treap.height or level + 1 >= len(treap.row):
            return none, none, seen
        mask = treap.mask[level][node]
        upper = (rows[term] >> (treap.height - level - 1) & 1) * 2
        return mask, upper, seen

    push(0, 0, np.arange(len(rows)), np.zeros(len(rows), np.int64), (none, none, none))
    while heap:
        bound, _, level, block, term, node, seen = heappop(heap)
        if -bound < least():
            return
        shift = treap.height - level
        if 1 << shift <= whole:
            while len(term):
                mask, upper, seen = step(level, term, node, seen)
                if not len(mask):
                    break
                both_term, both_node = [], []
                for half in (0, 1):
                    q = upper + half
                    there = (mask >> q & 1).astype(bool)
                    both_term.append(term[there])
                    both_node.append(treap.first[level][node[there]] + _RANK[mask[there], q[there]])
                term, node, level = np.concatenate(both_term), np.concatenate(both_node), level + 1
            start = block << shift
            scores = np.zeros(1 << shift, np.int64)
            np.add.at(scores, seen[1] - start, weights[seen[0]] * seen[2])
            good = np.flatnonzero((scores > 0) & (scores >= least()))
            if len(good):
                offer(start + good, scores[good])
            continue
        mask, upper, seen = step(level, term, node, seen)
        middle = (2 * block + 1) << (shift - 1)
        right = seen[1] >= middle
        for half in (0, 1):
            mine = right if half else ~right
            part = tuple(x[mine] for x in seen)
            if len(mask):
                q = upper + half
                there = (mask >> q & 1).astype(bool)
                push(level + 1, 2 * block + half, term[there], treap.first[level][node[there]] + _RANK[mask[there], q[there]], part)
            elif len(part[0]):
                push(level + 1, 2 * block + half, none, none, part)


def _packed(treap: Treap) -> tuple[bytes, list[int]]:
    """The levels' arrays end to end, compressed, and the height followed by the levels' numbers of nodes."""
    parts = [np.concatenate(x).astype(kind).tobytes() for x, kind in ((treap.row, "<u4"), (treap.col, "<u2"), (treap.value, "<u4"), (treap.mask, "u1"))]
    return zstandard.compress(b"".join(parts), 3), [treap.height, *map(len, treap.row)]


def _unpacked(nodes: bytes, sizes: list[int]) -> Treap:
    raw, n, cuts = zstandard.decompress(nodes), sum(sizes[1:]), np.cumsum(sizes[1:])[:-1]
    at, parts = 0, []
    for kind, width in (("<u4", 4), ("<u2", 2), ("<u4", 4), ("u1", 1)):
        parts.append(np.split(np.frombuffer(raw, kind, n, at).astype(np.uint8 if width == 1 else np.int64), cuts))
        at += n * width
    return _treap(sizes[0], list(zip(*parts, strict=True)))


def _shard(ids: list[int | None], texts: list[bytes], n_docs: int, n_terms: int) -> dict[str, object] | None:
    """The index row of some documents' texts, whose separators are blanks."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    flat, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not filled.any():
        return None
    owner = np.repeat(np.arange(len(texts)), lengths)[filled]
    coded = flat.filter(pa.array(filled)).dictionary_encode()
    length = np.bincount(owner, minlength=len(texts)).tolist()
    norm = np.array([12 * (75 + 25 * n * n_docs // n_terms) for n in length], np.int64)
    pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(texts) + owner, return_counts=True)
    term, doc = pair // len(texts), pair % len(texts)
    impact = 1_000_000_000 * tf // (1000 * tf + norm[doc])
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    most = np.zeros(len(words), np.int64)
    np.maximum.at(most, term, impact)
    order = np.argsort(-most, kind="stable")
    row = np.empty(len(words), np.int64)
    row[order] = np.arange(len(words))
    nodes, sizes = _packed(build_treap(row[term], doc, impact))
    dfs = np.bincount(row[term], minlength=len(words)).astype("<u4").tobytes()
    return {"ids": ids, "terms": zstandard.compress(b" ".join(words[k] for k in order.tolist()), 3), "dfs": dfs, "nodes": nodes, "sizes": sizes}


_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("terms", pa.binary()), ("dfs", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.list_(pa.int32()))])


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A written table of shards that hold every document; those without terms have no points. Null texts have no terms."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    n = F.regexp_count("text", F.lit(TERM))
    n_docs, n_terms = rows.select(n.cast("long").alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t.translate(_CLEAN))
                size += len(t)
                if len(ids) >= SHARD_DOCS or size >= SHARD_BYTES:
                    if made := _shard(ids, texts, n_docs, n_terms):
                        yield pa.RecordBatch.from_pylist([made], _SCHEMA)
                    ids, texts, size = [], [], 0
        if ids and (made := _shard(ids, texts, n_docs, n_terms)):
            yield pa.RecordBatch.from_pylist([made], _SCHEMA)

    index, _ = stash(rows.mapInArrow(run, INDEX), "treap-index")
    # the number of documents with terms goes with the index
    return index.withColumn("n_docs", F.lit(n_docs).cast("long"))


def _weights(index: DataFrame, terms: list[bytes], n_docs: int) -> dict[bytes, int]:
    """The weights of those of ``terms`` that some document holds."""
    wanted = index.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, dfs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits = [(wanted.value[w], k) for k, w in enumerate(zstandard.decompress(words).split()) if w in wanted.value]
                df = np.frombuffer(dfs, "<u4").astype(np.int64)[[k for _, k in hits]]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in hits], pa.int64()), pa.array(df)], names=["term", "df"])

    found = index.select("terms", "dfs").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {terms[r["term"]]: floor(1000 * log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in found.collect()}  # no more rows than terms


def _best(index: DataFrame, items: list[dict[bytes, int]], k: int) -> DataFrame:
    """item (number in ``items``, which give the weights of their terms), doc_id, score: at least the k best of each."""
    asked = index.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple]] = [[] for _ in asked.value]
        any_term = {t for x in asked.value for t in x}
        for batch in batches:
            for shard in batch.to_pylist():
                treap, ids = _unpacked(shard["nodes"], shard["sizes"]), shard["ids"]
                place = {w: r for r, w in enumerate(zstandard.decompress(shard["terms"]).split()) if w in any_term}
                for best, terms in zip(kept, asked.value, strict=True):
                    here = [(place[t], w) for t, w in terms.items() if w and t in place]
                    if not here:
                        continue

                    def offer(cols: np.ndarray, scores: np.ndarray, best=best, ids=ids) -> None:
                        for c, score in zip(cols.tolist(), scores.tolist(), strict=True):
                            entry = (score, ids[c] is not None, -(ids[c] or 0))
                            if len(best) < k:
                                heappush(best, entry)
                            elif entry > best[0]:
                                heapreplace(best, entry)

                    search(treap, np.array([r for r, _ in here]), np.array([w for _, w in here]), offer, lambda best=best: best[0][0] if len(best) == k else 1)
        rows = [(n, -i if known else None, score) for n, best in enumerate(kept) for score, known, i in best]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3, names=["item", "doc_id", "score"])

    return index.select("ids", "terms", "nodes", "sizes").mapInArrow(run, "item long, doc_id long, score long")


def rank(index: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", k: int = 20, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k highest-scoring documents of each row of ``items``, all with a score above 0 if fewer.

    Equal scores ascend by doc_id, null last. Items without a term that a document holds have no rows.
    Rows of equal item_id are items of their own. Items are read in rounds of ``round_bytes`` of
    text, one at least, each of which goes over the whole index.
    """
    spark = index.sparkSession
    given = items.select(F.col(f"`{item_id}`").alias("item_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    given = running_before(given.withColumn("size", F.octet_length("text").cast("long")), ["item_id", "text"], "size", "before")
    given, _ = stash(given.select("item_id", "text", F.expr(f"before div {round_bytes}").alias("round")), "search-items")
    head, rounds = index.select("n_docs").head(), [r["round"] for r in given.select("round").distinct().orderBy("round").collect()]
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for number in rounds if head else []:
        rows = [(r["item_id"], Counter(r["text"].encode().translate(_CLEAN).split())) for r in given.where(F.col("round") == number).collect()]  # round_bytes and one text at most
        weights = _weights(index, sorted({t for _, terms in rows for t in terms}), head["n_docs"])
        found = _best(index, [{t: c * weights[t] for t, c in terms.items() if t in weights} for _, terms in rows], k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(rows)], "item long, item_id long")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = found.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "item")
        out = out.unionByName(best.select("item_id", "rank", "doc_id", "score"))
    return out
