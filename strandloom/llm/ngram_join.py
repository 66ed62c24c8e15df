"""Exact Jaccard self-join on word n-grams by T-occurrence search.

A document is the set of its distinct shingles, as 64-bit hashes. Two documents of sizes a and b
whose sets have similarity s or more share at least s / (1 + s) * (a + b) shingles, and so at least
T = s * a, which is what the inverted lists of a document's shingles are searched for.

* Documents of equal sets become one class first.
* Shingles are ordered by (often seen, hash). Two sets that link share t of the first n - T + t, since
  each may lack only n - T. A class stays only if a tenth of T of its first n - T + n / 10 are in other
  classes whose sizes allow a link.
* A class meets only those of its *block*. Those that stay and share one of their first n - T + 1
  shingles are joined by edges from the least to the others; a block is a component of these edges. Which shingles are often seen is learnt from one document in
  ``SAMPLE`` and told in a bitmap of fixed size: wrong answers change the order, the same way for all
  documents, never the result. Passages that many documents share thus join no blocks.
* A block is cut into chunks of bounded size; each chunk is one group of a shuffle, and each pair of
  chunks is another, in which both are indexed and searched by the other's members.
* A search is DivideSkip: the L longest of the lists are set apart, the others are merged by a heap
  that skips what cannot occur T - L times, and what does is counted to the end by binary search in
  the long ones. What is found leaves the index, since it is connected, and searches next, so that
  a group gives a spanning forest of its links and near copies are not paired off.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import Step, with_arrow
from strandloom.operators.graph import connected_components
from strandloom.session import drop_path, stash

SHINGLE = 5
#: A similarity of at least NUM / DEN.
NUM, DEN = 4, 5
#: One document in so many tells which shingles are often seen: those that it shows in at least OFTEN documents.
SAMPLE, OFTEN = 16, 4
#: Bits of the bitmaps: 1 MB each, however many hashes they stand for.
MAP_BITS = 1 << 23
#: Shingles of a chunk of a block, about; a single document may have more.
CHUNK = 500_000
#: A class must share one in so many of T of its first shingles to stay.
EXTRA = 10
#: Weight of the logarithm of the longest list in the choice of L.
MU = 0.0085
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a batch, and where each text's words begin (one more than texts)."""
    if texts.offset:  # Arrow lower-cases slices of an array wrongly
        texts = texts.take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = lists.flatten()
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    hashes = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[filled]
    return hashes[filled], np.searchsorted(owner, np.arange(len(texts) + 1))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes: A-Z count as a-z, words are free of ASCII white space.

    A text of fewer words has all of them as its one shingle; one without words has none.
    """
    words, starts = _words(texts)
    out = []
    with np.errstate(over="ignore"):
        made = np.zeros(max(0, len(words) - shingle + 1), np.uint64)
        for k in range(shingle):
            factor = np.uint64(_ODD[k % 5] + 2 * (k // 5) & (1 << 64) - 1)
            made += _finished(words[k : k + len(made)] * factor + np.uint64(k))
        made = _finished(made)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a >= shingle:
                out.append(np.unique(made[a : b - shingle + 1]))
            elif b > a:  # the number of words goes into the hash, so that no other shingle is meant
                parts = words[a:b] * np.array(_ODD * (shingle // 5 + 1), np.uint64)[: b - a] + np.arange(b - a).astype(np.uint64)
                out.append(_finished(np.array([_finished(parts).sum(dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D * (b - a) & (1 << 64) - 1)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)))


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """A bitmap of ``MAP_BITS`` bits of the first column, 64-bit hashes: whoever is in it is found, others rarely."""
    slot = F.pmod(F.shiftrightunsigned(F.col(hashes.columns[0]), 20), F.lit(MAP_BITS))
    words = hashes.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(s & 63))")).alias("bits"))
    out = np.zeros(MAP_BITS // 64, np.int64)
    for r in words.collect():  # at most MAP_BITS / 64 rows
        out[r["at"]] = r["bits"]
    return out.view(np.uint64)


def often_seen(docs: DataFrame, text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The bitmap of shingles that are often seen: one document in ``SAMPLE``, by its text's hash, is counted."""
    drawn = docs.where(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0).select(F.col(text).alias("text"))
    sets = with_arrow(drawn, Step(("text",), (T.StructField("tokens", T.ArrayType(T.LongType())),), lambda t: [_lists(shingle_sets(t, shingle))]), keep=["tokens"])
    return bitmap_of(sets.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= OFTEN))


def _within(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    s = (h >> np.uint64(20)) % np.uint64(MAP_BITS)
    return (bitmap[s >> np.uint64(6)] >> (s & np.uint64(63)) & np.uint64(1)).astype(bool)


def needed(n: int, num: int = NUM, den: int = DEN) -> int:
    """T: the least number of shingles that a set of n shares with one that it links with."""
    return -(-num * n // den)


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in sets), np.int64).reshape(-1, 2)


def _signatures(bitmap, shingle: int, num: int, den: int) -> Step:
    """``n, d1, d2, first`` of a text: its set's size, digest and first n - T + max(1, n / EXTRA) shingles, often seen ones last."""

    def fn(texts: pa.Array) -> list[pa.Array]:
        often, firsts = bitmap.value, []
        sets = shingle_sets(texts, shingle)
        for h in sets:
            take = len(h) - needed(len(h), num, den) + max(1, len(h) // EXTRA) if len(h) else 0
            seen = _within(often, h)
            rare = h[~seen]
            firsts.append(rare[:take] if len(rare) >= take else np.concatenate([rare, h[seen][: take - len(rare)]]))
        two = _digests(sets)
        return [pa.array([len(h) for h in sets], pa.int64()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), _lists(firsts)]

    fields = [T.StructField(c, T.LongType()) for c in ("n", "d1", "d2")] + [T.StructField("first", T.ArrayType(T.LongType()))]
    return Step(("text",), tuple(fields), fn)


def _sets_of(bitmap, shingle: int, key: str = "doc_id", mixed: bool = True) -> Step:
    """``d1, d2, tokens`` of the rows that the bitmap may hold by ``key``, with the digest if ``mixed``; ``tokens`` is null for others."""

    def fn(texts: pa.Array, ids: pa.Array) -> list[pa.Array]:
        sets = shingle_sets(texts, shingle)
        two = _digests(sets)
        keys = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        hit = _within(bitmap.value, (two[:, 0] ^ keys if mixed else keys).view(np.uint64))
        kept = _lists([h if x else h[:0] for h, x in zip(sets, hit.tolist(), strict=True)])
        tokens = pc.if_else(pa.array(hit), kept, pa.scalar(None, kept.type))
        return [pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), tokens]

    return Step(("text", key), (T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))), fn)


def _edges(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (token, n, node) come sorted; edges from the first node of a run to the others, a run being cut where sizes are too far apart."""
        last = (None, 0, 0)  # token, size and root of the run that may go on
        for batch in batches:
            if not len(batch):
                continue
            token, n, node = (c.to_numpy() for c in batch.columns)
            before_t, before_n = np.concatenate([[token[0]], token[:-1]]), np.concatenate([[n[0]], n[:-1]])
            new = (token != before_t) | (den * before_n < num * n)
            goes_on = last[0] is not None and token[0] == last[0] and den * last[1] >= num * n[0]
            new[0] = not goes_on
            at = np.maximum.accumulate(np.where(new, np.arange(len(n)), -1))
            root = np.where(at >= 0, node[np.maximum(at, 0)], last[2])
            last = (token[-1], n[-1], root[-1])
            hit = root != node
            pairs = np.unique(np.stack([root[hit], node[hit]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["src", "dst"])

    return run


class Index:
    """Inverted lists over the shingles of some sets; sets can leave."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.alive, self.n_alive = sets, np.ones(len(sets), bool), len(sets)
        tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")  # a list's members ascend
        self._take(tokens[order], owner[order])

    def _take(self, tokens: np.ndarray, owner: np.ndarray) -> None:
        self.tokens, self.owner, self.built = tokens, owner, self.n_alive
        self.keys, self.starts = np.unique(tokens, return_index=True)
        self.starts = np.append(self.starts, len(tokens))

    def leave(self, members: list[int]) -> None:
        self.alive[members] = False
        self.n_alive -= len(members)
        if 2 * self.n_alive < self.built:  # lists without those that left, so that each is passed over a few times at most
            stay = self.alive[self.owner]
            self._take(self.tokens[stay], self.owner[stay])

    def search(self, probe: np.ndarray, num: int = NUM, den: int = DEN) -> list[int]:
        """The members still there that link with ``probe``."""
        t = needed(len(probe), num, den)
        at = np.searchsorted(self.keys, probe).clip(max=max(0, len(self.keys) - 1))
        at = at[self.keys[at] == probe] if len(self.keys) else at[:0]
        if len(at) < t:
            return []
        lists = sorted((self.owner[a:b].tolist() for a, b in zip(self.starts[at].tolist(), self.starts[at + 1].tolist(), strict=True)), key=len)
        apart = min(t - 1, int(t / (MU * log(max(2, len(lists[-1]))) + 1)))
        short, long = lists[: len(lists) - apart], lists[len(lists) - apart :]
        out = []
        for member, count in _merge_skip(short, t - apart):
            if not self.alive[member]:
                continue
            # overlap * (num + den) >= num * (a + b) says that the similarity is num / den or more
            size = len(self.sets[member])
            least = -(-num * (len(probe) + size) // (num + den))
            for k, x in enumerate(long):
                if count + len(long) - k < least:
                    break
                i = bisect_left(x, member)
                count += i < len(x) and x[i] == member
            if count >= least:
                out.append(member)
        return out


def _merge_skip(lists: list[list[int]], t: int) -> Iterator[tuple[int, int]]:
    """Members of at least t of the sorted lists, and of how many; what cannot reach t is jumped over."""
    heap = [(x[0], k) for k, x in enumerate(lists)]
    place = [0] * len(lists)
    heapify(heap)
    while len(heap) >= t:
        member, popped = heap[0][0], []
        while heap and heap[0][0] == member:
            popped.append(heappop(heap)[1])
        if len(popped) >= t:
            yield member, len(popped)
            target = member + 1
        else:
            while heap and len(popped) < t - 1:
                popped.append(heappop(heap)[1])
            if not heap:
                return
            target = heap[0][0]  # fewer than t lists have anything below it
        for k in popped:
            x = lists[k]
            place[k] = bisect_left(x, target, place[k])
            if place[k] < len(x):
                heappush(heap, (x[place[k]], k))


def forest(own: list[np.ndarray], other: list[np.ndarray] | None = None, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``own``, or of those between ``own`` and ``other``, as positions in the two laid end to end."""
    n, every, out = len(own), [*own, *(other or [])], []
    sides = [Index(own)] if other is None else [Index(other), Index(own)]  # where members of own search, and of other
    mine = sides[-1]
    for seed in range(n):
        if not mine.alive[seed]:
            continue
        mine.leave([seed])
        front = [seed]
        while front:
            at = front.pop()
            side = sides[0] if at < n else sides[1]
            if side.n_alive:
                first = 0 if side is mine else n
                found = side.search(every[at], num, den)
                side.leave(found)
                out += [(at, first + x) for x in found]
                front += [first + x for x in found]
    return out


def _joined(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (block, low, high, second, node, tokens) come sorted by group, the three first; a group's first chunk comes first."""
        now, held = None, []

        def close() -> pa.RecordBatch:
            one, two = ([(x, h) for second, x, h in held if second == k] for k in (False, True))
            links = forest([h for _, h in one], [h for _, h in two] if now[1] != now[2] else None, num, den)
            nodes = [x for x, _ in one + two]
            return pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in links], pa.int64()), pa.array([nodes[b] for _, b in links], pa.int64())], names=["src", "dst"])

        for batch in batches:
            lists = batch.column(5)
            flat, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy().tolist()
            for k, (*group, second, node) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)):
                if group != now:
                    if len(held) > 1:
                        yield close()
                    now, held = group, []
                if not held or held[-1][:2] != (second, node):  # rows that repeat a whole document come twice
                    held.append((second, node, flat[ends[k] : ends[k + 1]].copy()))
        if len(held) > 1:
            yield close()

    return run


def links_in_blocks(found: DataFrame, sizes: DataFrame, num: int = NUM, den: int = DEN, chunk: int = CHUNK) -> DataFrame:
    """``src, dst``: a spanning forest of the links between the sets of each block, as a written table.

    ``found``: ``block, node, tokens``, the tokens being a set's sorted hashes; rows of one node are the
    same set. ``sizes``: ``block, n``, the sets' sizes. A block is cut into chunks of about ``chunk``
    hashes, and pairs of chunks meet.
    """
    cuts = sizes.groupBy("block").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("cuts"))
    dealt = found.join(cuts, "block").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    dealt = dealt.select("block", "mine", "node", "tokens", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("with"))
    dealt = dealt.select("block", F.least("mine", "with").alias("low"), F.greatest("mine", "with").alias("high"), (F.col("mine") > F.col("with")).alias("second"), "node", "tokens")
    groups = dealt.repartition("block", "low", "high").sortWithinPartitions("block", "low", "high", "second", "node")
    return stash(groups.mapInArrow(_joined(num, den), "src long, dst long"), "shingle-links")[0]


def similar_classes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, num: int = NUM, den: int = DEN, chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links), written tables.

    ``members``: doc_id, n, node for each row of ``docs``, node being the class of its set, null for an
    empty one; ``classes``: node, n, least (smallest doc_id), copies; ``links``: src, dst, a spanning
    forest of the links between classes, each of them a link itself.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    often = spark.sparkContext.broadcast(often_seen(rows, "text", shingle))
    signed, signed_path = stash(with_arrow(rows, _signatures(often, shingle, num, den), keep=["doc_id", "n", "d1", "d2", "first"]), "shingle-signatures")
    sets = signed.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("first").alias("first"))
    sets, _ = stash(sets.withColumn("node", F.monotonically_increasing_id()), "shingle-classes")
    classes = sets.drop("first")
    members, _ = stash(signed.drop("first").join(classes.select("d1", "d2", "node"), ["d1", "d2"], "left").select("doc_id", "n", "node"), "shingle-members")
    drop_path(spark, signed_path)

    least = F.expr(f"(n * {num} + {den - 1}) div {den}")
    posted = sets.select(F.explode("first").alias("token"), "n", "node")
    by_size = Window.partitionBy("token").orderBy("n", "node")
    fits = (den * F.lag("n").over(by_size) >= num * F.col("n")) | (den * F.col("n") >= num * F.lead("n").over(by_size))
    shared = posted.withColumn("fits", fits).where("fits").groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    staying, _ = stash(sets.join(shared, "node").where(F.col("shared") >= F.greatest(F.lit(1), F.floor(least / EXTRA))), "shingle-staying")
    heads = staying.select(F.explode(F.slice("first", F.lit(1), (F.col("n") - least + 1).cast("int"))).alias("token"), "n", "node")
    met = heads.repartition("token").sortWithinPartitions("token", "n", "node")
    blocks = connected_components(met.mapInArrow(_edges(num, den), "src long, dst long"))
    inside, _ = stash(classes.join(blocks.select("node", F.col("component").alias("block")), "node"), "shingle-blocks")
    # the sets of classes in blocks are made again, each from one text
    chosen = spark.sparkContext.broadcast(bitmap_of(inside.select(F.col("d1").bitwiseXOR(F.coalesce("least", F.lit(0))))))
    again = with_arrow(rows, _sets_of(chosen, shingle), keep=["doc_id", "d1", "d2", "tokens"]).where("tokens is not null").withColumnsRenamed({"d1": "e1", "d2": "e2"})
    found = again.join(inside, (F.col("e1") == F.col("d1")) & (F.col("e2") == F.col("d2")) & F.col("doc_id").eqNullSafe(F.col("least")))
    links = links_in_blocks(found.select("block", "node", "tokens"), inside.select("block", "n"), num, den, chunk)
    return members, classes.select("node", "n", "least", "copies"), links


def jaccard_components(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, num: int = NUM, den: int = DEN, chunk: int = CHUNK
) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row for each row of ``docs``.

    Documents link when their shingle sets have a similarity of at least num / den, and
    ``component_id`` is the smallest doc_id that links reach. Null texts and texts without words have
    an empty set and link with nothing: their component_id is their own id. Rows without an id take
    part; a component of such rows alone has a null component_id. Repeated rows and ids are kept as
    they come, texts of any length are read whole, an empty table gives no rows, and other columns
    of ``docs`` are left out.
    """
    members, classes, links = similar_classes(docs, text, doc_id, shingle, num, den, chunk)
    comps = connected_components(links)
    rooted = classes.select("node", "least").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rooted, _ = stash(rooted, "shingle-rooted")
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    rooted = rooted.join(least, "component").select("node", "component_id")
    rows = members.join(rooted, "node", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def components_within(docs: DataFrame, groups: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, num: int = NUM, den: int = DEN, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, component_id``: the exact components of the documents of each group, and their smallest ids.

    ``groups``: ``doc_id, block``, groups of candidates that another search has found; documents of
    different groups are not compared, and those alone in a group have no row. Texts without words
    are equal sets here. An id of several texts gets the smallest of their components.
    """
    spark = docs.sparkSession
    known = groups.where("doc_id is not null").distinct()
    many = known.groupBy("block").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("block")
    inside, _ = stash(known.join(many, "block"), "candidate-groups")
    chosen = spark.sparkContext.broadcast(bitmap_of(inside.select(F.xxhash64("doc_id"))))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null").withColumn("h", F.xxhash64("doc_id"))
    sets = with_arrow(rows, _sets_of(chosen, shingle, "h", mixed=False), keep=["doc_id", "d1", "d2", "tokens"]).where("tokens is not null")
    sets, _ = stash(sets.join(inside, "doc_id").withColumn("n", F.size("tokens").cast("long")), "candidate-sets")
    classes = sets.groupBy("block", "d1", "d2").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    classes, _ = stash(classes, "candidate-classes")
    several = classes.groupBy("block").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("block")
    first = classes.join(several, "block").withColumnRenamed("least", "doc_id")
    found = sets.where("n > 0").join(first, ["block", "d1", "d2", "doc_id"])
    comps = connected_components(links_in_blocks(found.select("block", "node", "tokens"), found.select("block", "n"), num, den, chunk))
    rooted, _ = stash(classes.join(comps, "node", "left").select("block", "d1", "d2", "least", F.coalesce("component", "node").alias("component")), "candidate-roots")
    named = rooted.join(rooted.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("block", "d1", "d2", "component_id")
    return sets.select("doc_id", "block", "d1", "d2").join(named, ["block", "d1", "d2"]).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
