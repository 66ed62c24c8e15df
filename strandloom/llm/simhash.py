"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints that differ in at most ``radius`` of 64 bits are linked. The bits are divided into m
partitions and each partition i gets a threshold t_i >= -1 so that the thresholds add up to
radius - m + 1: if two fingerprints differed by more than t_i in every partition they would differ
by more than the radius, so every link shows in some partition. Bits that go together share a
partition, which leaves the partitions nearly independent; the thresholds are the cheapest by
dynamic programming over candidate counts estimated from a bounded sample of fingerprints. A
partition of threshold t is probed with the block values within t bits of the own one that are not
below it, so that each pair meets once. What meets in a bucket is verified on all 64 bits.

A bucket yields a spanning forest of its links, never its pairs; a bucket with more than
``max_bucket`` fingerprints is dealt out as chunks of owners against chunks of probers.

64 bits tell similarities of 0.8 and more of sets of shingles apart only roughly. For these a text has
256 bits (``wide``), four such prints; the first ``words64`` of them are searched, each by itself, and
what meets in a bucket is verified on all 256, from which the similarity is estimated, before it
enters the bucket's forest. ``one_of_each`` holds the groups so found to the similarity of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations
from math import acos, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import Step, raw_texts, with_arrow
from strandloom.llm.ngram_join import components_within
from strandloom.operators.graph import connected_components
from strandloom.session import stash

BITS, RADIUS, SHINGLE = 64, 4, 4
#: Fingerprints from which the partitions and thresholds are chosen; they decide the cost, never the result.
SAMPLE = 4096
MAX_BUCKET = 4096
#: Partitions and thresholds are chosen for so many fingerprints at least, so that smaller tables take the same plan as large ones.
PLAN_FOR = 4_000_000
#: Longs of a wide print. For shingle sets of similarity J its bits differ with chance acos(2 J / (1 + J)) / pi.
WIDE = 4
#: What prints are below the similarity asked for and still find a candidate.
SLACK = 0.1
#: The list of full buckets is broadcast only up to so many rows (three numbers each); a longer one is merge-joined.
BROADCAST_ROWS = 200_000
_SLICE = 1 << 15


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Further hashes made from the first: one round of a 64-bit mixer, started apart for each k."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return h ^ h >> np.uint64(31)


def prints_of(raw: bytes, shingle: int = SHINGLE, words64: int = 1) -> list[int]:
    """The 64 bits of a text, bit b being 1 if set in over half of the shingles' hashes, 0 without words; then more such from mixed hashes."""
    words = raw.lower().split()
    if not words:
        return [0] * words64
    buf, n = b" ".join(words), max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate([[0], np.cumsum(size)])
    last = start[min(shingle, len(words)) :] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(buf[a:b], 42) for a, b in zip(start[:n].tolist(), last.tolist(), strict=False)), np.uint64, n)
    out = []
    for k in range(words64):
        ones = np.zeros(BITS, np.int64)
        for at in range(0, n, _SLICE):
            part = hashes[at : at + _SLICE]
            part = _mixed(part, k) if k else part
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]))
    return out


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    return prints_of(raw, shingle)[0]


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE, wide: bool = False) -> DataFrame:
    """``docs`` with ``fp`` (long): A-Z count as a-z, words are free of ASCII white space, shingles have ``shingle`` words, repeats count.

    ``wide`` adds a column of that name: ``WIDE`` longs, the fingerprint first.
    """

    def fn(texts: pa.Array) -> list[pa.Array]:
        prints = np.array([prints_of(t, shingle, WIDE if wide else 1) for t in raw_texts(texts)], np.uint64).reshape(len(texts), -1).view(np.int64)
        out = [pa.array(prints[:, 0])]
        if wide:
            out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, prints.size + 1, WIDE, dtype=np.int32)), pa.array(prints.ravel())))
        return out

    fields = (T.StructField("fp", T.LongType()), *([T.StructField("wide", T.ArrayType(T.LongType()))] if wide else []))
    return with_arrow(docs, Step((text,), fields, fn), keep=None if keep is None else [*keep, *(f.name for f in fields)])


def hex_digits(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


@dataclass(frozen=True)
class Plan:
    """``parts[i]`` lists the bits of partition i, ``limits[i]`` its threshold; -1: not probed."""

    parts: tuple[tuple[int, ...], ...]
    limits: tuple[int, ...]


def _block(fp: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= (fp >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    return out


def _flips(width: int, limit: int) -> np.ndarray:
    """Masks of at most ``limit`` set bits, 0 first."""
    return np.array([sum(1 << b for b in c) for k in range(limit + 1) for c in combinations(range(width), k)], np.uint64)


def _grouped(sample: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """m partitions of nearly equal width; each takes the bits that go most with those it has."""
    ones = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    ones -= ones.mean(0)
    cov = ones.T @ ones
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    tie = np.abs(cov / np.outer(scale, scale))
    left, parts = set(range(BITS)), []
    for i in range(m):
        width = (BITS - sum(map(len, parts))) // (m - i)
        part = [max(sorted(left), key=lambda b: sum(tie[b, c] for c in left))]
        left -= set(part)
        while len(part) < width:
            best = max(sorted(left), key=lambda b: sum(tie[b, c] for c in part))
            part.append(best)
            left.remove(best)
        parts.append(tuple(sorted(part)))
    return parts


def _meeting(block: np.ndarray, width: int, limit: int) -> float:
    """Estimated chance that two fingerprints' blocks are within ``limit`` bits of each other."""
    values, counts = np.unique(block, return_counts=True)
    n = len(block)
    pairs = 0.0
    for flip in _flips(width, limit):
        at = np.searchsorted(values, other := values ^ flip).clip(max=len(values) - 1)
        hit = values[at] == other
        pairs += float((counts[hit] * counts[at[hit]]).sum()) - (n if flip == 0 else 0)
    chance = len(_flips(width, limit)) / 2.0**width
    return (pairs + 1e4 * chance) / (n * max(1, n - 1) + 1e4)


def choose_plan(sample: np.ndarray, n: int, radius: int = RADIUS, probe_cost: float = 500.0) -> Plan:
    """The cheapest partitions and thresholds for ``n`` fingerprints like the sample's.

    A probe costs as much as ``probe_cost`` comparisons.
    """
    best: tuple[float, Plan] | None = None
    sample = sample if len(sample) > 1 else np.array([0, (1 << BITS) - 1], np.uint64)
    for m in range(2, min(radius, 10) + 2):
        parts = _grouped(sample, m)
        # state: sum of limits so far -> (cost, limits)
        states: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for part in parts:
            block, grown = _block(sample, part), {}
            for limit in range(-1, 4):
                cost = 0.0 if limit < 0 else n * n / 2 * _meeting(block, len(part), limit) + probe_cost * n * (len(_flips(len(part), limit)) + 1) / 2
                for total, (before, limits) in states.items():
                    new = (before + cost, (*limits, limit))
                    if total + limit not in grown or new < grown[total + limit]:
                        grown[total + limit] = new
            states = grown
        if (radius - m + 1) in states and (best is None or states[radius - m + 1][0] < best[0]):
            cost, limits = states[radius - m + 1]
            best = (cost, Plan(tuple(parts), limits))
    return best[1]


def links_within(own: np.ndarray, probing: np.ndarray, radius: int, word: int = 0, limit: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``own`` and between ``own`` and ``probing``, as pairs of positions in the two laid end to end.

    All fingerprints are distinct; each pair given is a link itself. Of wide prints (a row each) the
    one numbered ``word`` is held to the radius, and all their bits together to ``limit``.
    """
    every, n = np.concatenate([own, probing]), len(own)
    every = every.reshape(len(every), -1)

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        bits = np.bitwise_count(x ^ y)
        out = bits[..., word] <= radius
        return out if limit is None else out & (bits.sum(-1, dtype=np.int32) <= limit)

    if n * every.size <= 1 << 18 and int(near(every[:n, None], every[None]).sum()) == n:
        return []
    out: list[tuple[int, int]] = []
    owners, others = np.arange(n), np.arange(n, len(every))
    while len(owners):
        front, owners = [int(owners[0])], owners[1:]
        while front:
            at = front.pop()
            hit = near(every[owners], every[at])
            new = owners[hit].tolist()
            owners = owners[~hit]
            if at < n and len(others):
                hit = near(every[others], every[at])
                new += others[hit].tolist()
                others = others[~hit]
            out += [(x, at) for x in new]
            front += new
    return out


#: A bucket's key holds the print's number, its partition and the block; no partition is wider than 32 bits.
_PART_AT, _WORD_AT = 40, 48


def _signatures(plan: Plan, words64: int | None = None) -> Step:
    """``sig`` (array of struct(key, own)) of a fingerprint: its own block values and those that it probes.

    With ``words64`` the column ``wide`` is read instead of ``fp``, and so many of its prints have signatures.
    """
    flips = [_flips(len(p), t) if t >= 0 else None for p, t in zip(plan.parts, plan.limits, strict=True)]
    kind = T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("own", T.BooleanType())]))

    def fn(given: pa.Array) -> list[pa.Array]:
        prints = (given.to_numpy(zero_copy_only=False) if words64 is None else given.flatten().to_numpy()).view(np.uint64).reshape(len(given), -1)
        key, own, meant = [], [], []
        for word in range(words64 or 1):
            for i, (bits, masks) in enumerate(zip(plan.parts, flips, strict=True)):
                if masks is not None:
                    base = _block(prints[:, word], bits)[:, None]
                    block = base ^ masks[None, :]
                    key.append(block | np.uint64(word << _WORD_AT | i << _PART_AT))
                    own.append(np.broadcast_to(masks == 0, block.shape))
                    meant.append(block >= base)
        keys, owns, use = (np.concatenate(x, 1) for x in (key, own, meant))
        offsets = pa.array(np.concatenate([[0], np.cumsum(use.sum(1))]).astype(np.int32))
        values = pa.StructArray.from_arrays([pa.array(keys[use].view(np.int64)), pa.array(owns[use])], ["key", "own"])
        return [pa.ListArray.from_arrays(offsets, values)]

    return Step(("fp" if words64 is None else "wide",), (T.StructField("sig", kind),), fn)


def _verify(radius: int, limit: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, lane, prints) come sorted by bucket, which may go over the end of a batch."""
        src: list = []
        dst: list = []

        def found(word: int, prints: np.ndarray, own: np.ndarray) -> None:
            mine = prints[own]
            mine = mine[np.unique(mine[:, 0], return_index=True)[1]]
            rest = prints[~own]
            if len(rest):
                rest = rest[~np.isin(rest[:, 0], mine[:, 0])]
            if len(mine) + len(rest) < 2:
                return
            every = np.concatenate([mine, rest])[:, 0]
            for member, root in links_within(mine.view(np.uint64), rest.view(np.uint64), radius, word, limit):
                src.append(every[member])
                dst.append(every[root])

        now, held, useful = None, [], False

        def close() -> None:
            if held:
                found(now[0] >> _WORD_AT, np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))

        for batch in batches:
            if not len(batch):
                continue
            key, lane, *cols = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            own, prints, lane = (lane & 1) == 0, np.stack(cols, 1), lane >> 1
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (lane[1:] != lane[:-1])) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                bucket = (int(key[a]), int(lane[a]))
                if bucket != now:
                    close()
                    now, held, useful = bucket, [], bool(own[a])
                if useful:  # owners come first; probers of a block without any meet nobody
                    held.append((prints[a:b], own[a:b]))
            if len(src) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
                src.clear()
                dst.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def similar_links(
    fps: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET, plan: Plan | None = None, words64: int = 1, limit: int | None = None
) -> DataFrame:
    """``src, dst`` links among distinct fingerprints (column ``fp``) that have the components of all links within ``radius``.

    With ``limit`` a link is a pair of which one of the first ``words64`` wide prints (column
    ``wide``, of which ``fp`` is the first) differs in at most ``radius`` bits, and all of them
    together in at most ``limit``. All prints are searched by the plan made for the first, whose
    sample stands for the others: a plan decides the cost, never the result.
    """
    if plan is None:
        n = fps.count()
        drawn = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
        plan = choose_plan(np.array([r["fp"] for r in drawn], np.int64).view(np.uint64), max(n, PLAN_FOR), radius)
    if limit is None:
        rows, prints = with_arrow(fps.select("fp"), _signatures(plan)), [F.col("fp").alias("p0")]
    else:
        rows, prints = with_arrow(fps.select("fp", "wide"), _signatures(plan, words64)), [F.col("wide")[k].alias(f"p{k}") for k in range(WIDE)]
    rows, _ = stash(rows.select(*prints, F.inline("sig")), "signatures")
    names = [c for c in rows.columns if c not in ("key", "own")]
    full = rows.groupBy("key").agg(F.sum(F.col("own").cast("long")).alias("a"), F.count(F.lit(1)).alias("b")).where((F.col("b") > max_bucket) & (F.col("a") > 0))
    full = full.select("key", F.ceil(F.col("a") / max_bucket).cast("int").alias("a"), F.ceil(F.col("b") / max_bucket).cast("int").alias("b"))
    full, _ = stash(full, "full")
    full = F.broadcast(full) if full.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else full.hint("merge")
    dealt = rows.join(full, "key", "left").withColumn("a", F.coalesce("a", F.lit(1))).withColumn("b", F.coalesce("b", F.lit(1)))
    h = F.xxhash64("p0", F.lit("chunk"))

    def spread(role: DataFrame, fixed: str, other: str, n: str, m: str, probes: int) -> DataFrame:
        """A chunk of one side meets all chunks of the other; ``lane`` holds both chunks' numbers and, last, the role."""
        rows = role.withColumn(fixed, F.pmod(h, F.col(n)).cast("long"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(m).cast("long") - 1)))
        return rows.select("key", F.expr(f"shiftleft(c, 32) | shiftleft(d, 1) | {probes}L").alias("lane"), *names)

    # where a bucket is cut, its owners also stand among the probers
    owners = spread(dealt.where("own"), "c", "d", "a", "b", 0)
    probers = spread(dealt.where("not own or b > 1"), "d", "c", "b", "a", 1)
    met = owners.unionByName(probers).repartition("key", F.shiftright("lane", 1)).sortWithinPartitions("key", "lane")
    return met.mapInArrow(_verify(radius, limit), "src long, dst long")


def bits_apart(similarity: float) -> int:
    """The bits of a wide print in which texts of that similarity of the shingle sets differ, rounded down."""
    return int(WIDE * BITS * acos(2 * similarity / (1 + similarity)) / pi)


def classes(
    prints: DataFrame, doc_id: str = "doc_id", radius: int = RADIUS, max_bucket: int = MAX_BUCKET, similarity: float | None = None, words64: int = 1
) -> DataFrame:
    """``fp, component_id``: for each distinct fingerprint of ``prints`` the smallest doc_id that links reach.

    With ``similarity`` only links count that the wide prints bear out; of texts that share a
    fingerprint one wide print speaks for all.
    """
    facts = [F.min(doc_id).alias("least"), *([F.min("wide").alias("wide")] if similarity is not None else [])]
    own, _ = stash(prints.groupBy("fp").agg(*facts), "prints")
    comps = connected_components(similar_links(own, radius, max_bucket, None, words64, None if similarity is None else bits_apart(similarity)))
    rooted = own.select("fp", "least").join(comps.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    rooted, _ = stash(rooted, "rooted")
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "component").select("fp", "component_id")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    radius: int = RADIUS,
    max_bucket: int = MAX_BUCKET,
    shingle: int = SHINGLE,
    similarity: float | None = None,
    words64: int = 1,
) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row for each row of ``docs``.

    Null and wordless texts have fingerprint zero and are linked like any other. Equal texts share a
    fingerprint; texts of any length are read whole. Rows without a doc_id take part; a component of
    such rows alone has a null component_id. Repeated ids are kept as they come, an empty table gives
    no rows, and other columns of ``docs`` are left out. ``similarity`` asks for links of at least that
    estimated similarity of the shingle sets, among those of which one of the first ``words64`` wide
    prints differs in at most ``radius`` bits.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    prints, _ = stash(fingerprints(rows, keep=["doc_id"], shingle=shingle, wide=similarity is not None), "fingerprints")
    return prints.join(classes(prints, "doc_id", radius, max_bucket, similarity, words64), "fp").select("doc_id", hex_digits().alias("fingerprint"), "component_id")


def one_of_each(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    radius: int = RADIUS,
    max_bucket: int = MAX_BUCKET,
    shingle: int = SHINGLE,
    similarity: float | None = None,
    words64: int = 1,
) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one of the smallest doc_id.

    With ``similarity`` the components are exact: prints that tell of ``similarity`` less ``SLACK`` find
    candidates, and those of a group are then linked by the similarity of their shingle sets itself.

    Rows without a doc_id cannot be named and stay only if no row of their component has an id, one
    for each text. Of rows that repeat the smallest id one stays. All columns pass, whatever their names.
    """
    found, _ = stash(near_duplicates(docs, text, doc_id, radius, max_bucket, shingle, similarity and similarity - SLACK, words64), "classes")
    if similarity is not None:
        part = Fraction(similarity).limit_denominator(100)
        groups = found.select("doc_id", F.col("component_id").alias("block"))
        exact = components_within(docs, groups, text, doc_id, shingle, part.numerator, part.denominator)
        exact = found.join(exact.withColumnRenamed("component_id", "_exact"), "doc_id", "left").select("doc_id", "fingerprint", F.coalesce("_exact", "component_id").alias("component_id"))
        found, _ = stash(exact, "classes")
    named = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    named, _ = stash(named.select(F.col("doc_id").alias("stay"), "n"), "stay")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("words"))
    # the list of those that stay grows with the table: never broadcast, at any size
    out = packed.join(named.hint("merge"), F.col("id") == F.col("stay"), "inner")
    once = out.where("n = 1").select("given")
    if named.where("n > 1").limit(1).count():
        once = once.unionByName(out.where("n > 1").dropDuplicates(["id"]).select("given"))
    if found.where("component_id is null").limit(1).count():
        lone = found.where("component_id is null").select("fingerprint").distinct()
        orphans = packed.where("id is null").dropDuplicates(["words"])
        prints = fingerprints(orphans.select("given", "words"), "words", keep=["given"], shingle=shingle).withColumn("print", hex_digits())
        once = once.unionByName(prints.join(lone, F.col("print") == F.col("fingerprint"), "left_semi").select("given"))
    return once.select("given.*")
