"""Line dedup over levelled sorted runs.

The line keys of a corpus are kept as runs: tables bucketed and sorted by key hash, each key in one
run only, with the documents that hold it and the largest of them. A new batch is counted by itself
and merge-anti-joined with each run, which is not shuffled again: keys that no run has are added
as a run of level 0; for the others the batch adds its count beside them, unless the run has them in
so many documents already that it could change nothing. When a level has ``fanout`` runs they are
merged into one run of the next level, so that n batches leave O(log n) runs and rewrite a key
O(log n) times.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import Step, with_arrow
from strandloom.session import drop_path, new_path, stash

MIN_CHARS, MIN_DOCS = 40, 5
_LONGS = T.ArrayType(T.LongType())


def line_key(line: str) -> bytes:
    raw = line.encode()
    return raw.strip().lower()  # both know ASCII only


def key_hash(key: bytes) -> tuple[int, int]:
    """128 bits as two signed longs."""
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & (1 << 64) - 1
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def _hashes(text: str | None, min_chars: int) -> list[tuple[int, int] | None]:
    """One for each line; none for lines whose key is too short."""
    out = []
    for line in (text or "").split("\n"):
        # cheap test first: a key has no more code points than its line
        key = line_key(line) if len(line) >= min_chars else b""
        out.append(key_hash(key) if len(key) >= min_chars and len(key.decode()) >= min_chars else None)
    return out


def line_keys(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, h1, h2``: each long enough line key of each document, once for a row. Documents without an id hold no key."""

    def fn(texts: pa.Array) -> list[pa.Array]:
        a, b = [], []
        for t in texts.to_pylist():
            found = sorted({h for h in _hashes(t, min_chars) if h})
            a.append([x for x, _ in found])
            b.append([y for _, y in found])
        return [pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64()))]

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    lists = with_arrow(rows, Step(("text",), (T.StructField("a", _LONGS), T.StructField("b", _LONGS)), fn), keep=["doc_id", "a", "b"])
    return lists.select("doc_id", F.inline(F.arrays_zip(F.col("a").alias("h1"), F.col("b").alias("h2"))))


@dataclass
class Runs:
    """The levelled runs of one corpus: ``levels[k]`` names the tables of level k.

    A table has ``h1, h2, n_docs, last_doc`` and ``seen``: false for the keys that it added, true for
    counts of keys that an earlier run has. Batches come with descending ids, so that the run that
    added a key knows its largest document.
    """

    spark: SparkSession
    buckets: int
    fanout: int = 4
    #: From this many documents on a key is settled; 0: keys are never settled.
    settled_at: int = 0
    levels: list[list[tuple[str, str]]] = field(default_factory=list)

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path = new_path(self.spark, f"run-{level}")
        name = "run_" + path.rsplit("-", 1)[1]
        dealt = rows.repartition(self.buckets, "h1", "h2")
        dealt.write.format("parquet").option("path", path).partitionBy("seen").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self.levels[level].append((name, path))

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        drop_path(self.spark, path)

    def runs(self) -> list[DataFrame]:
        """The keys of each run; no key is in two of them."""
        return [self.spark.table(n).where("not seen").drop("seen") for level in self.levels for n, _ in level]

    def repeats(self, names: list[str] | None = None) -> DataFrame | None:
        """Counts of keys beside those of the run that added them, each key once."""
        out = None
        for n in names or [n for level in self.levels for n, _ in level]:
            t = self.spark.table(n).where("seen").drop("seen")
            out = t if out is None else out.unionAll(t)
        return None if out is None else out.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def add(self, keys: DataFrame) -> DataFrame:
        """Add a batch (``doc_id, h1, h2``, each once; ids below those of earlier batches) and return the run of its new keys."""
        own = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        most = F.lit(0).cast("long")
        for k, run in enumerate(self.runs()):
            held = run.select("h1", "h2", F.col("n_docs").alias(f"held{k}"))
            own = own.join(held.hint("merge"), ["h1", "h2"], "left")
            most = F.greatest(most, F.coalesce(f"held{k}", F.lit(0)))
        rows = own.select("h1", "h2", "n_docs", "last_doc", (most > 0).alias("seen"), most.alias("most"))
        if self.settled_at:
            rows = rows.where(F.col("most") < self.settled_at)
        self._write(rows.drop("most"), 0)
        return self.spark.table(self.levels[0][-1][0]).where("not seen").drop("seen")

    def compact(self) -> None:
        """Merge each level that is full into one run of the next."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                full = self.levels[level]
                names = [n for n, _ in full]
                rows = self.repeats(names).withColumn("seen", F.lit(True))
                for n in names:
                    rows = rows.unionByName(self.spark.table(n).where("not seen").drop("seen").withColumn("seen", F.lit(False)))
                self._write(rows, level + 1)
                self.levels[level] = []
                for name, path in full:
                    self._drop(name, path)
            level += 1

    def totals(self, min_docs: int = 1) -> DataFrame:
        """``h1, h2, n_docs, last_doc`` of the keys in ``min_docs`` documents or more; of settled keys ``n_docs`` is at least ``settled_at``."""
        out, more = None, self.repeats()
        if more is None:
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, last_doc long")
        more, _ = stash(more.select("h1", "h2", F.col("n_docs").alias("again")), "repeats")
        for run in self.runs():
            t = run.join(more.hint("merge"), ["h1", "h2"], "left").withColumn("n_docs", F.col("n_docs") + F.coalesce("again", F.lit(0))).drop("again")
            out = t if out is None else out.unionAll(t)
        return out.where(F.col("n_docs") >= min_docs)

    def close(self) -> None:
        """Drop the tables of all runs."""
        for level in self.levels:
            for name, path in level:
                self._drop(name, path)
        self.levels = []


def build_runs(keys: DataFrame, batches: int = 5, fanout: int = 2, settled_at: int = 0, bucket_rows: int = 2_000_000) -> Runs:
    """Add ``keys`` (a written table, each row once) batch by batch, the largest ids first.

    The batches are ranges of ids with about as many rows each; full levels are compacted between
    batches. Going down, the first batch that has a key knows its largest doc_id, so that frequent keys
    are settled early. Buckets hold about ``bucket_rows`` keys. Where the ranges are cut decides the
    cost, never the result.
    """
    spark = keys.sparkSession
    shares = [k / batches for k in range(1, batches)]
    facts = keys.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc_id", shares or [0.5]).alias("cuts")).first()
    cuts = sorted(set(facts["cuts"] or [])) if shares else []
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-facts["n"] // bucket_rows))
    runs = Runs(spark, buckets, fanout, settled_at)
    for low, high in reversed(list(zip([None, *cuts], [*cuts, None], strict=True))):
        part = keys
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        runs.compact()
        runs.add(part.select("doc_id", "h1", "h2"))
    return runs


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 5, fanout: int = 2) -> DataFrame:
    """``docs`` with ``kept`` (the text without its repeated lines), ``n_lines`` and ``n_dropped``.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at
    least ``min_chars`` code points that at least ``min_docs`` documents hold lose their lines in all
    documents but the one of the largest id. The others stay in their order. Null and empty texts
    are one empty line. Rows that repeat a doc_id count as one document and are treated alike; rows
    without a doc_id are counted nowhere and keep their lines. Texts of any length are read whole; an
    empty table gives no rows. Columns called like the results give way to them.
    """
    keys, _ = stash(line_keys(docs, text, doc_id, min_chars).distinct(), "line-keys")
    runs = build_runs(keys, batches, fanout, min_docs)
    # a table of its own, so that Spark knows its size and may split the other side where one line is in very many documents
    repeated, _ = stash(runs.totals(min_docs), "repeated")
    runs.close()
    place = docs.columns.index(text)
    doomed = (
        keys.join(repeated, ["h1", "h2"])
        .where(F.col("doc_id") < F.col("last_doc"))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("h1", "h2")).alias("_drop"))
        .select(F.col("doc_id").alias("_doc"), "_drop")
    )

    def fn(given: pa.StructArray, drops: pa.Array) -> list[pa.Array]:
        kept, n_lines, n_dropped = [], [], []
        texts = given.field(place)
        lists = drops.to_pylist()
        for t, d in zip(texts.to_pylist(), lists, strict=True):
            lines = (t or "").split("\n")
            stay = lines
            if d:
                gone = {(x["h1"], x["h2"]) for x in d}
                stay = [x for x, h in zip(lines, _hashes(t, min_chars), strict=True) if h not in gone]
            kept.append("\n".join(stay) if d else t or "")
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
        return [pa.array(kept, pa.string()), pa.array(np.array(n_lines, np.int64)), pa.array(np.array(n_dropped, np.int64))]

    fields = (T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()))
    # rows without an id match nothing; their texts spread them over the tasks of the join
    spread = F.when(F.col("given")[doc_id].isNull(), F.pmod(F.xxhash64(F.col("given")[text]), F.lit(1 << 16))).otherwise(0).cast("int")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"))
    packed = packed.withColumn("_doc", F.col("given")[doc_id]).withColumn("_spread", spread)
    joined = packed.join(doomed.withColumn("_spread", F.lit(0)), ["_doc", "_spread"], "left")
    kept = with_arrow(joined.select("given", "_drop"), Step(("given", "_drop"), fields, fn), keep=["given", "kept", "n_lines", "n_dropped"])
    made = ("kept", "n_lines", "n_dropped")
    return kept.select(*[F.col("given")[c].alias(c) for c in docs.columns if c.lower() not in made], *made)
