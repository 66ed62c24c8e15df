"""Document fingerprints as threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range. What is kept does not
depend on how much there is, so the sketch of a union is the union of sketches, and the share of a
small document's hashes found in a large one's estimates its containment, however unequal the two.
A short text may have no hash below the threshold: its sketch is empty and says nothing, which a
digest of all its shingles beside it makes up for where it is compared with the same shingles.
Everything is SQL over a row; comparing neighbours costs one shuffle of the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import WORD, lower_ascii

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 4


def sketch_and_digest(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """struct(sketch, digest) of the text's shingles of words, A-Z as a-z.

    ``sketch`` (array of long) has their sorted distinct hashes below the threshold, as signed numbers;
    ``digest`` (long) is equal for equal sets of shingles. A text of fewer words is one shingle; null
    and wordless texts have none, an empty sketch and the digest 0.
    """
    words = F.transform(F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    top = -(1 << 63) + (1 << 64) // scale - 1

    def kept(h: Column) -> Column:
        return F.struct(F.filter(h, lambda x: x <= F.lit(top).cast("long")).alias("sketch"), F.when(F.size(h) > 0, F.xxhash64(h)).otherwise(F.lit(0).cast("long")).alias("digest"))

    def hashes(w: Column) -> Column:
        full = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (shingle - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, shingle)]))
        own = F.when(F.size(w) >= shingle, full).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.expr("cast(array() as array<bigint>)"))
        return F.array_sort(F.array_distinct(own))

    # one-element arrays let the words, then the hashes, be made once
    return F.element_at(F.transform(F.transform(F.array(words), hashes), kept), 1)


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """The sketch alone: every shingle hash below the threshold, and no other."""
    return sketch_and_digest(text, shingle, scale)["sketch"]


def merge_sketches(df: DataFrame, by: list[str], col: str = "sketch") -> DataFrame:
    """The sketch of each group's union; equal hashes meet before the shuffle."""
    rows = df.select(*by, F.explode(col).alias("h")).distinct()
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list("h")).alias(col))


def likeness(a: str, b: str, same: Column | None = None) -> Column:
    """Estimated Jaccard similarity of two sketches; ``same`` tells whether the digests agree (then 1).

    Where neither sketch has a hash, only the digests can tell: 1 if they agree, else 0 (without
    ``same``: null).
    """
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    blind = F.lit(None).cast("double") if same is None else F.lit(0.0)
    known = F.when(either == 0, blind).otherwise(both / either)
    return known if same is None else F.when(same, F.lit(1.0)).otherwise(known)


def containment(a: str, b: str, same: Column | None = None) -> Column:
    """Estimated share of a's shingles that b has; null where a's sketch has no hash, which tells nothing of it."""
    known = F.when(F.size(a) == 0, F.lit(None).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
    return known if same is None else F.when(same, F.lit(1.0)).otherwise(known)


def as_string(col: str, digest: str) -> Column:
    """16 hex digits for the digest and for each hash."""
    return F.array_join(F.transform(F.concat(F.array(digest), F.col(col)), lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


#: Most ranges of the order of ids; beyond that ranges grow, so that their cuts stay a few MB.
MOST_RANGES = 100_000


def _ranges(rows: DataFrame, buckets: int | None, bytes_a_range: int) -> tuple[Column, int]:
    """The range of a row in the order by (doc_id, tie), nulls first, as an int that grows with it; and how many there are at most.

    The keys alone are dealt to sampled ranges; the least key of each (one row a range) makes a sorted
    array, one constant of the plan, in which a row finds its place by halving. An id that fills several
    ranges, or null, is cut by ``tie``, the hash of the text.
    """
    size = rows.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    least = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or max(least, -(-size // max(bytes_a_range, size // MOST_RANGES)))
    dealt = rows.select("doc_id", "tie").repartitionByRange(buckets, "doc_id", "tie").groupBy(F.spark_partition_id().alias("k"))
    cuts = sorted((r["low"] for r in dealt.agg(F.min(F.struct("doc_id", "tie")).alias("low")).collect()), key=lambda c: (c[0] is not None, c[0] or 0, c[1]))[1:]
    if not cuts:
        return F.lit(0), buckets
    kind = rows.schema["doc_id"].dataType.simpleString()
    listed = lambda values, t: F.split(F.lit(",".join(str(v) for v in values)), ",").cast(f"array<{t}>")
    named = [c for c in cuts if c[0] is not None]
    unnamed = [c[1] for c in cuts if c[0] is None]
    tie_of_named, id_of_named = (listed([c[1] for c in named], "bigint"), listed([c[0] for c in named], kind)) if named else (None, None)

    def below(n: int, is_below: Callable[[Column], Column]) -> Column:
        """How many of n sorted cuts are at or below the row."""
        lo, hi = F.lit(0).alias("lo"), F.lit(n).alias("hi")

        def halve(s: Column, _: Column) -> Column:
            mid = ((s["lo"] + s["hi"]) / 2).cast("int")
            left, right = F.struct(s["lo"].alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))
            return F.when(s["lo"] >= s["hi"], s).when(is_below(mid), right).otherwise(left)

        return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), F.struct(lo, hi), halve, lambda s: s["lo"])

    def named_below(k: Column) -> Column:
        cut = F.get(id_of_named, k)
        return (cut < F.col("doc_id")) | ((cut == F.col("doc_id")) & (F.get(tie_of_named, k) <= F.col("tie")))

    of_null = below(len(unnamed), lambda k: F.get(listed(unnamed, "bigint"), k) <= F.col("tie")) if unnamed else F.lit(0)
    of_named = F.lit(len(unnamed)) + (below(len(named), named_below) if named else F.lit(0))
    return F.when(F.col("doc_id").isNull(), of_null).otherwise(of_named).cast("int"), len(cuts) + 1


def with_next(docs: DataFrame, buckets: int | None = None, bytes_a_range: int = 32 << 20) -> DataFrame:
    """``docs`` (``doc_id, text``) with ``sketch, digest`` and the ``next_text, next_sketch, next_digest`` of the document that follows in descending id.

    After the last comes the first; null ids come last; rows that repeat an id follow in the order of
    their texts' hashes, which also cuts null ids and much repeated ones into several ranges. Ranges
    have about equal numbers of rows, and are as many as the texts' bytes ask for; each is one window.
    What follows the end of a range comes from the table of the ranges' first documents. Other columns
    of ``docs`` are left out.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    at, buckets = _ranges(rows, buckets, bytes_a_range)
    rows = rows.withColumn("bucket", at)
    first = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("top"))
    # one row for each range
    follow = Window.orderBy(F.desc("bucket"))
    order = first.select("bucket", F.lead("bucket").over(follow).alias("then"))
    order = order.withColumn("then", F.coalesce("then", F.max("bucket").over(Window.partitionBy())))
    tops = first.select(F.col("bucket").alias("b"), F.col("top.doc_id").alias("d"), F.col("top.tie").alias("t"))
    head = rows.join(F.broadcast(tops), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")))
    head = head.groupBy("bucket").agg(F.first("text").alias("head_text")).withColumnRenamed("bucket", "then")
    heads = order.join(head, "then").select("bucket", "head_text")
    dealt = rows.repartition(buckets, F.col("bucket")).withColumn("own", sketch_and_digest(F.col("text")))
    w = Window.partitionBy("bucket").orderBy(F.desc("doc_id"), F.desc("tie"))
    pairs = dealt.withColumn("next_text", F.lead("text").over(w)).withColumn("next_own", F.lead("own").over(w))
    out = pairs.join(heads, "bucket", "left")
    out = out.withColumn("next_own", F.when(F.col("next_text").isNull(), sketch_and_digest(F.col("head_text"))).otherwise(F.col("next_own")))
    return out.select(
        "doc_id", "text", "own.sketch", "own.digest", F.coalesce("next_text", "head_text").alias("next_text"), F.col("next_own.sketch").alias("next_sketch"), F.col("next_own.digest").alias("next_digest")
    )


def compare_with_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document's sketch against that of its edited text and of the next document.

    The edited text ends with the start of the next document in place of its last third. Returns
    ``doc_id, n_chars, edited, sketch, digest, edited_sketch, edited_digest, near_edited, near_next,
    contained_edited``, one row for each row of ``docs``, repeated rows too. Null texts count as empty
    ones; an empty table gives no rows.
    """
    rows = with_next(docs, buckets).withColumn("n_chars", F.length("text").cast("long"))
    k = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - k).cast("int")), F.substr("next_text", F.lit(1), k))
    rows = rows.withColumn("edited", edited).withColumn("_own", sketch_and_digest(F.col("edited")))
    rows = rows.withColumn("edited_sketch", F.col("_own.sketch")).withColumn("edited_digest", F.col("_own.digest"))
    same, same_next = F.col("digest") == F.col("edited_digest"), F.col("digest") == F.col("next_digest")
    return rows.select(
        "doc_id", "n_chars", "edited", "sketch", "digest", "edited_sketch", "edited_digest",
        likeness("sketch", "edited_sketch", same).alias("near_edited"), likeness("sketch", "next_sketch", same_next).alias("near_next"), containment("sketch", "edited_sketch", same).alias("contained_edited"),
    )
