"""Fragments: runs of reads that share a barcode, and the statistics drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import reads as R

ORDER = ["start", "end", "read_id", "flag", "line"]
GAP = 50_000


def gap_sessions(reads: DataFrame, gap: int = GAP, mask: int = R.NOT_FOR_ROUND1) -> DataFrame:
    """Reads with ``frag`` (1, 2, ...; by barcode and contig): a new one where the start is ``gap`` or more past the last end."""
    w = Window.partitionBy("bcd", "tid").orderBy(*ORDER)
    new = F.when(F.col("start") - F.lag("end").over(w) < gap, 0).otherwise(1)
    return reads.where(R.usable("flag", mask)).where("bcd is not null").withColumn("frag", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def gap_fragments(reads: DataFrame, gap: int = GAP, mask: int = R.NOT_FOR_ROUND1, min_mapq: int = 20, min_good: int = 0) -> DataFrame:
    """First-round fragments with at least ``min_good`` good reads: ``bcd, tid, frag, start, end, num_reads, num_good_reads``."""
    rows = gap_sessions(reads, gap, mask).groupBy("bcd", "tid", "frag")
    out = rows.agg(F.min("start").alias("start"), F.max_by("end", F.struct(*ORDER)).alias("end"), F.count(F.lit(1)).alias("num_reads"), F.count_if(F.col("mapq") >= min_mapq).alias("num_good_reads"))
    return out.where(F.col("num_good_reads") >= min_good)


def mate_pairs(reads: DataFrame, min_mapq: int = 10) -> DataFrame:
    """Pairs of primary alignments of one read id within a barcode, first before second in order."""
    good = reads.where(R.usable("flag", R.NOT_PRIMARY)).where(F.col("mapq") >= min_mapq)
    cols = ["tid", "start", "end", "flag", "line"]
    a = good.select("bcd", "read_id", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = good.select("bcd", "read_id", *[F.col(c).alias(f"b_{c}") for c in cols])
    first = F.struct(*[F.col(f"a_{c}") for c in cols]) < F.struct(*[F.col(f"b_{c}") for c in cols])
    return a.join(b, ["bcd", "read_id"]).where(first)


def discordant_reads(reads: DataFrame, cutoff: int, min_mapq: int = 10) -> DataFrame:
    """``bcd, read_id, tid, start, end, flag, line, mask``: each read's discordance bits over all its mates."""
    pairs = mate_pairs(reads, min_mapq)
    side = lambda p: {c: F.col(f"{p}_{c}") for c in ("tid", "start", "end", "flag")}
    pairs = pairs.withColumn("mask", R.discordance_mask(side("a"), side("b"), cutoff)).where("mask <> 0")
    both = F.array(*[F.struct(*[F.col(f"{p}_{c}").alias(c) for c in ("tid", "start", "end", "flag", "line")]) for p in "ab"])
    rows = pairs.select("bcd", "read_id", "mask", F.inline(both))
    return rows.groupBy("bcd", "read_id", "tid", "start", "end", "flag", "line").agg(F.bit_or("mask").alias("mask"))


def inner_sizes(reads: DataFrame, min_mapq: int = 10) -> DataFrame:
    """``bcd, read_id, inner_size`` of the mates that face each other.

    Only a forward and a reverse alignment of one contig do, so that no others meet, and a read goes to one side only.
    """
    good = reads.where(R.usable("flag", R.NOT_PRIMARY)).where(F.col("mapq") >= min_mapq)
    cols = ["start", "end", "flag"]
    side = lambda p, reverse: good.where(R.has_flag("flag", R.REVERSE) == F.lit(reverse)).select("bcd", "read_id", "tid", *[F.col(c).alias(f"{p}_{c}") for c in cols])
    pairs = side("a", False).join(side("b", True), ["bcd", "read_id", "tid"]).where("a_start <= b_start")
    mate = lambda p: {"tid": F.col("tid")} | {c: F.col(f"{p}_{c}") for c in cols}
    return pairs.select("bcd", "read_id", R.inner_size(mate("a"), mate("b")).alias("inner_size")).where("inner_size is not null")


def pair_sessions(reads: DataFrame, gap_cutoff: int, pair_cutoff: int) -> DataFrame:
    """Reads with ``frag`` as of the second round: a new one where the gap is above ``gap_cutoff`` or two adjacent reads are mates too far apart."""
    w = Window.partitionBy("bcd", "tid").orderBy(*ORDER)
    rows = reads.where(R.usable("flag", R.NOT_FOR_ROUND2)).where("bcd is not null")
    before = {c: F.lag(c).over(w) for c in ("tid", "start", "end", "flag", "read_id")}
    now = {c: F.col(c) for c in ("tid", "start", "end", "flag")}
    rows = rows.select("*", *[c.alias(f"p_{n}") for n, c in before.items()])
    far_mates = (F.col("p_read_id") == F.col("read_id")) & (R.inner_size({c: F.col(f"p_{c}") for c in now}, now) > pair_cutoff)
    new = F.when(F.col("p_end").isNull() | (F.col("start") - F.col("p_end") > gap_cutoff) | F.coalesce(far_mates, F.lit(False)), 1).otherwise(0)
    return rows.withColumn("frag", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(*[f"p_{c}" for c in before])


def cluster_fragments(reads: DataFrame, gap_cutoff: int, pair_cutoff: int, min_good: int = 6, min_mapq: int = 20) -> DataFrame:
    """Second-round fragments, kept with more than ``min_good`` good reads.

    The end is that of the last read in order; reads and their quality are listed in order.
    """
    return assemble(pair_sessions(reads, gap_cutoff, pair_cutoff), min_mapq).where(F.col("num_good_reads") > min_good)


def assemble(rows: DataFrame, min_mapq: int = 20) -> DataFrame:
    """One row for each (barcode, contig, frag) of marked reads."""
    listed = F.array_sort(F.collect_list(F.struct(*ORDER, "mapq", "hptype")))
    out = rows.groupBy("bcd", "tid", "frag").agg(listed.alias("r"))
    out = out.select(
        "tid", F.get("r", 0)["start"].alias("start"), F.element_at("r", -1)["end"].alias("end"), "bcd", "frag", F.size("r").alias("num_reads"),
        *[F.size(F.filter(F.col("r.hptype"), lambda x: x == F.lit(int(name[2])))).alias(name) for name in ("hp0", "hp1", "hp2")],
        F.transform("r", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("map_pos"), F.transform("r", lambda x: x["mapq"] >= min_mapq).alias("map_qual"),
    )
    out = out.withColumn("length", F.col("end") - F.col("start")).withColumn("num_good_reads", R.high_qual_read_count(F.col("map_qual")))
    return out.withColumn("frag_id", F.xxhash64("bcd", "tid", "frag"))


def renumber(fragments: DataFrame) -> DataFrame:
    """Dense ids from 0 in order of (tid, start, end, bcd): ranks within a contig plus the fragments of the contigs before."""
    sizes = fragments.groupBy("tid").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("tid", (F.sum("_n").over(Window.orderBy("tid")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("tid").orderBy("start", "end", "bcd", "frag")) - 1
    return fragments.withColumn("_rank", rank).join(F.broadcast(before), "tid").withColumn("dense_id", F.col("_before") + F.col("_rank")).drop("_rank", "_before")


def split_at_max_gap(fragments: DataFrame, p95: int) -> DataFrame:
    """Fragments of three reads or more whose largest start-to-start gap is above ``p95``, cut in two there: ``frag_id, piece, start, end, num_reads``."""
    gaps = F.transform(F.slice("map_pos", 2, F.greatest(F.size("map_pos") - 1, F.lit(0))), lambda x, i: x["start"] - F.get("map_pos", i)["start"])
    rows = fragments.withColumn("_gaps", gaps).withColumn("_top", F.array_max("_gaps"))
    cut = (F.size("map_pos") >= 3) & (F.col("_top") > p95)
    at = F.array_position("_gaps", F.col("_top")).cast("int")
    piece = lambda k, p: F.struct(F.lit(k).alias("piece"), F.get(p, 0)["start"].alias("start"), F.element_at(p, -1)["end"].alias("end"), F.size(p).alias("num_reads"))
    n = F.size("map_pos")
    two = F.array(piece(1, F.slice("map_pos", 1, at)), piece(2, F.slice("map_pos", at + 1, n - at)))
    return rows.select("frag_id", F.inline(F.when(cut, two).otherwise(F.array(piece(0, F.col("map_pos"))))))


def length_stats(fragments: DataFrame, fractions: tuple[float, ...] = (0.5, 0.95, 0.98, 0.99)) -> DataFrame:
    """Nx of the fragment lengths: the largest length at which those not shorter make up more than x of all bases."""
    hist = fragments.groupBy("length").agg(F.sum(F.col("length").cast("long")).alias("bases"))
    w = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("cum", F.sum("bases").over(w)).withColumn("total", F.sum("bases").over(Window.partitionBy()))
    return cum.agg(*[F.max(F.when(F.col("cum") > x * F.col("total"), F.col("length"))).alias(f"n{round(100 * x)}") for x in fractions])


def min_length(stats: DataFrame, floor: int = 5000) -> DataFrame:
    return stats.select(F.greatest("n95", F.lit(floor)).alias("min_fragment_length"))


def geometric_fit(values: DataFrame, col: str, cdf: tuple[float, ...] = (0.9, 0.92, 0.94, 0.96, 0.98)) -> DataFrame:
    """p of a geometric law: the median of 1 - (1 - c)^(1 / (k + 1)) over the quantiles k of the levels c."""
    q = values.agg(F.percentile(col, list(cdf)).alias("q"))
    return q.select(F.expr(f"transform(q, (k, i) -> 1 - power(1 - array({', '.join(f'{c}D' for c in cdf)})[i], 1 / (k + 1)))").alias("ps")).select(F.element_at(F.array_sort("ps"), len(cdf) // 2 + 1).alias("p"))


def gap_quantiles(fragments: DataFrame, min_length: int = 0) -> DataFrame:
    """Quantiles of the span gaps within fragments of at least ``min_length``."""
    gaps = fragments.where(F.col("length") >= min_length).select(F.explode(R.frag_gap_distances("map_pos")).alias("gap"))
    levels = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    return gaps.agg(*[F.percentile("gap", v).alias(k) for k, v in levels.items()])


def fragments_per_barcode(fragments: DataFrame) -> DataFrame:
    per = fragments.groupBy("bcd").agg(F.count(F.lit(1)).alias("n"), F.sum("num_reads").alias("r"))
    return per.agg(F.count(F.lit(1)).alias("n_barcodes"), F.sum("n").alias("n_fragments"), F.sum("r").alias("n_reads"), F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"))


def quality_filter(fragments: DataFrame, min_length: int = 2000, min_good: int = 6) -> DataFrame:
    good = F.col("num_good_reads")
    return fragments.where((F.col("length") >= min_length) & (good >= min_good) & (2 * good >= F.col("num_reads")))


def pair_nodes(fragments: DataFrame, min_length: int = 0, name: Column | None = None) -> DataFrame:
    """Endpoint nodes of the pairs of fragments of a barcode, in order of (tid, start, end, frag_id): one for each of 33, 55, 53 and 35.

    The join is quadratic in a barcode's fragments, which is what its result is; Spark splits a
    barcode that is too large for one task.
    """
    cols = ["tid", "start", "end", "frag_id"]
    a = fragments.select("bcd", F.struct(*cols).alias("a"))
    b = fragments.select("bcd", F.struct(*cols).alias("b"))
    pairs = a.join(b, "bcd").where("a < b")
    pairs = pairs.where((F.col("a.end") - F.col("a.start") + F.col("b.end") - F.col("b.start")) >= min_length)
    node = lambda kind, x, y: F.struct(F.lit(kind).alias("end_type"), F.col("a.tid").alias("x_tid"), F.col(f"a.{x}").alias("x_pos"), F.col("b.tid").alias("y_tid"), F.col(f"b.{y}").alias("y_pos"), F.col("a.frag_id").alias("frag1"), F.col("b.frag_id").alias("frag2"))
    return pairs.select("bcd", F.inline(F.array(node("33", "end", "end"), node("55", "start", "start"), node("53", "start", "end"), node("35", "end", "start"))))
