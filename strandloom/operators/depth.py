"""Binned depth of reads, barcodes and fragments, and the distributions drawn from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.reads import usable
from strandloom.operators.ranks import numbered
from strandloom.operators.intervals import delta_counts, expand_runs, merge_intervals, with_halo

BIN = 100


def _mid_bin(size: int) -> Column:
    return F.floor((F.col("start") + F.col("end")) / (2 * size))


def alignment_stats(reads: DataFrame) -> DataFrame:
    """One row of counts over all alignments."""
    flag, n = F.col("flag"), lambda c: F.count_if(c)
    bit = lambda k: flag.bitwiseAND(k) != 0
    effective = F.count(F.lit(1)) - n(bit(1024)) - n(bit(256)) - n(bit(2048))
    return reads.agg(
        n(~bit(256) & ~bit(2048)).alias("n_primary"), n(bit(4)).alias("n_unmapped"), n(bit(2048)).alias("n_supplementary"), n(bit(256)).alias("n_secondary"), n(bit(1024)).alias("n_duplicate"),
        n(F.col("mapq") >= 30).alias("n_mapq30"), n(F.col("mapq").between(20, 29)).alias("n_mapq20"), n(F.col("mapq").between(10, 19)).alias("n_mapq10"),
        n(F.col("bcd").isNull()).alias("n_no_barcode"), n(F.col("hptype") == 0).alias("n_no_haplotype"), effective.alias("n_effective"),
    )


def read_depth(reads: DataFrame, min_mapq: int = 20, size: int = BIN) -> DataFrame:
    """``tid, bin, hq, total``: aligned length of the reads whose middle is in the bin, a base of the bin."""
    length = F.col("end") - F.col("start")
    rows = reads.where(usable()).groupBy("tid", _mid_bin(size).alias("bin"))
    return rows.agg((F.sum(F.when(F.col("mapq") >= min_mapq, length).otherwise(0)) / size).alias("hq"), (F.sum(length) / size).alias("total"))


def hap_read_depth(reads: DataFrame, min_mapq: int = 20, size: int = BIN) -> DataFrame:
    """Depth by haplotype, each read's length split over the bins that it covers."""
    rows = reads.where(usable()).where("start < `end`").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    part = F.least(F.col("end"), (F.col("bin") + 1) * size) - F.greatest(F.col("start"), F.col("bin") * size)
    out = []
    for h in (0, 1, 2):
        out += [(F.sum(F.when((F.col("hptype") == h) & (F.col("mapq") >= min_mapq), part).otherwise(0)) / size).alias(f"hq{h}"), (F.sum(F.when(F.col("hptype") == h, part).otherwise(0)) / size).alias(f"total{h}")]
    out += [(F.sum(F.when(F.col("mapq") >= min_mapq, part).otherwise(0)) / size).alias("hq"), (F.sum(part) / size).alias("total")]
    return rows.groupBy("tid", "bin").agg(*out)


def barcode_depth(reads: DataFrame, min_mapq: int = 20, size: int = BIN) -> DataFrame:
    """Distinct barcodes whose reads' middles are in the bin, times 100 over the bin size."""
    rows = reads.where(usable()).groupBy("tid", _mid_bin(size).alias("bin"), "bcd").agg(F.max("mapq").alias("q"))
    scale = 100.0 / size
    return rows.groupBy("tid", "bin").agg((F.count_if(F.col("q") >= min_mapq) * scale).alias("hq"), (F.count("bcd") * scale).alias("total"))


def fragment_coverage(fragments: DataFrame, size: int = BIN) -> DataFrame:
    """``tid, bin, n``: fragments over each bin, both end bins included."""
    rows = fragments.select("tid", F.floor(F.col("start") / size).alias("lo"), F.floor(F.col("end") / size).alias("hi"))
    return expand_runs(delta_counts(rows, "lo", "hi", ["tid"], {"n": F.lit(1)})).select("tid", F.col("idx").alias("bin"), "n")


def high_coverage_regions(coverage: DataFrame, size: int = BIN) -> DataFrame:
    """Merged regions of bins above four times the robust upper limit of their contig."""
    q = coverage.groupBy("tid").agg(F.percentile("n", 0.5).alias("mid"), F.percentile("n", 0.8413).alias("up"))
    low = coverage.join(F.broadcast(q), "tid").where(F.col("n") < F.col("mid") + 3 * (F.col("up") - F.col("mid")))
    limit = low.groupBy("tid").agg((4 * F.percentile("n", 0.5)).alias("limit"))
    high = coverage.join(F.broadcast(limit), "tid").where("n > `limit`")
    return merge_intervals(high.select("tid", (F.col("bin") * size).alias("start"), ((F.col("bin") + 1) * size).alias("end")))


def hap_fragment_depth(fragments: DataFrame, size: int = BIN, cap: int = 10_000) -> DataFrame:
    """``tid, bin, d0, d1, d2, d3``: fragments of each haplotype over the bin (end bin excluded), and all."""
    rows = fragments.select("tid", F.floor(F.col("start") / size).alias("lo"), (F.floor(F.col("end") / size) - 1).alias("hi"), "hap")
    runs = expand_runs(delta_counts(rows, "lo", "hi", ["tid"], {f"d{h}": F.when(F.col("hap") == h, 1).otherwise(0) for h in (0, 1, 2)}))
    d = [F.least(F.col(f"d{h}"), F.lit(cap)).alias(f"d{h}") for h in (0, 1, 2)]
    return runs.select("tid", F.col("idx").alias("bin"), *d).withColumn("d3", F.col("d0") + F.col("d1") + F.col("d2"))


def histogram_quantiles(values: DataFrame, value: str, steps: int = 1000) -> DataFrame:
    """``k, value`` for k = 0..steps: the smallest value with at least k / steps of all rows at or below it."""
    hist = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("cum", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    # value v answers all k above what came before it
    lo = F.when(F.col("cum") == F.col("n"), 0).otherwise(F.floor((F.col("cum") - F.col("n")) * steps / F.col("total")) + 1)
    hi = F.floor(F.col("cum") * steps / F.col("total"))
    return cum.select("v", lo.alias("lo"), hi.alias("hi")).where("lo <= hi").select(F.explode(F.sequence("lo", "hi")).alias("k"), F.col("v").alias("value"))


def depth_distribution(depth: DataFrame, col: str = "total") -> DataFrame:
    """Quantiles of 100 times the depth, at most 10**6, over the bins that have any."""
    rows = depth.where(F.col(col) >= 0.001).select(F.least(F.floor(F.col(col) * 100 + 0.5), F.lit(1_000_000)).cast("long").alias("d"))
    return histogram_quantiles(rows, "d")


def depth_rate(read_depth: DataFrame, frag_depth: DataFrame, steps: int = 1000) -> DataFrame:
    """Quantiles (by rank ``int(n * b + 0.5)``) of read depth over fragment depth, in bins that have both."""
    rows = read_depth.join(frag_depth, ["tid", "bin"]).where("total > 0 and d3 > 0").select((F.col("total") / F.col("d3")).alias("rate"), "tid", "bin")
    ranked = numbered(rows, ["rate", "tid", "bin"], "i", 0)
    wanted = rows.sparkSession.range(steps + 1).select(F.col("id").alias("k"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    at = wanted.join(F.broadcast(n)).select("k", F.least(F.floor(F.col("n") * F.col("k") / steps + 0.5), F.col("n") - 1).alias("i"))
    return at.join(ranked, "i").select("k", "rate")


def densify(depth: DataFrame, contigs: DataFrame, size: int = BIN, extra: int = 2) -> DataFrame:
    """Every bin of every contig, zero where nothing was seen."""
    bins = contigs.select("tid", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / size) + extra - 1)).alias("bin"))
    cols = [c for c in depth.columns if c not in ("tid", "bin")]
    # the bins of a few contigs look small to the planner, which would broadcast them
    return bins.hint("merge").join(depth, ["tid", "bin"], "left").select("tid", "bin", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols])


def genome_mean_std(dense: DataFrame, col: str = "total") -> DataFrame:
    return dense.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.avg("hq").alias("mean_hq"))


def bin_size(positions: DataFrame, pos: str = "start") -> DataFrame:
    """The median positive step between consecutive positions of a contig."""
    w = Window.partitionBy("tid").orderBy(pos)
    steps = positions.select("tid", pos).distinct().select((F.col(pos) - F.lag(pos).over(w)).alias("step")).where("step > 0")
    return steps.agg(F.percentile("step", 0.5).alias("bin_size"))


#: Bins of a tile, many times those of a window.
CENTROID_TILE = 20_000


def weighted_centroid(depth: DataFrame, n_bins: int = 100, size: int = BIN) -> DataFrame:
    """``tid, bin, c1, c2``: depth-weighted mean positions of the windows left and right of each bin's start; null without depth.

    Contigs are cut into tiles, and the bins that a tile's windows reach beyond it are copied to it.
    """
    rows = with_halo(depth.select("tid", "bin", F.col("hq").cast("int").cast("long").alias("d")), "bin", n_bins, n_bins, max(CENTROID_TILE, n_bins))
    w = Window.partitionBy("tid", "_tile").orderBy("bin")
    # sums of whole numbers up to a place, whose differences are exact: a frame with two ends would be summed anew for each bin
    upto = lambda v, k: F.coalesce(F.sum(v).over(w.rangeBetween(Window.unboundedPreceding, k)), F.lit(0))
    value = {"m": F.col("d") * F.col("bin"), "d": F.col("d")}
    rows = rows.select("tid", "bin", "_own", *[upto(v, k).alias(f"_{n}{i}") for n, v in value.items() for i, k in enumerate((-n_bins - 1, -1, n_bins - 1))]).where("_own")
    total = lambda n, side: F.col(f"_{n}{side}") - F.col(f"_{n}{side - 1}")
    mean = lambda side: total("m", side) * size / F.when(total("d", side) > 0, total("d", side))
    return rows.select("tid", "bin", mean(1).alias("c1"), mean(2).alias("c2"))
