"""Evidence for a call: shared fragments and barcodes, read pairs, discordant clusters, profiles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.reads import REVERSE, has_flag
from strandloom.operators.graph import connected_components
from strandloom.operators.intervals import overlap_join
from strandloom.operators.nodes import cluster, neighbours
from strandloom.operators.ranks import quantiles


def shared_barcodes(side1: DataFrame, side2: DataFrame) -> DataFrame:
    """``cand_id, bcd, frag1, frag2, same``: the best fragment of each barcode on both sides of a candidate.

    Sides: ``cand_id, bcd, frag_id, num_reads, pos``. The best has most reads, then the lowest position.
    """
    best = lambda s: s.groupBy("cand_id", "bcd").agg(F.max_by("frag_id", F.struct("num_reads", -F.col("pos"), "frag_id")).alias("f"))
    rows = best(side1).withColumnRenamed("f", "frag1").join(best(side2).withColumnRenamed("f", "frag2"), ["cand_id", "bcd"])
    return rows.withColumn("same", F.col("frag1") == F.col("frag2"))


def read_pair_support(pairs: DataFrame, reads: DataFrame, end1: str = "R_end", end2: str = "L_end") -> DataFrame:
    """``pairs`` (``frag1, frag2``) with ``supported``: a read id is in both fragments in the strands that the end types ask for, R forward and L reverse.

    ``reads``: ``bcd, frag_id, read_id, flag``.
    """
    side = lambda k, end: reads.where(has_flag("flag", REVERSE) == F.lit(end == "L_end")).select("bcd", "read_id", F.col("frag_id").alias(f"frag{k}")).distinct()
    met = side(1, end1).join(side(2, end2), ["bcd", "read_id"]).select("frag1", "frag2", F.lit(True).alias("supported")).distinct()
    return pairs.join(met, ["frag1", "frag2"], "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def all_pairs_support(fragments: DataFrame, reads: DataFrame, end1: str = "R_end", end2: str = "L_end") -> DataFrame:
    """``read_pair_support`` of every two fragments (``bcd, frag_id, at``) of a barcode, the first by ``at`` as ``frag1``.

    A fragment brings the few others that its reads support, so that the pairs, which grow with the square of a
    barcode's fragments, are looked up where they are made and never shuffled.
    """
    side = lambda k, end: reads.where(has_flag("flag", REVERSE) == F.lit(end == "L_end")).select("bcd", "read_id", F.col("frag_id").alias(f"frag{k}")).distinct()
    met = side(1, end1).join(side(2, end2), ["bcd", "read_id"]).groupBy("bcd", "frag1").agg(F.collect_set("frag2").alias("_partners"))
    a = fragments.select("bcd", F.col("frag_id").alias("frag1"), F.col("at").alias("_at1")).join(met, ["bcd", "frag1"], "left")
    b = fragments.select("bcd", F.col("frag_id").alias("frag2"), F.col("at").alias("_at2"))
    return a.join(b, "bcd").where("_at1 < _at2").select("frag1", "frag2", F.coalesce(F.array_contains("_partners", F.col("frag2")), F.lit(False)).alias("supported"))


def lookup(points: DataFrame, values: DataFrame, value: str, size: int = 100) -> DataFrame:
    """``points`` (``tid, pos``) with the value of their bin, 0 where there is none."""
    rows = points.withColumn("bin", F.floor(F.col("pos") / size))
    return rows.join(values.select("tid", "bin", value), ["tid", "bin"], "left").withColumn(value, F.coalesce(value, F.lit(0))).drop("bin")


def low_mapq_ratio(calls: DataFrame, low: DataFrame, flank: int = 10_000) -> DataFrame:
    """``calls`` (``call_id, tid, start, end, barcodes``) with the share of their barcodes that have a low-quality read within the flanks."""
    each = calls.select("call_id", "tid", "start", "end", F.explode("barcodes").alias("bcd"), F.size("barcodes").alias("n"))
    near = each.join(low.select("bcd", F.col("tid").alias("t"), F.col("start").alias("p")), "bcd").where((F.col("t") == F.col("tid")) & F.col("p").between(F.col("start") - flank, F.col("end") + flank))
    hits = near.groupBy("call_id").agg(F.count_distinct("bcd").alias("k"))
    return calls.join(hits, "call_id", "left").withColumn("low_ratio", F.coalesce("k", F.lit(0)) / F.size("barcodes")).drop("k")


def reads_in_regions(reads: DataFrame, regions: DataFrame, size: int = 100) -> DataFrame:
    """``tid, bin, bcd`` of the reads whose middle bin lies in a region, once each."""
    bins = reads.select("tid", "bcd", F.floor((F.col("start") + F.col("end")) / (2 * size)).alias("bin")).distinct()
    places = bins.select("tid", "bin").distinct().select("tid", "bin", (F.col("bin") * size).alias("start"), (F.col("bin") * size + 1).alias("end"))
    inside = overlap_join(places, regions.select("tid", "start", "end")).select("tid", "bin").distinct()
    return bins.join(inside, ["tid", "bin"], "left_semi").select("tid", "bin", "bcd")


def _in_both_regions(reads: DataFrame, pairs: DataFrame, cols: Callable[[int], list[Column]]) -> DataFrame:
    """``pair_id, bcd, read_id`` and the columns of both alignments, for reads aligned in both regions of a pair."""
    sides = []
    for k in (1, 2):
        box = pairs.select("pair_id", F.col(f"tid{k}").alias("tid"), F.col(f"start{k}").alias("start"), F.col(f"end{k}").alias("end"))
        sides.append(overlap_join(reads, box).select(F.col("b_pair_id").alias("pair_id"), "bcd", "read_id", *cols(k)))
    return sides[0].join(sides[1], ["pair_id", "bcd", "read_id"])


def region_read_pairs(reads: DataFrame, pairs: DataFrame) -> DataFrame:
    """Reads with alignments in both regions of a pair: ``pair_id, read_id, kind``: PE for different mates, SR for one mate clipped on both sides.

    ``pairs``: ``pair_id, tid1, start1, end1, tid2, start2, end2``.
    """
    rows = _in_both_regions(reads, pairs, lambda k: [F.col("flag").alias(f"f{k}"), F.col("clipped").alias(f"c{k}"), F.col("start").alias(f"p{k}")])
    mates = has_flag("f1", 64) != has_flag("f2", 64)
    kind = F.when(mates, "PE").when(F.col("c1") & F.col("c2") & (F.col("p1") != F.col("p2")), "SR")
    return rows.select("pair_id", "read_id", kind.alias("kind"), "p1", "p2").where("kind is not null").distinct()


def cluster_discordant(pairs: DataFrame, near: int = 300, least: int = 800, most: int = 45_000, max_members: int = 1000, min_members: int = 2) -> DataFrame:
    """Clusters of deletion-like pairs (``key, tid, end1, start2, hap``): ``component, tid, start, end, n, hp0, hp1, hp2, filter``.

    Pairs with an inner size within the bounds are linked if both ends are less than ``near`` apart.
    """
    rows = pairs.where((F.col("start2") - F.col("end1")).between(least, most))
    nodes = rows.select("key", "tid", F.col("end1").alias("x_pos"), F.col("start2").alias("y_pos"))
    comps = connected_components(neighbours(nodes, "key", near, ["tid"]), "a", "b")
    members = rows.join(comps.withColumnRenamed("node", "key"), "key")
    out = members.groupBy("component").agg(
        F.first("tid").alias("tid"), F.floor(F.avg("end1") + 0.5).alias("start"), F.floor(F.avg("start2") + 0.5).alias("end"), F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("hap") == h).alias(f"hp{h}") for h in (0, 1, 2)],
    )
    return out.where(F.col("n").between(min_members, max_members)).withColumn("filter", F.when(F.col("n") >= 5, "PASS").otherwise("LOW_SUPPORT"))


def assembly_breakpoints(alignments: DataFrame, min_mapq: int = 10) -> DataFrame:
    """Events between alignments of one query (``qname, qbeg, qend, tid, start, end, reverse, mapq``) that follow each other.

    X: other contig; V: other strand; D: a gap in the reference; I: a gap in the query; C: anything else.
    All columns order them, so that only rows that are equal throughout are tied.
    """
    w = Window.partitionBy("qname").orderBy("qbeg", "qend", "tid", "start", "end", "reverse", "mapq")
    cols = ["qend", "tid", "start", "end", "reverse", "mapq"]
    rows = alignments.select("*", *[F.lag(c).over(w).alias(f"p_{c}") for c in cols]).where("p_tid is not null")
    ref_gap = F.when(F.col("reverse"), F.col("p_start") - F.col("end")).otherwise(F.col("start") - F.col("p_end"))
    q_gap = F.col("qbeg") - F.col("p_qend")
    kind = F.when(F.col("tid") != F.col("p_tid"), "X").when(F.col("reverse") != F.col("p_reverse"), "V").when(ref_gap > q_gap, "D").when(ref_gap < q_gap, "I").otherwise("C")
    return rows.select("qname", "p_tid", "p_end", "tid", "start", kind.alias("event"), F.when(F.col("tid") == F.col("p_tid"), F.abs(ref_gap - q_gap)).alias("length"), F.least("mapq", "p_mapq").alias("mapq")).withColumn("filter", F.when(F.col("mapq") < min_mapq, "LowSupp").otherwise("."))


def breakpoint_evidence(reads: DataFrame, pairs: DataFrame) -> DataFrame:
    """``call_id, bcd, read_id, kind, pos1, pos2, strand1, strand2`` of reads aligned in both regions of a call, once each.

    PE: different mates; positions are the ends that the reads point with, the end of a forward read and
    the start of a reverse one. SR: one mate, clipped on both sides of the call; positions are the ends with the longer clip.
    Strands are 1 and -1. ``reads`` has ``cigar``; a null one has no clip.
    """
    reverse = has_flag("flag", REVERSE)
    # a cast that fails costs far more than one of null
    left, right = (F.coalesce(F.nullif(F.regexp_extract("cigar", p, 1), F.lit("")).try_cast("int"), F.lit(0)) for p in (r"^(\d+)[SH]", r"(\d+)[SH]$"))
    points = F.when(reverse, F.col("start")).otherwise(F.col("end"))
    cut = F.when(left > right, F.col("start")).when(right > 0, F.col("end"))
    rows = _in_both_regions(reads, pairs, lambda k: [F.col("flag").alias(f"f{k}"), points.alias(f"e{k}"), cut.alias(f"c{k}"), F.when(reverse, -1).otherwise(1).alias(f"strand{k}"), F.col("start").alias(f"s{k}")])
    mates = has_flag("f1", 64) != has_flag("f2", 64)
    split = ~mates & F.col("c1").isNotNull() & F.col("c2").isNotNull() & (F.col("s1") != F.col("s2"))
    at = lambda k: F.when(mates, F.col(f"e{k}")).otherwise(F.col(f"c{k}")).alias(f"pos{k}")
    return rows.where(mates | split).select(F.col("pair_id").alias("call_id"), "bcd", "read_id", F.when(mates, "PE").otherwise("SR").alias("kind"), at(1), at(2), "strand1", "strand2").distinct()


def insert_size_stats(pairs: DataFrame, reads: DataFrame) -> DataFrame:
    """Quartiles of the positive insert sizes, the upper fence, Q3 + 1.5 IQR, and the median lengths of first and second mates."""
    # there are about as many sizes as pairs, but few lengths of reads
    q1, q2, q3 = quantiles(pairs.where("inner_size > 0"), "inner_size", [0.25, 0.5, 0.75]) or (None, None, None)
    of_mate = lambda bit: F.percentile(F.when(has_flag("flag", bit), F.col("end") - F.col("start")), 0.5)
    lengths = reads.agg(F.lit(1).alias("_k"), of_mate(64).alias("length1"), of_mate(128).alias("length2"))
    cutoff = None if q1 is None else q3 + 1.5 * (q3 - q1)
    sizes = pairs.sparkSession.createDataFrame([(1, q1, q2, q3, cutoff)], "_k int, q1 double, q2 double, q3 double, cutoff double")
    return sizes.join(lengths, "_k").drop("_k")  # of one row each


#: Steps of a block of the profile.
BLOCK = 200


def profile(calls: DataFrame, values: DataFrame, size: int = 100, step: int = 500) -> DataFrame:
    """Plot series: values of the bins from a call's length before it to its length after it, averaged by ``step``.

    Steps are averaged once, and a block of them is one row that calls are joined with; only the two steps at a
    call's ends, which it may cover in part, are averaged anew. No call's bins are shuffled.
    """
    length = F.col("end") - F.col("start")
    wide = calls.select("call_id", "tid", F.greatest(F.col("start") - length, F.lit(0)).alias("start"), (F.col("end") + length).alias("end"))
    wide = wide.where("start < `end`").withColumn("_block", F.explode(F.sequence(F.floor(F.col("start") / (step * BLOCK)), F.floor((F.col("end") - 1) / (step * BLOCK)))))
    needed = wide.select("tid", "_block").distinct()
    bins = values.select("tid", F.struct((F.col("bin") * size).alias("at"), "hq", "total").alias("b")).withColumn("pos", F.floor(F.col("b.at") / step) * step)
    bins = bins.withColumn("_block", F.floor(F.col("pos") / (step * BLOCK))).join(needed, ["tid", "_block"], "left_semi")
    steps = bins.groupBy("tid", "_block", "pos").agg(F.avg("b.hq").alias("hq"), F.avg("b.total").alias("total"), F.min("b.at").alias("_first"), F.max("b.at").alias("_last"), F.collect_list("b").alias("_bins"))
    blocks = steps.groupBy("tid", "_block").agg(F.collect_list(F.struct("pos", "hq", "total", "_first", "_last", "_bins")).alias("_steps"))
    rows = wide.join(blocks, ["tid", "_block"]).select("call_id", "start", "end", F.inline("_steps")).where("_last >= start and _first < `end`")

    def mean(col: str) -> Column:
        inside = F.filter("_bins", lambda b: (b["at"] >= F.col("start")) & (b["at"] < F.col("end")) & b[col].isNotNull())
        some = F.aggregate(inside, F.lit(0.0), lambda t, b: t + b[col]) / F.nullif(F.size(inside), F.lit(0))
        return F.when((F.col("_first") >= F.col("start")) & (F.col("_last") < F.col("end")), F.col(col)).otherwise(some).alias(col)

    # between its first and last bin a step may have none of the call's
    met = F.exists("_bins", lambda b: (b["at"] >= F.col("start")) & (b["at"] < F.col("end")))
    return rows.where(((F.col("_first") >= F.col("start")) & (F.col("_last") < F.col("end"))) | met).select("call_id", "pos", mean("hq"), mean("total"))


def largest_group(evidence: DataFrame, near: int, by: list[str]) -> DataFrame:
    """Of each call's evidence (``call_id, key, x_pos, y_pos``) the largest proximity group of equal ``by``: ``call_id, n, x, y`` (medians) and ``by``.

    Groups are built through cells, so no pairs of evidence are made. Of equal sizes the group of the lowest medians counts.
    """
    rows = cluster(evidence, "key", near, 1, by)
    groups = rows.groupBy(*by, "component_id").agg(F.count(F.lit(1)).alias("n"), F.percentile("x_pos", 0.5).alias("x"), F.percentile("y_pos", 0.5).alias("y"))
    rest = [c for c in by if c != "call_id"]
    return groups.groupBy("call_id").agg(F.max_by(F.struct("n", "x", "y", *rest), F.struct("n", -F.col("x"), -F.col("y"), *rest)).alias("g")).select("call_id", "g.*")


def _keyed(evidence: DataFrame, kind: str) -> DataFrame:
    key = F.concat_ws("/", "call_id", "bcd", "read_id", "pos1", "pos2", "strand1", "strand2")
    return evidence.where(F.col("kind") == kind).select("call_id", key.alias("key"), F.col("pos1").alias("x_pos"), F.col("pos2").alias("y_pos"), "strand1", "strand2")


def group_pe_support(evidence: DataFrame, cutoff: float, gap: float) -> DataFrame:
    """``call_id, n, bk1, bk2``: each call's largest group of read pairs of equal strands, less than ``cutoff`` apart at both ends.

    A breakpoint is the median of the ends, half the usual ``gap`` between mates on in the reads' direction; a negative gap counts as 0.
    """
    half = max(gap, 0.0) / 2
    best = largest_group(_keyed(evidence, "PE"), max(int(math.ceil(cutoff)), 1), ["call_id", "strand1", "strand2"])
    return best.select("call_id", "n", (F.col("x") + F.col("strand1") * half).alias("bk1"), (F.col("y") + F.col("strand2") * half).alias("bk2"))


def group_sr_support(evidence: DataFrame, near: int = 50) -> DataFrame:
    """``call_id, n, bk1, bk2``: each call's largest group of split reads, cut less than ``near`` apart on both sides, with its median cuts."""
    return largest_group(_keyed(evidence, "SR"), near, ["call_id"]).select("call_id", "n", F.col("x").alias("bk1"), F.col("y").alias("bk2"))
