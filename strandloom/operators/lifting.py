"""Annotation of variants by lookup, and lifting of hits through alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.reads import cigar_parse
from strandloom.operators.intervals import merge_intervals


def annotate_homopolymer(variants: DataFrame, runs: DataFrame) -> DataFrame:
    """``variants`` with ``run``, the length of the homopolymer (``chrom, pos, base, run``) that starts where a pure-base indel does."""
    more = F.when(F.length("alt") < F.length("ref"), F.substring("ref", 2, 1_000_000)).when(F.length("alt") > F.length("ref"), F.substring("alt", 2, 1_000_000))
    base = F.when(F.replace(more, F.substring(more, 1, 1), F.lit("")) == "", F.substring(more, 1, 1))
    longest = runs.groupBy("chrom", "pos", "base").agg(F.max("run").alias("run"))
    return variants.withColumn("base", base).join(longest, ["chrom", "pos", "base"], "left").drop("base")


def annotate(sites: DataFrame, bed: DataFrame) -> DataFrame:
    """``sites`` (``chrom, pos, dp4``: reference and alternative depth by strand) with ``dp, ds, ab`` and ``in_bed``."""
    d = lambda k: F.get("dp4", k)
    rows = sites.withColumn("dp", d(0) + d(1) + d(2) + d(3)).withColumn("ds", F.least(d(2), d(3))).withColumn("ab", F.when(F.col("dp") > 0, F.floor(100.0 * (d(2) + d(3)) / F.col("dp"))).cast("int"))
    size = 10_000
    wide = bed.select("chrom", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("_k"))
    places = sites.select("chrom", "pos").distinct().withColumn("_k", F.floor(F.col("pos") / size))
    inside = places.join(wide, ["chrom", "_k"]).where("pos >= start and pos < `end`").select("chrom", "pos").distinct().withColumn("_in", F.lit(True))
    return rows.join(inside, ["chrom", "pos"], "left").withColumn("in_bed", F.coalesce("_in", F.lit(False))).drop("_in")


def lift_hits(hits: DataFrame, alignments: DataFrame) -> DataFrame:
    """Hits on contigs (``contig, qpos, len, score``) in the coordinates that the contigs align to (``contig, tid, start, cigar``).

    Only hits that start in an aligned block are lifted. Lifted hits that touch are one group with the
    best score: ``tid, start, end, best_score, n``.
    """
    ops = cigar_parse(F.col("cigar"))
    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("r"), F.expr("cast(array() as array<struct<q0:int,q1:int,r0:int>>)").alias("out"))

    def step(t, x):
        both = x["op"].isin("M", "=", "X")
        q = t["q"] + F.when(both | x["op"].isin("I", "S"), x["len"]).otherwise(0)
        r = t["r"] + F.when(both | x["op"].isin("D", "N"), x["len"]).otherwise(0)
        block = F.array(F.struct(t["q"].alias("q0"), q.alias("q1"), t["r"].alias("r0")))
        return F.struct(q.alias("q"), r.alias("r"), F.when(both, F.concat(t["out"], block)).otherwise(t["out"]).alias("out"))

    blocks = alignments.select("contig", "tid", F.col("start").alias("at"), F.inline(F.aggregate(ops, start, step, lambda t: t["out"])))
    met = hits.join(blocks, "contig").where("qpos >= q0 and qpos < q1")
    lifted = met.select("tid", (F.col("at") + F.col("r0") + F.col("qpos") - F.col("q0")).alias("start"), "len", "score").withColumn("end", F.col("start") + F.col("len"))
    return merge_intervals(lifted, aggs=[F.max("score").alias("best_score")]).select("tid", "start", "end", "best_score", "n")
