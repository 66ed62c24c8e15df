"""Structural variants from linked reads: parameters fitted to the data, candidates, their evidence, and filters.

The parameters are a one-row table, estimated in two steps: the cut-offs of the gaps within first-round
fragments and between mates make the second-round fragments, whose gaps and lengths give all others.
They are the same few numbers for every later step, and reach the plans as literals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import reads as R
from strandloom.functions import scores
from strandloom.operators import calls as C
from strandloom.operators import cnv, depth, fragments, nodes
from strandloom.operators.intervals import band_join
from strandloom.session import stash

#: Levels of the geometric fit of gaps, and the quantiles of all gaps, mates' included, that stand for them.
PAIR_LEVELS = {0.90: 0.95, 0.92: 0.96, 0.94: 0.97, 0.96: 0.98, 0.98: 0.99}
#: Gaps and inner sizes above this count as this; inner sizes are shifted by INNER_SHIFT to be positive.
GAP_CAP, INNER_SHIFT = 100_000, 1_000


def round_cutoffs(reads: DataFrame, gap: int = fragments.GAP) -> DataFrame:
    """One row ``gap_cutoff, pair_cutoff``: the smallest gap within first-round fragments, and inner size of mates, that 99 % do not exceed."""
    w = Window.partitionBy("bcd", "tid", "frag").orderBy(*fragments.ORDER)
    gaps = fragments.gap_sessions(reads, gap).select((F.col("start") - F.lag("end").over(w)).alias("g")).where("g > 0")
    inner = fragments.inner_sizes(reads).select(F.least(F.greatest(F.col("inner_size") + INNER_SHIFT, F.lit(0)), F.lit(GAP_CAP)).alias("i"))
    # both are bounded integers, so that the histogram that a percentile keeps is bounded too
    a = gaps.select(F.least("g", F.lit(GAP_CAP)).alias("g")).agg(F.expr("percentile_disc(0.99) within group (order by g)").cast("int").alias("gap_cutoff"))
    b = inner.agg((F.expr("percentile_disc(0.99) within group (order by i)").cast("int") - INNER_SHIFT).alias("pair_cutoff"))
    return a.join(F.broadcast(b))


def geometric_rate(gaps: DataFrame, col: str, levels: dict[float, float]) -> DataFrame:
    """``rate``: the median over the levels of 1 - (1 - level)^(1 / (k + 1)), k being the quantile that stands for the level."""
    q = gaps.agg(F.percentile(col, list(levels.values())).alias("q"))
    each = [1 - F.pow(F.lit(1 - level), 1 / (F.get("q", k) + 1)) for k, level in enumerate(levels)]
    return q.select(F.element_at(F.array_sort(F.array(*each)), len(each) // 2 + 1).alias("rate"))


def fitted_parameters(frags: DataFrame, contigs: DataFrame, cutoffs: DataFrame, floor: int = 5000) -> DataFrame:
    """The one-row table of parameters, from second-round fragments.

    ``min_length``: N95, ``floor`` at least; all of the following come from fragments that long: their
    number, reads and barcodes, median and mean length, quantiles of the span gaps, the rate of reads a
    base, and ``cluster_cutoff``, the gap that this rate exceeds once in a hundred (5,000 at least).
    ``length_rate``, of the exponential law of lengths, comes from all fragments.
    """
    sizes = fragments.length_stats(frags)
    n95 = sizes.select(F.greatest(F.coalesce("n95", F.lit(0)), F.lit(floor)).alias("min_length"))
    long = frags.join(F.broadcast(n95)).where("length >= min_length").drop("min_length")
    gaps = long.select(F.explode(R.frag_gap_distances("map_pos")).alias("gap"))
    levels = [0.5, 0.75, 0.9, 0.95, 0.99, 0.999]
    quantiles = gaps.agg(F.percentile("gap", levels).alias("q")).select(*[F.get("q", k).alias(f"gap_p{str(v)[2:]:0<3}") for k, v in enumerate(levels)])
    lengths = long.agg(F.count(F.lit(1)).alias("n_fragments"), F.sum("num_reads").alias("n_reads"), F.count_distinct("bcd").alias("n_barcodes"), F.percentile("length", 0.5).alias("median_length"), F.avg("length").alias("mean_length"))
    rate = geometric_rate(gaps, "gap", PAIR_LEVELS).withColumnRenamed("rate", "read_rate")
    law = geometric_rate(frags, "length", {v: v for v in PAIR_LEVELS}).withColumnRenamed("rate", "length_rate")
    genome = contigs.agg(F.sum(F.col("length").cast("long")).alias("genome"))
    out = cutoffs
    for part in (sizes, n95, lengths, quantiles, rate, law, genome):
        out = out.join(F.broadcast(part))  # one row each
    return out.withColumn("cluster_cutoff", F.greatest(F.lit(5000), F.ceil(scores.max_gap_from_rate(F.col("read_rate")))).cast("int"))


@dataclass(frozen=True)
class Molecules:
    """``marked``: reads with frag_id; ``frags``: fragments; ``params``: the parameters' row, also as ``fitted``.

    Where there are no fragments to fit to, rates are 1e-4 in ``fitted`` and other numbers 1.
    """

    marked: DataFrame
    frags: DataFrame
    params: DataFrame
    fitted: dict[str, float]


def molecules(reads: DataFrame, contigs: DataFrame, min_good: int = 6, floor: int = 5000) -> Molecules:
    """Both rounds of fragments and the parameters, as written tables."""
    cutoffs, _ = stash(round_cutoffs(reads), "cutoffs")
    cut = cutoffs.first()
    marked = fragments.pair_sessions(reads, cut["gap_cutoff"] or fragments.GAP, cut["pair_cutoff"] or 0)
    marked, _ = stash(marked.withColumn("frag_id", F.xxhash64("bcd", "tid", "frag")), "marked-reads")
    frags, _ = stash(fragments.assemble(marked).where(F.col("num_good_reads") > min_good), "fragments")
    params, _ = stash(fitted_parameters(frags, contigs, cutoffs, floor), "parameters")
    fitted = {k: (1e-4 if k.endswith("_rate") else 1) if v is None else v for k, v in params.first().asDict().items()}
    return Molecules(marked, frags, params, fitted)


def pairs_with_mates(pairs: DataFrame, marked: DataFrame, key: list[str]) -> DataFrame:
    """``key`` of the pairs of fragments (``frag1, lo1, hi1, end1``, and the same of side 2) that share a read id, on each side
    within [lo, hi] and in the strand that the end type asks for: forward at an R end, reverse at an L end."""
    rows = marked.select("frag_id", "read_id", "start", R.has_flag("flag", R.REVERSE).alias("reverse"))

    def side(k: int) -> DataFrame:
        at = rows.select(F.col("frag_id").alias(f"frag{k}"), "read_id", "start", "reverse")
        met = pairs.join(at, f"frag{k}").where(F.col("start").between(F.col(f"lo{k}"), F.col(f"hi{k}")) & (F.col("reverse") == (F.col(f"end{k}") == "L_end")))
        return met.select(*key, "read_id").distinct()

    return side(1).join(side(2), [*key, "read_id"]).select(*key).distinct()


def _end(kind: str, at: int) -> Column:
    return F.when(F.substring(kind, at, 1) == "3", "R_end").otherwise("L_end")


def candidates(m: Molecules, alt: DataFrame | None = None, blacklist: DataFrame | None = None, min_support: int = 5) -> tuple[DataFrame, float]:
    """Pairs of breakpoints, and the number of pairs of fragment ends by which chance is judged.

    ``cand_id, endtype1, tid1, pos1, endtype2, tid2, pos2, n_nodes``. ``alt``: contigs (``tid``) that take
    no part; ``blacklist``: ``tid, bin`` (of 100 bases) that hold no end.
    """
    p = m.fitted
    found = fragments.pair_nodes(m.frags, int(p["min_length"]))
    if alt is not None:
        for s in "xy":
            found = found.join(alt.select(F.col("tid").alias(f"{s}_tid")), f"{s}_tid", "left_anti")
    dense, _ = stash(nodes.remove_sparse(found, int(p["cluster_cutoff"]), min_support - 1), "nodes")
    n33 = float(dense.where("end_type = '33'").count())
    if blacklist is not None:
        for s in "xy":
            dense = dense.withColumn("_b", F.floor(F.col(f"{s}_pos") / 100)).join(blacklist.select(F.col("tid").alias(f"{s}_tid"), F.col("bin").alias("_b")), [f"{s}_tid", "_b"], "left_anti").drop("_b")
    keyed = dense.withColumn("key", F.xxhash64("end_type", "frag1", "frag2"))
    members, _ = stash(nodes.cluster(keyed, "key", int(p["cluster_cutoff"]), min_support), "clusters")
    every = (F.lit(-(2**60)), F.lit(2**60))
    pairs = members.select("key", "frag1", "frag2", _end("end_type", 1).alias("end1"), _end("end_type", 2).alias("end2"), *[c.alias(n) for k in (1, 2) for c, n in zip(every, (f"lo{k}", f"hi{k}"), strict=True)])
    paired = pairs_with_mates(pairs, m.marked, ["key"]).withColumn("with_pair", F.lit(True))
    members, _ = stash(members.join(paired, "key", "left").withColumn("with_pair", F.coalesce("with_pair", F.lit(False))), "members")
    out = members.groupBy("component_id", "end_type", F.col("x_tid").alias("tid1"), F.col("y_tid").alias("tid2")).agg(F.count(F.lit(1)).alias("n_nodes"))
    for k, s in ((1, "x"), (2, "y")):
        side = F.when(F.substring("end_type", k, 1) == "3", "R").otherwise("L")
        best = nodes.predict_breakpoint(members.select("component_id", F.col(f"{s}_pos").alias("position"), side.alias("side"), "with_pair"), p["read_rate"])
        out = out.join(best.select("component_id", F.col("pos").alias(f"pos{k}")), "component_id")
    out = out.select(F.col("component_id").alias("cand_id"), _end("end_type", 1).alias("endtype1"), "tid1", "pos1", _end("end_type", 2).alias("endtype2"), "tid2", "pos2", "n_nodes")
    return stash(out, "candidates")[0], n33


def supporting_pairs(cands: DataFrame, m: Molecules, min_length: int = 2000) -> DataFrame:
    """``cand_id, bcd``, and of both sides ``frag, lo, hi, reads`` of the pieces of molecules that support a candidate.

    A side's fragments end within the 99 % gap of its breakpoint, 100 bases beyond it at most. A barcode
    with different fragments on the sides gives the one of each with most reads; a fragment that is on
    both is cut at its largest gap, if that is above the 95 % gap.
    """
    p = m.fitted
    reach = int(p["gap_p990"])
    long = m.frags.where(F.col("length") >= min_length)
    near = []
    for k in (1, 2):
        for kind, at in (("L_end", "start"), ("R_end", "end")):
            lo = F.col(f"pos{k}") - 100 if kind == "L_end" else F.col(f"pos{k}") + 1 - reach
            box = cands.where(F.col(f"endtype{k}") == kind).select("cand_id", F.col(f"tid{k}").alias("tid"), lo.alias("lo"), (lo + reach + 100).alias("hi"))
            met = band_join(long.select("tid", "start", "end", "bcd", "frag_id", "num_reads"), box, at)
            near.append(met.select(F.col("r_cand_id").alias("cand_id"), F.lit(k).alias("side"), "bcd", "frag_id", "start", "end", "num_reads"))
    every, _ = stash(near[0].unionByName(near[1]).unionByName(near[2]).unionByName(near[3]), "near-breakpoints")
    both = every.groupBy("cand_id", "frag_id").agg(F.count_distinct("side").alias("sides")).where("sides = 2").select("cand_id", "frag_id")
    apart = every.join(both, ["cand_id", "frag_id"], "left_anti")

    def best(k: int) -> DataFrame:
        order = F.struct("num_reads", -F.col("start"), "frag_id")
        top = apart.where(F.col("side") == k).groupBy("cand_id", "bcd").agg(F.max_by(F.struct("frag_id", "start", "end", "num_reads"), order).alias("f"))
        return top.select("cand_id", "bcd", *[F.col(f"f.{c}").alias(f"{n}{k}") for c, n in (("frag_id", "frag"), ("start", "lo"), ("end", "hi"), ("num_reads", "reads"))])

    two = best(1).join(best(2), ["cand_id", "bcd"])
    once = both.select("frag_id").distinct()
    cut = fragments.split_at_max_gap(m.frags.join(once, "frag_id", "left_semi"), p["gap_p950"]).where("piece > 0")
    piece = lambda k: cut.where(F.col("piece") == k).select("frag_id", F.col("start").alias(f"lo{k}"), F.col("end").alias(f"hi{k}"), F.col("num_reads").alias(f"reads{k}"))
    halves = piece(1).join(piece(2), "frag_id").join(m.frags.select("frag_id", "bcd"), "frag_id")
    one = both.join(halves, "frag_id").withColumn("frag1", F.col("frag_id")).withColumn("frag2", F.col("frag_id"))
    cols = ["cand_id", "bcd", "frag1", "lo1", "hi1", "reads1", "frag2", "lo2", "hi2", "reads2"]
    # the first piece of a cut fragment lies lower; it stands on the side of the lower breakpoint
    ordered = one.join(cands.select("cand_id", (F.col("pos1") > F.col("pos2")).alias("_swap")), "cand_id")
    swapped = ordered.select("cand_id", "bcd", *[F.when(F.col("_swap"), F.col(f"{c}{3 - k}")).otherwise(F.col(f"{c}{k}")).alias(f"{c}{k}") for k in (1, 2) for c in ("frag", "lo", "hi", "reads")])
    return stash(two.select(*cols).unionByName(swapped.select(*cols)), "supporting-pairs")[0]


def quantify(cands: DataFrame, m: Molecules, windows: DataFrame, n33: float, min_support: int = 5) -> DataFrame:
    """Scored calls with their evidence; ``windows``: ``tid, idx, mlog_p`` of the barcode overlap model.

    ``gap_score`` and ``length_score`` ask how likely one molecule would have the gaps, or the length, that
    joining the pairs implies; ``pair_score`` how likely so many barcodes share both places by chance.
    """
    p = m.fitted
    pairs = supporting_pairs(cands, m).join(cands.select("cand_id", F.col("endtype1").alias("end1"), F.col("endtype2").alias("end2"), "tid1", "tid2"), "cand_id")
    mates = pairs_with_mates(pairs, m.marked, ["cand_id", "frag1", "lo1", "frag2", "lo2"]).withColumn("mates", F.lit(1))
    pairs = pairs.join(mates, ["cand_id", "frag1", "lo1", "frag2", "lo2"], "left")
    gap = F.when(F.col("tid1") != F.col("tid2"), F.lit(1e10)).otherwise(F.greatest("lo1", "lo2") - F.least("hi1", "hi2")).cast("double")
    pairs, _ = stash(pairs.withColumn("gap", gap).withColumn("joint", F.col("hi1") - F.col("lo1") + F.col("hi2") - F.col("lo2") + F.col("gap")), "pairs")
    ends = [("start1", "lo1"), ("end1", "hi1"), ("start2", "lo2"), ("end2", "hi2")]
    sums = pairs.groupBy("cand_id").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("mates"), F.lit(0)).alias("n_mates"), F.count_if(F.col("gap") > 0).alias("n_gaps"), F.coalesce(F.sum(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(0.0)).alias("gaps"), F.sum("joint").alias("joint"),
        *[F.percentile(c, 0.5).alias(f"mid_{name}") for name, c in ends], F.array_sort(F.array_distinct(F.concat(F.collect_set("frag1"), F.collect_set("frag2")))).alias("frag_ids"), F.array_sort(F.collect_set("bcd")).alias("barcodes"),
    ).where(F.col("n") >= min_support)
    half = p["gap_p750"] / 2
    close = pairs.join(sums.select("cand_id", *[f"mid_{name}" for name, _ in ends]), "cand_id").groupBy("cand_id").agg(*[F.count_if(F.abs(F.col(c) - F.col(f"mid_{name}")) <= half).alias(f"near_{name}") for name, c in ends])
    rows = cands.join(sums, "cand_id").join(close, "cand_id")
    for k in (1, 2):
        odds = {e: scores.endpoint_log_ratio(F.col(f"near_{e}{k}"), F.col("n"), p["gap_p750"] / p["median_length"]) for e in ("start", "end")}
        rows = rows.withColumn(f"type_score{k}", F.when(F.col(f"endtype{k}") == "L_end", odds["start"] - odds["end"]).otherwise(odds["end"] - odds["start"]))
        at = windows.select(F.col("tid").alias(f"tid{k}"), F.col("idx").alias(f"_i{k}"), F.col("mlog_p").alias(f"dbo{k}"))
        rows = rows.withColumn(f"_i{k}", F.floor(F.col(f"pos{k}") / 100)).join(at, [f"tid{k}", f"_i{k}"], "left").withColumn(f"dbo{k}", F.coalesce(f"dbo{k}", F.lit(0.0))).drop(f"_i{k}")
    name = lambda k: F.concat(F.lit("chr"), (F.col(f"tid{k}") + 1).cast("string"))
    f = F.col
    kind = C.svtype_from_ends(f("endtype1"), f("endtype2"), f("tid1"), f("tid2"), f("mid_start1"), f("mid_end1"), f("mid_start2"), f("mid_end2"))
    rows = (
        rows.withColumn("gap_score", scores.one_molecule_score(f("gaps"), f("n_gaps"), p["read_rate"], float(p["n_reads"])))
        .withColumn("length_score", scores.one_molecule_score(f("joint"), f("n"), p["length_rate"], float(p["n_fragments"])))
        .withColumn("pair_score", scores.two_molecule_score(f("n"), max(n33, 1.0), float(p["genome"]), float(p["cluster_cutoff"])))
    )
    score = scores.combined_score(f("gap_score"), f("length_score"), f("pair_score"), f("n_mates"), f("dbo1"), f("dbo2"))
    rows = rows.select(
        F.xxhash64("cand_id").alias("call_id"), name(1).alias("chrom1"), f("pos1").alias("start1"), name(2).alias("chrom2"), f("pos2").alias("start2"), "tid1", "tid2", "endtype1", "endtype2", kind.alias("sv_type"), F.lit(C.PASS).alias("filter"),
        F.round(score, 3).alias("score"), "gap_score", "length_score", "pair_score", F.least("type_score1", "type_score2").alias("type_score"), "dbo1", "dbo2", f("n").cast("long").alias("n_support"), f("n_mates").cast("long").alias("n_mates"), "frag_ids", "barcodes",
    )
    return stash(rows, "quantified")[0]


def filter_low_mapq(calls: DataFrame, low: DataFrame, region: int = 10_000, most: float = 0.2, least_score: float = 20) -> DataFrame:
    """Label calls a fifth of whose barcodes have a low-quality read where the molecules should join.

    That is between the breakpoints of a deletion, and else within ``region`` beyond either of them. The
    score that is left for the other barcodes must be above ``least_score`` too. ``low``: ``bcd, tid, start, end``.
    """
    box = lambda tid, lo, hi: F.named_struct(F.lit("tid"), tid, F.lit("lo"), lo, F.lit("hi"), hi)
    at = lambda k: (F.col(f"tid{k}"), F.col(f"start{k}"), F.col(f"endtype{k}") == "L_end")
    place = lambda tid, start, left: box(tid, F.when(left, start - region).otherwise(start), F.when(left, start).otherwise(start + region))
    between = box(F.col("tid1"), F.least("start1", "start2"), F.greatest("start1", "start2"))
    boxes = F.when(F.col("sv_type") == "DEL", F.array(between)).otherwise(F.array(place(*at(1)), place(*at(2))))
    each = calls.select("call_id", F.explode("barcodes").alias("bcd"), boxes.alias("boxes")).select("call_id", "bcd", F.inline("boxes"))
    reads = low.select("bcd", "tid", F.col("start").alias("s"), F.col("end").alias("e"))
    hit = each.join(reads, ["bcd", "tid"]).where("s > lo and e < hi").select("call_id", "bcd").distinct().groupBy("call_id").agg(F.count(F.lit(1)).alias("_k"))
    share = F.coalesce(F.col("_k"), F.lit(0)) / F.col("n_support")
    good = (share < most) & (F.col("score") * (1 - share) > least_score)
    return C.label(calls.join(hit, "call_id", "left"), ~good, "LOW_MAPQ_BETWEEN_BK").select(*calls.columns)


def detect(
    reads: DataFrame,
    contigs: DataFrame,
    windows: DataFrame,
    alt: DataFrame | None = None,
    blacklist: DataFrame | None = None,
    gaps: DataFrame | None = None,
    points: DataFrame | None = None,
    min_good: int = 6,
    floor: int = 5000,
    min_support: int = 5,
    least_score: float = 20,
    low_mapq: int = 20,
) -> DataFrame:
    """All calls with their ``filter``: reads to fragments, fitted parameters, candidates, evidence, merging and filters.

    ``blacklist`` and ``gaps``: ``chrom, start, end``; ``points``: the two-dimensional blacklist.
    """
    m = molecules(reads, contigs, min_good, floor)
    bins = None
    if blacklist is not None:
        named = contigs.select("chrom", "tid").join(blacklist, "chrom")
        bins = named.select("tid", F.explode(F.sequence(F.floor(F.col("start") / 100), F.floor((F.col("end") - 1) / 100))).alias("bin")).distinct()
    cands, n33 = candidates(m, alt, bins, min_support)
    scored = quantify(cands, m, windows, n33, min_support)
    merged = C.merge_by_fragments(C.normalize_pair_order(scored.where(F.col("score") > 0)), least_score)
    found = C.filter_barcode_overlap(C.filter_length(merged))
    if blacklist is not None:
        found = C.filter_blacklist_1d(found, blacklist)
    if gaps is not None:
        found = C.gap_region_calls(found, gaps)
    found, _ = stash(found, "merged-calls")
    if points is not None:
        found = C.filter_2d(found, points)
    dense, _ = stash(depth.densify(depth.read_depth(reads), contigs), "depth")
    means = depth.genome_mean_std(dense).first()
    regions = found.where("tid1 = tid2").select("call_id", F.col("tid1").alias("tid"), F.least("start1", "start2").alias("start"), F.greatest("start1", "start2").alias("end"))
    found = C.filter_depth(found, cnv.region_depth(regions, dense), means["mean_hq"] or 0.0, means["mean"] or 0.0)
    return filter_low_mapq(found, reads.where(F.col("mapq") < low_mapq), least_score=least_score)
