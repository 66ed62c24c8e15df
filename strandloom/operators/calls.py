"""Calls: pairs of breakpoints, their filters, merging and output."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.graph import connected_components
from strandloom.operators.ranks import numbered
from strandloom.session import stash

PASS = "PASS"


def svtype_from_ends(end1: Column, end2: Column, chrom1: Column, chrom2: Column, start1: Column, stop1: Column, start2: Column, stop2: Column) -> Column:
    """The type that two end types imply; starts and stops are medians of the fragments on each side."""
    return (
        F.when(chrom1 != chrom2, "TRA").when(end1 == end2, "INV")
        .when((end1 == "L_end") & (end2 == "R_end"), F.when(start1 > stop2, "DEL").otherwise("DUP"))
        .when((end1 == "R_end") & (end2 == "L_end"), F.when(stop1 > start2, "DUP").otherwise("DEL")).otherwise("UNK")
    )


def sv_length(chrom1: Column, pos1: Column, chrom2: Column, pos2: Column) -> Column:
    return F.when(chrom1 == chrom2, F.abs(pos2 - pos1))


def normalize_pair_order(calls: DataFrame) -> DataFrame:
    """Swap the sides of a call so that side 1 comes first by (chrom, start)."""
    sides = [c[:-1] for c in calls.columns if c.endswith("1") and c[:-1] + "2" in calls.columns]
    swap = F.struct("chrom1", "start1") > F.struct("chrom2", "start2")
    cols = {f"{s}{k}": F.when(swap, F.col(f"{s}{3 - k}")).otherwise(F.col(f"{s}{k}")) for s in sides for k in (1, 2)}
    return calls.select(*[cols.get(c, F.col(c)).alias(c) for c in calls.columns])


def label(calls: DataFrame, when: Column, name: str) -> DataFrame:
    """Set ``filter`` to ``name`` where the condition holds and no earlier filter does."""
    return calls.withColumn("filter", F.when((F.col("filter") == PASS) & F.coalesce(when, F.lit(False)), name).otherwise(F.col("filter")))


def filter_length(calls: DataFrame, least: int = 5000) -> DataFrame:
    return label(calls, (F.col("chrom1") == F.col("chrom2")) & (F.abs(F.col("start2") - F.col("start1")) < least), "LENGTH_FILTER")


def filter_barcode_overlap(calls: DataFrame, inv: float = 1.0, tra: float = 0.5) -> DataFrame:
    low = F.least("dbo1", "dbo2")
    return label(calls, ((F.col("sv_type") == "INV") & (low < inv)) | ((F.col("sv_type") == "TRA") & (low < tra)), "BARCODE_OVERLAP_FILTER")


def filter_blacklist_1d(calls: DataFrame, blacklist: DataFrame, size: int = 100) -> DataFrame:
    """Label calls with a breakpoint in a bin that a blacklisted interval touches. ``blacklist``: ``chrom, start, end``."""
    bad = blacklist.select("chrom", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("bin")).distinct()
    out = calls
    for k in (1, 2):
        side = bad.select(F.col("chrom").alias(f"chrom{k}"), F.col("bin").alias(f"_bin{k}"), F.lit(True).alias(f"_bad{k}"))
        out = out.withColumn(f"_bin{k}", F.floor(F.col(f"start{k}") / size)).join(side, [f"chrom{k}", f"_bin{k}"], "left")
    out = label(out, F.coalesce("_bad1", F.lit(False)) | F.coalesce("_bad2", F.lit(False)), "1D_BLACKLIST")
    return out.select(*calls.columns)


def gap_region_calls(calls: DataFrame, gaps: DataFrame, longest: int = 200_000, size: int = 10_000) -> DataFrame:
    """Label calls shorter than ``longest`` with an R end just before a gap or an L end just after one."""
    near = gaps.select("chrom", F.inline(F.array(
        F.struct(F.lit("R_end").alias("kind"), (F.col("start") - 5000).alias("lo"), (F.col("start") + 1000).alias("hi")), F.struct(F.lit("L_end").alias("kind"), (F.col("end") - 1000).alias("lo"), (F.col("end") + 5000).alias("hi"))
    )))
    near = near.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    short = (F.col("chrom1") == F.col("chrom2")) & (F.abs(F.col("start2") - F.col("start1")) < longest)
    ends = calls.where(short).select("call_id", F.inline(F.array(*[F.struct(F.col(f"chrom{k}").alias("chrom"), F.col(f"start{k}").alias("pos"), F.col(f"endtype{k}").alias("kind")) for k in (1, 2)])))
    ends = ends.withColumn("_bin", F.floor(F.col("pos") / size))
    hit = ends.join(near, ["chrom", "kind", "_bin"]).where("pos >= lo and pos < hi").select("call_id").distinct().withColumn("_hit", F.lit(True))
    return label(calls.join(hit, "call_id", "left"), F.coalesce("_hit", F.lit(False)), "GAP_REGION").select(*calls.columns)


def filter_2d(calls: DataFrame, points: DataFrame, box: int = 20_000, least: int = 20) -> DataFrame:
    """Label calls with ``least`` blacklisted points (``chrom1, chrom2, pos1, pos2``) or more in the box around them, in either order.

    The nine cells of a quarter of the box around a call's own lie within its box: where these have ``least`` points,
    nothing else is counted. Only the other calls meet the points one by one.
    """
    half, cell = box // 2, max(box // 4, 1)
    both = points.select("chrom1", "chrom2", "pos1", "pos2").unionAll(points.where("chrom1 <> chrom2 or pos1 <> pos2").select("chrom2", "chrom1", "pos2", "pos1"))
    key = ["chrom1", "chrom2", "i", "j"]
    place = lambda d, a, b: d.withColumn("i", F.floor(F.col(a) / cell)).withColumn("j", F.floor(F.col(b) / cell))
    shifted = lambda reach: F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])
    dealt = place(both, "pos1", "pos2")
    full = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("_m")).select("chrom1", "chrom2", "_m", F.inline(shifted(1)))
    full = full.groupBy(*key).agg(F.sum("_m").alias("_n")).where((F.col("_n") >= least) & F.lit(box >= 4))
    placed = place(calls.select("call_id", "chrom1", "chrom2", "start1", "start2"), "start1", "start2")
    sure = placed.join(full, key).select("call_id", "_n")
    # a box that no multiple of four makes reaches farther than two cells
    spread = placed.join(full, key, "left_anti").select("call_id", "chrom1", "chrom2", "start1", "start2", F.inline(shifted(-(-half // cell))))
    near = spread.join(dealt, key).where((F.abs(F.col("pos1") - F.col("start1")) <= half) & (F.abs(F.col("pos2") - F.col("start2")) <= half))
    counts = near.groupBy("call_id").agg(F.count(F.lit(1)).alias("_n")).unionByName(sure)
    return label(calls.join(counts, "call_id", "left"), F.col("_n") >= least, "2D_BLACKLIST").select(*calls.columns)


def filter_depth(calls: DataFrame, stats: DataFrame, mean_hq: float, mean: float) -> DataFrame:
    """Label deletions without a drop in depth and duplications without a rise. ``stats``: ``call_id, mid, low, high``."""
    del_ok = (F.col("mid") <= 0.667 * mean_hq) & (F.col("high") < mean)
    dup_ok = (F.col("mid") >= 1.25 * mean_hq) & (F.col("low") > mean)
    bad = ((F.col("sv_type") == "DEL") & ~F.coalesce(del_ok, F.lit(False))) | ((F.col("sv_type") == "DUP") & ~F.coalesce(dup_ok, F.lit(False)))
    return label(calls.join(stats, "call_id", "left"), bad, "DEPTH_FILTER").select(*calls.columns)


def same_call(a: DataFrame, b: DataFrame, near: int = 10_000, overlap: float = 0.5) -> DataFrame:
    """``a_id, b_id``: calls of one type and contig pair, breakpoints within ``near``, sharing ``overlap`` of the longer.

    All such pairs, so that the result grows with the square of a crowded place; what is shuffled and kept grows with the calls.
    """
    return _met(a, b, near, overlap).select("a_id", "b_id")


#: Cells in the side of a tile (two at least), calls in a packed row, and packed rows of a cell that are dealt as one part of it.
TILE, PACK, PART = 4, 4096, 8


def _met(a: DataFrame, b: DataFrame, near: int, overlap: float) -> DataFrame:
    """Calls meet in tiles of cells of side ``near``: the one side goes to the tiles that its cell's neighbours lie in.

    Both are dealt as packed rows, one side's calls meet the packed rows of the nine cells around their own, and only what is in
    these is compared. A crowded cell's calls are dealt to several parts of its tile, so that no task has all pairs of a crowd.
    Packed rows are written, once where both sides are one table.
    """
    names = ["call_id", "start1", "start2"]
    tile = [*_KEYS, "_ti", "_tj"]
    one, _ = stash(_packed(a, near, names), "packed-calls")
    two = one if b is a else stash(_packed(b, near, names), "packed-calls")[0]
    mine = one.select(*_KEYS, F.col("i").alias("_ai"), F.col("j").alias("_aj"), F.floor(F.col("i") / TILE).alias("_ti"), F.floor(F.col("j") / TILE).alias("_tj"), F.floor(F.col("_pack") / PART).alias("_part"), *names)
    parts = mine.groupBy(*tile).agg((F.max("_part") + 1).alias("_parts"))
    reach = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + k) / TILE) for k in (-1, 1)])))
    other = two.select(*_KEYS, F.col("i").alias("_bi"), F.col("j").alias("_bj"), reach("i").alias("_ti"), *names).select("*", reach("_bj").alias("_tj"))
    # few rows, but large ones: the planner would broadcast them
    other = other.join(parts.hint("merge"), tile).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    # the work is in the pairs and not in the bytes, so that tasks are not joined into fewer; the calls are zipped after the shuffle
    tasks, at = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*tile, "_part"]
    side = lambda p: F.inline(F.arrays_zip(*names)).alias(f"{p}_id", f"{p}1", f"{p}2")
    x = mine.repartition(tasks, *at).select(*at, "_ai", "_aj", (F.col("chrom1") != F.col("chrom2")).alias("_apart"), side("a"))
    y = other.repartition(tasks, *at).select(*at, "_bi", "_bj", F.arrays_zip(*names).alias("_b"))
    met = x.join(y.hint("merge"), at).where("abs(_ai - _bi) <= 1 and abs(_aj - _bj) <= 1")
    met = met.select("_apart", "a_id", "a1", "a2", F.inline("_b").alias("b_id", "b1", "b2"))
    return met.where(_alike(near, overlap, F.col("_apart")))


def _packed(calls: DataFrame, near: int, names: list[str]) -> DataFrame:
    """A row for up to ``PACK`` calls of a cell ``i, j``: ``_pack``, its number in the cell, and ``names`` as arrays of one order."""
    cell = [*_KEYS, "i", "j"]
    rows = calls.select(*_KEYS, *names, F.floor(F.col("start1") / near).alias("i"), F.floor(F.col("start2") / near).alias("j"))
    rows = rows.where(F.col("i").isNotNull() & F.col("j").isNotNull())
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("call_id")) - 1
    packs = rows.withColumn("_pack", F.floor(place / PACK)).groupBy(*cell, "_pack").agg(F.collect_list(F.struct(*names)).alias("_calls"))
    return packs.select(*cell, "_pack", *[F.col(f"_calls.{c}").alias(c) for c in names])


def _alike(near: int, overlap: float, apart: Column | None = None) -> Column:
    """Whether calls of one type and contig pair are the same; ``apart``, where it is known, tells that the contigs are two."""
    close = (F.abs(F.col("a1") - F.col("b1")) <= near) & (F.abs(F.col("a2") - F.col("b2")) <= near)
    lo, hi = (lambda p: F.least(f"{p}1", f"{p}2")), (lambda p: F.greatest(f"{p}1", f"{p}2"))
    shared = F.least(hi("a"), hi("b")) - F.greatest(lo("a"), lo("b"))
    longer = F.greatest(hi("a") - lo("a"), hi("b") - lo("b"))
    apart = F.col("chrom1") != F.col("chrom2") if apart is None else apart
    enough = apart | (shared >= overlap * longer)
    return close & enough


_KEYS = ["sv_type", "chrom1", "chrom2"]
#: Columns of a cell whose calls are all the same as each other.
_BOX = [*_KEYS, "_side", "_i", "_j"]


def _boxed(calls: DataFrame, near: int, overlap: float) -> DataFrame:
    """``calls`` with a cell all of whose calls are the same; calls that may differ from any other have no ``_side``.

    Ends in a cell of side s are less than s apart, so that two calls share more than the longer one's length less 2 s:
    s is ``near``, or for two places of one contig the largest halving of it at which that is enough.
    """
    length = F.abs(F.col("start2").cast("long") - F.col("start1"))
    sides = [near >> k for k in range(20) if near >> k]
    fits = F.coalesce(*[F.when(length * (1 - overlap) >= 2 * s, F.lit(s)) for s in sides])
    rows = calls.withColumn("_side", F.when(F.col("chrom1") != F.col("chrom2"), F.lit(near)).otherwise(fits))
    return rows.withColumn("_i", F.floor(F.col("start1") / F.col("_side"))).withColumn("_j", F.floor(F.col("start2") / F.col("_side")))


def _open_pairs(rows: DataFrame, near: int, overlap: float) -> DataFrame:
    """``a_group, b_group`` of same calls (``start1, start2, _group``) of different groups, if only of those around which several groups are.

    Same calls of one contig are no longer than 1 / ``overlap`` of each other, and their ends differ by less than the longer's
    length: calls are dealt to cells by the power of two of their length, of that size (``near`` at most), and by the few next ones,
    so that short calls do not meet all of a crowd. A cell around which all calls are of one group is left out.
    """
    more = math.ceil(math.log2(1 / overlap)) if overlap > 0 else None
    apart = (F.col("chrom1") != F.col("chrom2")) if more is not None else F.lit(True)
    lo, hi = (F.when(apart, F.col(f"start{k}")).otherwise(f("start1", "start2")) for k, f in ((1, F.least), (2, F.greatest)))
    level = F.when(apart, -1).otherwise(F.floor(F.log2(F.greatest(F.abs(F.col("start2").cast("long") - F.col("start1")), F.lit(1)).cast("double"))).cast("int"))
    size = F.when(F.col("_level") < 0, near).otherwise(F.least(F.pow(F.lit(2.0), F.col("_level") + 1), F.lit(float(near)))).cast("long")
    levels = F.when(F.col("_own") < 0, F.array("_own")).otherwise(F.sequence("_own", F.col("_own") + (more or 0)))
    placed = rows.withColumn("_own", level).withColumn("_level", F.explode(levels)).withColumn("i", F.floor(lo / size)).withColumn("j", F.floor(hi / size))
    placed, _ = stash(placed.select(*_KEYS, "start1", "start2", "_group", (F.col("_own") == F.col("_level")).alias("_own"), "_level", "i", "j"), "placed-calls")
    cell = [*_KEYS, "_level", "i", "j"]
    around = F.inline(F.array(*[F.struct((F.col("i") + p).alias("i"), (F.col("j") + q).alias("j")) for p in (-1, 0, 1) for q in (-1, 0, 1)]))
    spans = placed.groupBy(*cell).agg(F.min("_group").alias("lo"), F.max("_group").alias("hi"))
    mixed = spans.select(*_KEYS, "_level", "lo", "hi", around).groupBy(*cell).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select(*cell)
    # of two calls of different groups that meet, each has the other's group around it, so that both are open
    open_, _ = stash(placed.join(mixed, cell, "left_semi").distinct(), "open-calls")
    a = open_.where("_own").select(*cell, F.col("start1").alias("a1"), F.col("start2").alias("a2"), F.col("_group").alias("a_group"))
    b = open_.select(*_KEYS, "_level", around, F.col("start1").alias("b1"), F.col("start2").alias("b2"), F.col("_group").alias("b_group"))
    return a.join(b.hint("merge"), cell).where("a_group <> b_group").where(_alike(near, overlap)).select("a_group", "b_group")


def dedupe(calls: DataFrame, near: int = 10_000, overlap: float = 0.5) -> DataFrame:
    """The first call of each group of same calls, by ``call_id``.

    Calls of a cell that makes them the same are one node, its first call; nodes are compared among themselves first.
    Only calls around which several groups are left then meet one by one, in cells as small as they are
    short, those of one group not at all, so that the pairs do not grow with the square of a crowded place.
    """
    cols = ["call_id", *_KEYS, "start1", "start2"]
    boxed, _ = stash(_boxed(calls.select(*cols).dropna(), near, overlap), "boxed-calls")
    of_box = boxed.where("_side is not null").groupBy(*_BOX).agg(F.min("call_id").alias("node"))
    named = boxed.join(of_box, _BOX, "left").select(*cols, F.coalesce("node", "call_id").alias("node"))
    named, _ = stash(named, "named-calls")
    heads = named.where("call_id = node").select(*cols)
    whole = of_box.select(*_KEYS, "_side", "_i", "_j", "node").join(heads.select(F.col("call_id").alias("node"), "start1", "start2"), "node")
    beside = F.inline(F.array(*[F.struct((F.col("_i") + a).alias("_i"), (F.col("_j") + b).alias("_j")) for a, b in ((1, 0), (0, 1), (1, 1), (1, -1))]))
    other = whole.select(*_BOX, F.col("node").alias("b_id"), F.col("start1").alias("b1"), F.col("start2").alias("b2"))
    linked = whole.select(*_KEYS, "_side", F.col("node").alias("a_id"), F.col("start1").alias("a1"), F.col("start2").alias("a2"), beside).join(other, _BOX).where(_alike(near, overlap)).select("a_id", "b_id")
    loops = heads.select(F.col("call_id").alias("a_id"), F.col("call_id").alias("b_id"))
    rough, _ = stash(connected_components(linked.unionAll(loops), "a_id", "b_id"), "rough-groups")
    rows, _ = stash(named.join(rough.select("node", F.col("component").alias("_group")), "node").select(*cols, "_group"), "grouped-calls")
    pairs = _open_pairs(rows, near, overlap).select(F.least("a_group", "b_group").alias("src"), F.greatest("a_group", "b_group").alias("dst")).distinct()
    groups = rows.select(F.col("_group").alias("src"), F.col("_group").alias("dst")).distinct()
    firsts = connected_components(pairs.unionAll(groups)).select(F.col("component").alias("call_id")).distinct()
    return calls.join(firsts, "call_id", "left_semi")


def merge_callsets(first: DataFrame, second: DataFrame, near: int = 10_000, overlap: float = 0.5) -> DataFrame:
    """All of the first set, and the calls of the second that match none of it; only those without a match in a cell that makes calls the same meet the first set one by one."""
    cols = ["call_id", *_KEYS, "start1", "start2"]
    taken = _boxed(first.select(*cols), near, overlap).where("_side is not null").select(*_BOX).distinct()
    boxed = _boxed(second.select(*cols), near, overlap)
    sure = boxed.join(taken, _BOX, "left_semi").select("call_id")
    rest, _ = stash(boxed.join(taken, _BOX, "left_anti").select(*cols), "unmatched-calls")
    matched = sure.unionAll(same_call(rest, first, near, overlap).select(F.col("a_id").alias("call_id"))).distinct()
    return first.unionByName(second.join(matched, "call_id", "left_anti"))


def merge_by_fragments(calls: DataFrame, least_score: float = 20) -> DataFrame:
    """One call of each group that shares fragments: the best by score and type score, the first on ties.

    Two calls belong together if they share half of the fragments (``frag_ids``) of the smaller one.
    """
    ids = calls.select("call_id", F.size("frag_ids").alias("n"), F.explode("frag_ids").alias("f"))
    other = ids.select(F.col("call_id").alias("b"), F.col("n").alias("nb"), "f")
    shared = ids.join(other, "f").where("call_id < b").groupBy("call_id", "b", "n", "nb").agg(F.count(F.lit(1)).alias("k"))
    edges = shared.where(2 * F.col("k") >= F.least("n", "nb")).select(F.col("call_id").alias("src"), F.col("b").alias("dst"))
    every = calls.select(F.col("call_id").alias("src"), F.col("call_id").alias("dst"))
    comps = connected_components(edges.unionAll(every))
    rows = calls.join(comps.withColumnRenamed("node", "call_id"), "call_id")
    best = rows.groupBy("component").agg(F.max_by("call_id", F.struct(F.col("score") * 1e4 + F.col("type_score"), -F.col("call_id"))).alias("call_id"), F.count(F.lit(1)).alias("n_merged"))
    return calls.join(best.select("call_id", "n_merged"), "call_id").where(F.col("score") >= least_score)


def bedpe_rows(calls: DataFrame, prefix: str = "ID") -> DataFrame:
    """The twelve columns of the passing calls; ids are counted over all calls, zero-padded to one digit more than needed."""
    total = calls.agg((F.floor(F.log10(F.greatest(F.count(F.lit(1)), F.lit(1)))) + 2).cast("int").alias("_w"))
    rows = numbered(calls, ["chrom1", "start1", "chrom2", "start2", "sv_type", "call_id"], "_n").join(F.broadcast(total))
    sv_id = F.concat(F.lit(prefix), F.lpad(F.col("_n").cast("string"), F.col("_w"), "0"))
    length = F.coalesce(sv_length(F.col("chrom1"), F.col("start1"), F.col("chrom2"), F.col("start2")).cast("string"), F.lit("N.A."))
    return rows.where(F.col("filter") == PASS).select(
        "chrom1", "start1", (F.col("start1") + 1).alias("end1"), "chrom2", "start2", (F.col("start2") + 1).alias("end2"),
        "sv_type", sv_id.alias("sv_id"), length.alias("sv_length"), "score", "filter", F.concat(F.lit("SVMETHOD=LINKED_READS;CALL="), F.col("call_id").cast("string")).alias("info"),
    )


def write_bedpe(calls: DataFrame, path: str) -> None:
    bedpe_rows(calls).write.mode("overwrite").option("sep", "\t").option("header", False).csv(path)
