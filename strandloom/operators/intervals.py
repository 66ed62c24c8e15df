"""Interval tables: overlap joins through coarse bins, merging, and delta counts.

A plain range predicate makes Spark compare all pairs. Here both sides are dealt to bins of the
genome and joined on (contig, bin); a pair counts in the first bin that both have, so it is found
once and no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import stash

BIN = 10_000
#: Places of a contig that one task may count at once.
TILE = 1 << 20


def _bins(df: DataFrame, key: str, start: str, end: str, size: int, out: str) -> DataFrame:
    lo, hi = F.floor(F.col(start) / size), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / size)
    return df.withColumn(f"{out}0", lo).withColumn(out, F.explode(F.sequence(lo, hi)))


def overlap_join(a: DataFrame, b: DataFrame, size: int = BIN, how: str = "overlap") -> DataFrame:
    """All pairs of half-open intervals (``tid, start, end``) that overlap; b's columns get the prefix ``b_``.

    ``how="contain"``: b lies within a. Empty intervals and null bounds meet nothing.
    """
    right = b.select(*[F.col(f"`{c}`").alias(f"b_{c}") for c in b.columns])
    x = _bins(a.where("start < `end`"), "tid", "start", "end", size, "_ka")
    y = _bins(right.where("b_start < b_end"), "b_tid", "b_start", "b_end", size, "_kb")
    on = (x["tid"] == y["b_tid"]) & (x["_ka"] == y["_kb"]) & (F.greatest("_ka0", "_kb0") == F.col("_ka")) & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    if how == "contain":
        on = on & (F.col("b_start") >= F.col("start")) & (F.col("b_end") <= F.col("end"))
    return x.join(y, on).drop("_ka", "_ka0", "_kb", "_kb0")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], size: int = BIN, anti: bool = False) -> DataFrame:
    """Rows of a, named by ``keys``, that overlap any interval of b (or none)."""
    hits = overlap_join(a.select(*keys, *[c for c in ("tid", "start", "end") if c not in keys]), b.select("tid", "start", "end"), size).select(*keys).distinct()
    return a.join(hits, keys, "left_anti" if anti else "left_semi")


def points_in_regions(points: DataFrame, regions: DataFrame, pos: str, keys: list[str], size: int = BIN) -> DataFrame:
    """Rows whose position lies in a half-open region of their contig."""
    at = points.select(*keys, *([] if "tid" in keys else ["tid"]), F.col(pos).alias("_p")).withColumn("_k", F.floor(F.col("_p") / size))
    reg = _bins(regions.select(F.col("tid").alias("r_tid"), F.col("start").alias("r_start"), F.col("end").alias("r_end")).where("r_start < r_end"), "r_tid", "r_start", "r_end", size, "_kr")
    hits = at.join(reg, (at["tid"] == reg["r_tid"]) & (at["_k"] == reg["_kr"]) & (F.col("_p") >= F.col("r_start")) & (F.col("_p") < F.col("r_end"))).select(*keys).distinct()
    return points.join(hits, keys, "left_semi")


def band_join(points: DataFrame, ranges: DataFrame, pos: str, size: int = BIN) -> DataFrame:
    """Each point with each closed range [lo, hi] of its contig that holds it; ranges get the prefix ``r_``."""
    right = ranges.select(*[F.col(f"`{c}`").alias(f"r_{c}") for c in ranges.columns])
    right = right.withColumn("_kr", F.explode(F.sequence(F.floor(F.col("r_lo") / size), F.floor(F.col("r_hi") / size))))
    left = points.withColumn("_k", F.floor(F.col(pos) / size))
    return left.join(right, (left["tid"] == right["r_tid"]) & (left["_k"] == right["_kr"]) & F.col(pos).between(F.col("r_lo"), F.col("r_hi"))).drop("_k", "_kr")


def tiled(rows: DataFrame, by: list[str], place: str, facts: list[Column], running: list[Column], tile: int) -> DataFrame:
    """``rows`` with ``_tile`` and, from the tiles of a contig (one row each), ``running`` expressions over their ``facts``.

    A contig is cut into tiles so that no task holds the whole of it: what holds along the contig is
    counted within a tile and carried from tile to tile. The rows are written, as they are read twice.
    """
    rows, _ = stash(rows.withColumn("_tile", F.floor(F.col(place) / tile)), "tiled")
    tiles = rows.groupBy(*by, "_tile").agg(*facts).select(*by, "_tile", *running)
    mine = tiles.select(*[F.col(c).alias(f"_of_{c}") for c in (*by, "_tile")], *[c for c in tiles.columns if c not in (*by, "_tile")])
    on = F.lit(True)
    for c in (*by, "_tile"):
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(mine, on).drop(*[f"_of_{c}" for c in (*by, "_tile")])


def with_halo(rows: DataFrame, place: str, before: int, after: int, tile: int = TILE) -> DataFrame:
    """``rows`` with ``_tile`` and ``_own``: those within ``before`` places ahead of a tile, or ``after`` behind it, stand in it once more as not its own.

    A frame that reaches no farther can then run by (contig, tile), so that no task holds a whole contig.
    """
    own, at = F.floor(F.col(place) / tile), F.col(place) % tile
    copies = F.array(F.struct(own.alias("_tile"), F.lit(True).alias("_own")), F.when(at >= tile - before, F.struct((own + 1).alias("_tile"), F.lit(False).alias("_own"))), F.when(at < after, F.struct((own - 1).alias("_tile"), F.lit(False).alias("_own"))))
    return rows.select("*", F.inline(F.array_compact(copies)))


def merge_intervals(df: DataFrame, by: list[str] | None = None, gap: int = 0, aggs: list[Column] | None = None, tile: int = TILE) -> DataFrame:
    """Intervals of each contig that touch or overlap (or lie within ``gap``), as one: ``start, end, n``."""
    by = by or ["tid"]
    along = Window.partitionBy(*by).orderBy("_tile")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    rows = tiled(df, by, "start", [F.max("end").alias("_m")], [F.max("_m").over(before).alias("_reach")], tile)
    w = Window.partitionBy(*by, "_tile").orderBy("start", "end")
    reach = F.greatest(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_reach")
    rows = rows.withColumn("_new", F.when(F.col("start") <= reach + gap, 0).otherwise(1)).drop("_reach", "_tile")
    rows = tiled(rows, by, "start", [F.sum("_new").alias("_m")], [F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_earlier")], tile)
    # of rows that tie the first is new, as it was before
    w = Window.partitionBy(*by, "_tile").orderBy("start", "end", F.desc("_new"))
    rows = rows.withColumn("_island", F.col("_earlier") + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), *(aggs or [])).drop("_island")


def delta_counts(df: DataFrame, lo: str, hi: str, by: list[str], weights: dict[str, Column], tile: int = TILE) -> DataFrame:
    """For each index of the closed ranges [lo, hi]: the sum of each weight over the ranges that hold it.

    A range adds its weight at lo and takes it back after hi; running sums between these events give
    the counts, so a range of any width costs two rows. Returns runs ``idx, to`` (closed) with the sums,
    without those in which all are zero.
    """
    part = df.select(*by, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), *[w.alias(n) for n, w in weights.items()]).where("_lo <= _hi")
    events = part.select(*by, F.inline(F.array(*[F.struct(at.cast("long").alias("idx"), *[(F.col(n) * sign).alias(n) for n in weights]) for at, sign in ((F.col("_lo"), 1), (F.col("_hi") + 1, -1))])))
    return running_counts(events, by, list(weights), tile)


def running_counts(events: DataFrame, by: list[str], names: list[str], tile: int = TILE) -> DataFrame:
    """Runs ``idx, to`` (closed) with the sums of ``names`` over all events at or before them, without those in which all are zero.

    Events of one place are not summed up first: they are spread over many tasks, and a map of their places would
    be as large as the events. Of those of one place the last has the sum.
    """
    along = Window.partitionBy(*by).orderBy("_tile")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    facts = [F.min("idx").alias("_first"), *[F.sum(n).alias(f"_t_{n}") for n in names]]
    carried = [F.lead("_first").over(along).alias("_next"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in names]]
    events = tiled(events, by, "idx", facts, carried, tile)
    w = Window.partitionBy(*by, "_tile").orderBy("idx")
    upto = [(F.col(f"_b_{n}") + F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias(n) for n in names]
    run = events.select(*by, "idx", (F.coalesce(F.lead("idx").over(w), "_next") - 1).alias("to"), *upto)
    some = F.lit(False)
    for n in names:
        some = some | (F.col(n) != 0)
    return run.where(some & (F.col("idx") <= F.col("to")))


def expand_runs(runs: DataFrame) -> DataFrame:
    """One row for each index of each run."""
    rest = [c for c in runs.columns if c not in ("idx", "to")]
    return runs.select(*rest, F.explode(F.sequence("idx", "to")).alias("idx"))


def overlap_length(a: DataFrame, b: DataFrame, keys: list[str], size: int = BIN) -> DataFrame:
    """``keys, covered``: the summed overlap of each row of a with all of b; 0 where there is none."""
    met = overlap_join(a, b, size).groupBy(*keys).agg(F.sum(F.least("end", "b_end") - F.greatest("start", "b_start")).alias("covered"))
    return a.select(*keys).distinct().join(met, keys, "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))


def venn(sets: list[DataFrame], window: int = 0) -> DataFrame:
    """Merge several interval sets, widened by ``window``: ``label`` (bit k: set k takes part), ``n`` regions, ``bases``."""
    rows = None
    for k, s in enumerate(sets):
        part = s.select("tid", (F.col("start") - window).alias("start"), (F.col("end") + window).alias("end"), F.lit(1 << k).alias("bit"))
        rows = part if rows is None else rows.unionAll(part)
    merged = merge_intervals(rows, aggs=[F.bit_or("bit").alias("label")])
    return merged.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("bases"))
