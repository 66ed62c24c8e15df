"""Twin windows: how many barcodes two neighbouring windows share, and how many are expected."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.reads import usable
from strandloom.operators.depth import densify, read_depth, weighted_centroid
from strandloom.operators.intervals import expand_runs, running_counts
from strandloom.operators.ranks import quantiles
from strandloom.session import stash


#: Bins of a tile, whose events one task sorts.
TILE = 1 << 16


def twin_windows(reads: DataFrame, contigs: DataFrame, window: int = 10_000, shift: int = 100, min_mapq: int = 20) -> DataFrame:
    """``tid, idx, n1, n2, n0``: barcodes with a read in the window left of bin idx, right of it, and in both.

    A barcode's reads form islands whose windows are ranges of bins; each range is two events, so the
    work follows the reads and not reads times bins. Bins that no window reaches are left out.
    """
    n = window // shift
    bins = reads.where(usable()).where((F.col("mapq") >= min_mapq) & F.col("bcd").isNotNull()).select("tid", "bcd", F.floor(F.col("start") / shift).alias("b")).distinct()
    w = Window.partitionBy("tid", "bcd").orderBy("b")
    rows = bins.select("tid", "b", F.lag("b").over(w).alias("p"), F.lead("b").over(w).alias("q"))
    opens, closes = (F.coalesce(gap >= n, F.lit(True)) for gap in (F.col("b") - F.col("p"), F.col("q") - F.col("b")))
    event = lambda at, n1, n2, n0: F.struct(at.alias("idx"), *[F.lit(v).cast("long").alias(c) for c, v in (("n1", n1), ("n2", n2), ("n0", n0))])
    # right windows begin n - 1 bins before an island and end with it, left ones begin after its first bin and end n after its last
    begin, end, after = F.col("b") - n + 1, F.col("b") + 1, F.col("b") + n + 1
    both = opens & closes
    shared = closes & (F.col("q") - n + 1 < after)
    events = F.array_compact(F.array(
        F.when(opens, event(begin, 0, 1, 0)), F.when(both, event(end, 1, -1, 0)).when(opens, event(end, 1, 0, 1)).when(closes, event(end, 0, -1, -1)),
        F.when(shared, event(after, -1, 0, -1)).when(closes, event(after, -1, 0, 0)), F.when(shared, event(F.col("q") - n + 1, 0, 0, 1)),
    ))
    runs = running_counts(rows.select("tid", F.inline(events)), ["tid"], ["n1", "n2", "n0"], TILE)
    ends = F.broadcast(contigs.select("tid", F.floor(F.col("length") / shift).alias("last")))
    runs = runs.join(ends, "tid").withColumn("idx", F.greatest("idx", F.lit(0).cast("long"))).withColumn("to", F.least("to", F.col("last"))).where("idx <= `to`").drop("last")
    return expand_runs(runs).select("tid", "idx", "n1", "n2", "n0")


def robust(df: DataFrame, col: str) -> tuple[float, float, float]:
    """Median, and the distances to the 84.13th and 15.87th percentiles: six values at most to the driver."""
    q = quantiles(df, col, [0.5, 0.8413, 0.1587]) or [0.0, 0.0, 0.0]
    return q[0], q[1] - q[0], q[0] - q[2]


def bounds(windows: DataFrame, col: str, wgs: bool = True) -> tuple[float, float]:
    mid, right, left = robust(windows.where(F.col(col) > 0), col)
    if not wgs:
        return mid / 3, mid * 3
    return max(mid - 3 * left, mid / 3), min(mid + 3 * right, mid * 3)


def fit_model(windows: DataFrame, limits: dict[str, tuple[float, float]]) -> tuple[float, float, float, float]:
    """Intercept and slopes of ln n0 on ln n1, ln n2 and the centroids' distance, by least squares.

    Means and covariances, 13 numbers, come from one aggregate; what does not vary gets no slope.
    """
    rows = in_limits(windows, limits).where("n0 >= 1")
    x = [F.log("n1"), F.log("n2"), F.col("c2") - F.col("c1"), F.log("n0")]
    pairs = [(i, j) for i in range(4) for j in range(i, 4) if i < 3]
    got = [v or 0.0 for v in rows.agg(*[F.avg(v).alias(f"m{k}") for k, v in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"v{i}{j}") for i, j in pairs]).first()]
    m = np.zeros((4, 4))
    for (i, j), v in zip(pairs, got[4:], strict=True):
        m[i, j] = m[j, i] = v
    scale = np.where(m.diagonal()[:3] > 0, np.sqrt(np.abs(m.diagonal()[:3])), 1.0)
    slopes = np.linalg.lstsq(m[:3, :3] / np.outer(scale, scale), m[:3, 3] / scale, rcond=None)[0] / scale
    return (float(got[3] - slopes @ np.array(got[:3])), *slopes.tolist())


def in_limits(windows: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    out = windows.where("c1 is not null and c2 is not null and n1 > 0 and n2 > 0")
    for c, (lo, hi) in limits.items():
        out = out.where(F.col(c).between(lo, hi))
    return out


@F.pandas_udf(T.DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    """The upper tail of the normal law; Spark has no erfc."""
    return pd.Series([0.5 * math.erfc(v / math.sqrt(2)) if v == v else None for v in z])


def _expected(coef: tuple[float, float, float, float]):
    return F.exp(F.lit(coef[0]) + coef[1] * F.log("n1") + coef[2] * F.log("n2") + coef[3] * (F.col("c2") - F.col("c1")))


def residual_ladder(windows: DataFrame, coef: tuple, limits: dict, base: float = 1.05) -> tuple[tuple[float, float, float], list[float]]:
    """Median and spreads of log2 of expected over seen, and its percentiles at 100 - 100 / base**i, i = 1, 2, ..."""
    rows = in_limits(windows, limits).where("n0 >= 1").select(F.log2((_expected(coef) + 1e-3) / F.col("n0")).alias("y"))
    n = rows.count()
    levels = [1 - base**-i for i in range(1, int(math.log(max(n, 2), base)))]
    mid, right, left, *ladder = quantiles(rows, "y", [0.5, 0.8413, 0.1587, *levels]) or [0.0, 0.0, 0.0]
    return (mid, right - mid, mid - left), ladder


def p_values(windows: DataFrame, coef: tuple, limits: dict, spread: tuple[float, float, float], ladder: list[float], base: float = 1.05) -> DataFrame:
    """``windows`` with ``pred``, ``mlog_p_emp`` and ``mlog_p``; windows out of the limits have -1, 0 and 0."""
    ok = F.lit(True)
    for c, (lo, hi) in limits.items():
        ok = ok & F.col(c).between(lo, hi)
    ok = ok & F.col("c1").isNotNull() & F.col("c2").isNotNull() & (F.col("n1") > 0) & (F.col("n2") > 0)
    pred = F.least(F.floor(_expected(coef) + 0.5), F.col("n1"), F.col("n2"))
    seen = F.when(F.col("n0") < 1, F.col("n0") + 0.2).otherwise(F.col("n0").cast("double"))
    out = windows.withColumn("_ok", ok).withColumn("pred", F.when(ok, pred).otherwise(-1).cast("long")).withColumn("_y", F.when(ok, F.log2((F.col("pred") + 1e-3) / seen)))

    @F.pandas_udf(T.LongType())
    def steps_upto(y: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(steps, y, side="right"))

    steps = np.sort(ladder or [0.0])
    at = F.greatest(steps_upto("_y"), F.lit(1))
    sf = F.greatest(normal_sf((F.col("_y") - spread[0]) / (spread[1] or 1.0)), F.lit(1e-100))
    out = out.withColumn("mlog_p_emp", F.when(F.col("_ok"), at * math.log10(base)).otherwise(0.0))
    return out.withColumn("mlog_p", F.when(F.col("_ok"), -F.log10(sf)).otherwise(0.0)).drop("_ok", "_y")


def barcode_overlap(reads: DataFrame, contigs: DataFrame, window: int = 10_000, shift: int = 100, wgs: bool = True) -> DataFrame:
    """The whole model: windows with centroids, fitted limits and coefficients, and each window's ``mlog_p``."""
    centroids = weighted_centroid(densify(read_depth(reads), contigs), window // shift).withColumnRenamed("bin", "idx")
    rows, _ = stash(twin_windows(reads, contigs, window, shift).join(centroids, ["tid", "idx"]), "windows")
    limits = {c: bounds(rows, c, wgs) for c in ("n1", "n2")}
    coef = fit_model(rows, limits)
    spread, ladder = residual_ladder(rows, coef, limits)
    return stash(p_values(rows, coef, limits, spread, ladder), "overlap")[0]
