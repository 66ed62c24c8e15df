"""Places and running sums over a total order of all rows, without one task that holds them all.

The rows are dealt to ranges of the order and written; each range counts by itself, and starts from
the sum of the ranges before it, of which there is one row a range.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import stash


#: Stretches of the values in which quantiles are looked for first.
STRETCHES = 1 << 14


def running_before(df: DataFrame, order: list[str], amount: str | None = None, name: str = "before") -> DataFrame:
    """``df`` with ``name`` (long): the sum of ``amount`` (default: the number of rows) over the rows before, nulls first.

    Rows that tie in ``order`` follow each other in no fixed order.
    """
    value = F.lit(1) if amount is None else F.coalesce(F.col(amount), F.lit(0))
    ranged, _ = stash(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).withColumn("_amount", value.cast("long")), "ranged")
    sums = ranged.groupBy("_range").agg(F.sum("_amount").alias("_s"))
    offsets = sums.select("_range", (F.sum("_s").over(Window.orderBy("_range")) - F.col("_s")).alias("_offset"))  # one row a range
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.withColumn("_upto", F.sum("_amount").over(within)).join(F.broadcast(offsets), "_range")
    return rows.withColumn(name, F.col("_offset") + F.col("_upto") - F.col("_amount")).drop("_range", "_amount", "_upto", "_offset")


def numbered(df: DataFrame, order: list[str], name: str = "n", first: int = 1) -> DataFrame:
    """``df`` with its places in the order, counted from ``first``."""
    return running_before(df, order, None, name).withColumn(name, F.col(name) + first)


def quantiles(df: DataFrame, col: str, levels: list[float]) -> list[float]:
    """The exact values at shares of all rows, interpolated between two places as ``percentile`` does; empty for no rows.

    Values are counted in equal stretches between the least and the largest, which gives the stretches that hold the
    places asked for; only their values are then put in order, over ranges. No task holds all values, and only the counts of
    the stretches and the rows at the places, two a level at most, come to the driver. Nulls do not count.
    """
    rows, _ = stash(df.where(F.col(col).isNotNull()).select(F.col(col).alias("_v")), "values")
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("_v"), F.max("_v")).first()
    if not n or not levels:
        return []
    spots = [(n - 1) * p for p in levels]
    wanted = sorted({place for s in spots for place in (math.floor(s), math.ceil(s))})
    value = F.col("_v").cast("double")
    even = math.isfinite(float(high) - float(low)) and low < high
    # a value that is no number lies beyond the last stretch
    rows = rows.withColumn("_b", F.coalesce(F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(STRETCHES)), F.lit(STRETCHES + 1)).cast("long") if even else F.lit(0).cast("long"))
    asked, before, kept = [], 0, 0
    for b, size in sorted(tuple(r) for r in rows.groupBy("_b").count().collect()):
        here = wanted[bisect.bisect_left(wanted, before) : bisect.bisect_left(wanted, before + size)]
        asked += [(b, place, place - before + kept) for place in here]
        before, kept = before + size, kept + size * bool(here)
    spark = df.sparkSession
    places = spark.createDataFrame(asked, "_b long, _place long, _at long")
    counts = rows.join(F.broadcast(places.select("_b").distinct()), "_b", "left_semi").groupBy("_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    found = running_before(counts, ["_b", "_v"], "_n", "_first").join(F.broadcast(places), "_b").where("_first <= _at and _at < _first + _n").select("_place", "_v").collect()
    at = {r["_place"]: float(r["_v"]) for r in found}
    ends = [(s, at[math.floor(s)], at[math.ceil(s)]) for s in spots]
    return [lo if lo == hi else (math.ceil(s) - s) * lo + (s - math.floor(s)) * hi for s, lo, hi in ends]
