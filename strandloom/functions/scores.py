"""Closed-form scores and tail probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN10 = math.log(10)


def max_gap_from_rate(p: Column | float, tail: float = 0.01) -> Column:
    """The gap that reads of rate p exceed with the tail's probability."""
    p = F.lit(p) if isinstance(p, float) else p
    return F.lit(math.log(tail)) / F.log(1 - p)


def gap_score(gap: Column, max_gap: Column | float, top: float = 1.0, ramp: float = 200.0) -> Column:
    """Up to ``top`` over [-ramp, 0), down to 0 over [0, max_gap], 0 elsewhere."""
    return F.when((gap >= 0) & (gap <= max_gap), (max_gap - gap) / max_gap * top).when((gap >= -ramp) & (gap < 0), gap * (top / ramp) + top).otherwise(0.0)


def pe_gap_score(gap: Column, max_gap: Column | float) -> Column:
    """The same shape for read pairs: up to 5 over 100 bases; the longest gap is held between 200 and 600."""
    limit = F.greatest(F.lit(200.0), F.least(F.lit(600.0), F.lit(max_gap) if isinstance(max_gap, float) else max_gap))
    return gap_score(gap, limit, 5.0, 100.0)


def log_factorial(n: Column) -> Column:
    """ln n! as a sum of logs."""
    return F.when(n < 2, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(n.cast("long"), F.lit(1).cast("long"))), F.lit(0.0), lambda t, k: t + F.log(k.cast("double"))))


def erlang_log_sf(z: Column, n: Column) -> Column:
    """ln of the chance that the sum of n unit exponentials exceeds z: -z + ln of the sum over k < n of z^k / k!."""
    # log-sum-exp with the running term ln(z^k / k!) and the running total
    start = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("total"))

    def step(t: Column, k: Column) -> Column:
        now = t["term"] + F.log(F.greatest(z, F.lit(1e-300))) - F.log(k.cast("double"))
        top = F.greatest(t["total"], now)
        return F.struct(now.alias("term"), (top + F.log1p(F.exp(F.least(t["total"], now) - top))).alias("total"))

    total = F.when(n > 1, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(n.cast("long") - 1, F.lit(1).cast("long"))), start, step, lambda t: t["total"])).otherwise(0.0)
    return -z + total


def poisson_log_pmf(k: Column, rate: Column | float) -> Column:
    rate = F.lit(rate) if isinstance(rate, float) else rate
    return k * F.log(rate) - rate - log_factorial(k)


def one_molecule_score(lengths_sum: Column, n: Column, rate: Column | float, trials: Column | float) -> Column:
    """-(log10 of the chance that n gaps of the rate's exponential law add up to more, + log10 of trials / n); 0 without gaps."""
    rate = F.lit(rate) if isinstance(rate, float) else rate
    trials = F.lit(trials) if isinstance(trials, float) else trials
    return F.when(n < 1, 0.0).otherwise(-(erlang_log_sf(lengths_sum * rate, n) / LN10 + F.log10(trials / n)))


def two_molecule_score(n: Column, n_nodes: Column | float, genome: float, cutoff: float) -> Column:
    """-(log10 of the Poisson chance of n chance pairs in a cell + log10 of the number of cells)."""
    area = (genome / cutoff) ** 2
    rate = (F.lit(n_nodes) if isinstance(n_nodes, float) else n_nodes) / area
    return -(poisson_log_pmf(n, rate) / LN10 + math.log10(area))


def combined_score(gap: Column, length: Column, two_mol: Column, n_pe: Column, dbo1: Column, dbo2: Column) -> Column:
    return F.least(F.greatest(gap, length) / 1.5, two_mol) + 3 * n_pe + dbo1 + dbo2


def endpoint_log_ratio(n_near: Column, n: Column, p_other: float, p_break: float = 0.75) -> Column:
    """log10 odds that n_near of n ends lie together at a breakpoint rather than anywhere."""
    q = max(1e-100, min(p_other, p_break))
    return n_near * (math.log10(p_break) - math.log10(q)) + (n - n_near) * (math.log10(1 - p_break) - math.log10(1 - q))


def binomial_log10_cdf(k: Column, n: Column, p: float) -> Column:
    """log10 P(X <= k), X of n trials of chance p."""
    odds = math.log(p / (1 - p))
    start = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("total"))

    def step(t: Column, i: Column) -> Column:
        now = t["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + odds
        top = F.greatest(t["total"], now)
        return F.struct(now.alias("term"), (top + F.log1p(F.exp(F.least(t["total"], now) - top))).alias("total"))

    steps = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k.cast("long"), F.lit(1).cast("long"))), start, step, lambda t: t["total"])
    return (F.when(k > 0, steps).otherwise(0.0) + n * math.log(1 - p)) / LN10
