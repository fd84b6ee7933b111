"""Exact quantiles of counted values, without a list of all values in one place."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins that each pass cuts each open range into, and the distinct values up to which one task's list is small (some 100 MB).
BINS, FEW = 4096, 1 << 20


def quantiles(values: DataFrame, shares: list[float]) -> list[float | None]:
    """The quantiles of (v, n), n counting v, interpolated between neighbours as Spark's percentile does; None where there are no values.

    Each pass counts the values of the ranges that hold a wanted rank in BINS bins, of which only the wanted ones stay, as
    narrow as their own least and largest value. A bin of one value is an answer. Nothing but counts of bins reaches the
    driver, at most 2 x BINS for each quantile and pass; passes are few, since a range shrinks by BINS at least.
    """
    whole = values.agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("distinct")).first()
    if not whole.n:
        return [None] * len(shares)
    if whole.distinct <= FEW:
        return list(values.agg(F.percentile("v", [float(s) for s in shares], F.col("n"))).first()[0])
    places = [(whole.n - 1) * s for s in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    found: dict[int, float] = {}
    if whole.lo == whole.hi:
        return [whole.lo] * len(shares)
    ranges = [(whole.lo, whole.hi, 0, ranks)]  # least and largest value, values before, wanted ranks
    while ranges:
        nth, bin_ = F.lit(None).cast("int"), F.lit(None).cast("int")
        for k, (lo, hi, _, _) in enumerate(ranges):
            within = (F.col("v") >= lo) & (F.col("v") <= hi)
            size = hi - lo
            share = (F.col("v") - lo) / size if math.isfinite(size) else (F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2)
            nth, bin_ = F.when(within, k).otherwise(nth), F.when(within, F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")).otherwise(bin_)
        rows = values.select("v", "n", nth.alias("nth"), bin_.alias("bin")).where("nth is not null")
        got = rows.groupBy("nth", "bin").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        new = []
        for k, (_, _, before, wanted) in enumerate(ranges):
            at = before
            for r in sorted((r for r in got if r.nth == k), key=lambda r: r.bin):
                mine = [x for x in wanted if at <= x < at + r.n]
                if mine and r.lo == r.hi:
                    found |= dict.fromkeys(mine, r.lo)
                elif mine:
                    new.append((r.lo, r.hi, at, mine))
                at += r.n
        ranges = new
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places]
