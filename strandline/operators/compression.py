"""Compression by keeping the largest detail coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import let

RETAINS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8)


def retain_sweep(df: DataFrame, retains: tuple[float, ...] = RETAINS) -> DataFrame:
    """A row of df for each share to retain; retain_ppm is its exact key."""
    out = df.withColumn("retain", F.explode(F.array(*(F.lit(float(r)) for r in retains))))
    return out.withColumn("retain_ppm", F.bround(F.col("retain") * 1e6).cast("int"))


def ranked(d: Column) -> Column:
    """(-|d|, place) of an array in ascending order: largest first, of equal ones the first."""
    return F.array_sort(F.transform(d, lambda v, i: F.struct((-F.abs(v)).alias("a"), i.alias("i"))))


def threshold_per_level(coefs: DataFrame, retains: tuple[float, ...] = RETAINS) -> DataFrame:
    """coefs for each share with `kept_details` (the rest zero), kept and total; levels are ranked once for all shares.

    Of a level with n coefficients ceil(retain * n) stay, computed in floating point; the approximation stays whole.
    """
    out = let(coefs, _ranked=F.transform("details", ranked))
    out = retain_sweep(out, retains)
    keep = lambda d: F.least(F.size(d), F.greatest(F.lit(0), F.ceil(F.col("retain") * F.size(d)).cast("int")))
    out = let(out, _cut=F.transform("_ranked", lambda r: F.when(keep(r) > 0, F.get(r, keep(r) - 1))))
    out = let(out, kept_details=F.transform("details", lambda d, j: F.transform(d, lambda v, i: F.when(F.struct((-F.abs(v)).alias("a"), i.alias("i")) <= F.get("_cut", j), v).otherwise(0.0))))
    count = lambda f: F.aggregate("details", F.lit(0), lambda acc, d: acc + f(d))
    return out.withColumn("kept", count(keep)).withColumn("total", count(F.size)).drop("_ranked", "_cut")


def threshold_global(coefs: DataFrame, retains: tuple[float, ...] = RETAINS) -> DataFrame:
    """The same with one pool over all levels: max(1, round(retain * total)) stay, all from a share of 1 on."""
    pool = F.flatten(F.transform("details", lambda d, j: F.transform(d, lambda v, i: F.struct((-F.abs(v)).alias("a"), j.alias("j"), i.alias("i")))))
    out = let(coefs, _ranked=F.array_sort(pool), total=F.aggregate("details", F.lit(0), lambda acc, d: acc + F.size(d)))
    out = retain_sweep(out, retains)
    kept = F.when(F.col("retain") >= 1, F.col("total")).otherwise(F.greatest(F.lit(1), F.bround(F.col("retain") * F.col("total")).cast("int")))
    out = let(out, kept=F.least(kept, F.col("total")))
    out = let(out, _cut=F.get("_ranked", F.col("kept") - 1))
    zeroed = F.transform("details", lambda d, j: F.transform(d, lambda v, i: F.when(F.struct((-F.abs(v)).alias("a"), j.alias("j"), i.alias("i")) <= F.col("_cut"), v).otherwise(0.0)))
    return let(out, kept_details=zeroed).drop("_ranked", "_cut")
