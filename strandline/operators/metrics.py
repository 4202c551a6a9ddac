"""Quality and scaling measures of one window each, as array functions: no shuffle once windows exist.

What cannot be estimated is null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .series import EPS, let, total
from .transforms import REALS, add_columns, lists, matrix

Z95 = 1.959963984540054


def mean_square_error(r: Column, x: Column) -> Column:
    return total(F.zip_with(r, x, lambda a, b: (a - b) * (a - b))) / F.size(x)


def psnr(recon: str = "recon", x: str = "x") -> Column:
    """10 log10(peak^2 / mse) with the peak of |x|; null where the error or the peak is zero."""
    mse, peak = mean_square_error(F.col(recon), F.col(x)), F.array_max(F.transform(x, F.abs))
    return F.when((mse >= EPS) & (peak > 0), 10 * F.log10(peak * peak / F.nullif(mse, F.lit(0.0))))


def energy(x: Column) -> Column:
    return total(x, lambda v: v * v)


def parseval_error(x: str = "x") -> Column:
    """|E_x - (E_approx + sum of E_details)| / max(E_x, eps)."""
    parts = energy(F.col("approx")) + F.aggregate("details", F.lit(0.0), lambda acc, d: acc + energy(d))
    return F.abs(energy(F.col(x)) - parts) / F.greatest(energy(F.col(x)), F.lit(EPS))


def rel_l2_error(recon: str = "recon", x: str = "x") -> Column:
    gap = F.sqrt(total(F.zip_with(recon, x, lambda a, b: (a - b) * (a - b))))
    return gap / F.greatest(F.sqrt(energy(F.col(x))), F.lit(EPS))


def pr_check(recon: str = "recon", x: str = "x") -> Column:
    """Struct of mse and error: sqrt(mse) over the deviation of x, which counts as 1 below eps."""
    mse = mean_square_error(F.col(recon), F.col(x))
    n, mean = F.size(x), total(F.col(x)) / F.size(x)
    sigma = F.sqrt(F.greatest(F.try_divide(energy(F.col(x)) - n * mean * mean, (n - 1).cast("double")), F.lit(0.0)))
    return F.struct(mse.alias("pr_mse"), (F.sqrt(mse) / F.when(F.coalesce(sigma, F.lit(0.0)) < EPS, 1.0).otherwise(sigma)).alias("pr_relative_error"))


def sparsity_loss(details: str = "details") -> Column:
    """Mean |d| over all levels."""
    n = F.aggregate(details, F.lit(0), lambda acc, d: acc + F.size(d))
    return F.aggregate(details, F.lit(0.0), lambda acc, d: acc + total(d, F.abs)) / n


def level_energies(details: str = "details", low: int = 2, high: int | None = None, floor: float = 0.0) -> Column:
    """(level, log2 of the mean square) of each level from low to high whose energy is finite and above floor."""
    points = F.transform(details, lambda d, j: F.struct((j + 1).cast("double").alias("x"), (energy(d) / F.size(d)).alias("e")))
    kept = F.filter(points, lambda p: (p["x"] >= low) & (p["x"] <= (high or 10_000)) & (p["e"] > floor) & (p["e"] < float("inf")))
    return F.transform(kept, lambda p: F.struct(p["x"].alias("x"), F.log2(p["e"]).alias("y")))


def with_fit(df: DataFrame, points: Column, out: str) -> DataFrame:
    """df with the least-squares line through points: a struct n, slope, intercept, sxx, sse; slope null below two x."""
    df = let(df, _pts=points)
    df = let(df, _n=F.size("_pts"))
    mean = lambda f: F.try_divide(F.aggregate("_pts", F.lit(0.0), lambda acc, p: acc + p[f]), F.col("_n").cast("double"))
    df = let(df, _mx=mean("x"), _my=mean("y"))
    s = lambda f, g, mf, mg: F.aggregate("_pts", F.lit(0.0), lambda acc, p: acc + (p[f] - F.col(mf)) * (p[g] - F.col(mg)))
    df = let(df, _sxx=s("x", "x", "_mx", "_mx"), _sxy=s("x", "y", "_mx", "_my"), _syy=s("y", "y", "_my", "_my"))
    df = let(df, _b=F.try_divide(F.col("_sxy"), F.when(F.col("_sxx") > EPS, F.col("_sxx"))))
    fit = F.struct(F.col("_n").alias("n"), F.col("_b").alias("slope"), (F.col("_my") - F.col("_b") * F.col("_mx")).alias("intercept"), F.col("_sxx").alias("sxx"), (F.col("_syy") - F.col("_b") * F.col("_sxy")).alias("sse"))
    return let(df, **{out: fit}).drop("_pts", "_n", "_mx", "_my", "_sxx", "_sxy", "_syy", "_b")


def hurst_wavelet(df: DataFrame, low: int = 2, high: int | None = None, model: str = "fgn", details: str = "details", out: str = "H", floor: float = 0.0) -> DataFrame:
    """df with H from the slope of log2 energy on level: (slope + 1) / 2 for noise, (slope - 1) / 2 for motion (fbm)."""
    sign = {"fgn": 1, "fbm": -1}[model]
    df = with_fit(df, level_energies(details, low, high, floor), "_fit")
    return df.withColumn(out, (F.col("_fit.slope") + sign) / 2).drop("_fit")


def hurst_wavelet_ci(df: DataFrame, low: int = 2, high: int | None = None, model: str = "fgn", details: str = "details") -> DataFrame:
    """df with H, slope, intercept, residual_variance, se_slope, se_H, ci_low, ci_high and num_levels.

    The interval is H +- 1.96 standard errors, cut to [0, 1]; below three levels there is none.
    """
    sign = {"fgn": 1, "fbm": -1}[model]
    df = with_fit(df, level_energies(details, low, high), "_fit")
    variance = F.when(F.col("_fit.n") >= 3, F.greatest(F.col("_fit.sse"), F.lit(0.0)) / F.greatest(F.col("_fit.n") - 2, F.lit(1)))
    df = df.withColumn("H", (F.col("_fit.slope") + sign) / 2).withColumn("slope", F.col("_fit.slope")).withColumn("intercept", F.col("_fit.intercept"))
    df = df.withColumn("num_levels", F.col("_fit.n")).withColumn("residual_variance", variance)
    df = df.withColumn("se_slope", F.sqrt(F.try_divide(F.col("residual_variance"), F.col("_fit.sxx")))).withColumn("se_H", F.col("se_slope") / 2)
    cut = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    has = F.col("se_H").isNotNull()
    return df.withColumn("ci_low", F.when(has, cut(F.col("H") - Z95 * F.col("se_H")))).withColumn("ci_high", F.when(has, cut(F.col("H") + Z95 * F.col("se_H")))).drop("_fit")


def multifractal(df: DataFrame, low: int = 2, high: int | None = None, qs: tuple[int, ...] = tuple(range(-5, 6)), eps: float = 1e-12, details: str = "details", prefix: str = "", suffix: str = "") -> DataFrame:
    """df with alpha_min, alpha_max, alpha_width, alpha_peak, f_alpha_peak and the whole spectrum (q, zeta, alpha, f).

    Structure functions S_q are means of (|d| + eps)^q by level (q = 0: the exponential of the mean logarithm); zeta is
    minus the slope of log2 S_q on level, alpha its derivative by central differences (one-sided at the ends), and
    f = q alpha - zeta + 1. Fewer than three exponents with a slope give nulls.
    """
    shifted = F.transform(F.slice(details, low, (high or 10_000) - low + 1), lambda d: F.transform(d, lambda v: F.abs(v) + eps))
    df = let(df, _abs=F.when(F.size(details) >= low, shifted).otherwise(F.slice(shifted, 1, 0)))
    df = let(df, _mx=(F.size("_abs") - 1) / F.lit(2.0) + low)
    # every level counts for every q: eps keeps the means positive, and doubles hold them
    df = let(df, _sxx=F.aggregate(F.transform("_abs", lambda d, j: j + low - F.col("_mx")), F.lit(0.0), lambda acc, v: acc + v * v))

    def zeta(q: Column) -> Column:
        logs = F.transform("_abs", lambda d: F.when(q == 0, total(d, F.log) / F.size(d) / F.log(F.lit(2.0))).otherwise(F.log2(total(d, lambda v: F.pow(v, q)) / F.size(d))))
        moment = F.transform(logs, lambda y, j: (j + low - F.col("_mx")) * y)
        return -F.try_divide(F.aggregate(moment, F.lit(0.0), lambda acc, v: acc + v), F.nullif(F.col("_sxx"), F.lit(0.0)))

    df = let(df, _z=F.transform(F.array(*(F.lit(float(q)) for q in qs)), zeta))
    n = len(qs)
    points = []
    for i, q in enumerate(qs):
        lo, hi = max(0, i - 1), min(n - 1, i + 1)
        alpha = (F.get("_z", hi) - F.get("_z", lo)) / float(qs[hi] - qs[lo])
        points.append(F.struct(F.lit(float(q)).alias("q"), F.get("_z", i).alias("zeta"), alpha.alias("alpha"), (q * alpha - F.get("_z", i) + 1.0).alias("f")))
    name = lambda s: f"{prefix}{s}{suffix}"
    df = let(df, **{name("spectrum"): F.when(F.get("_z", 0).isNotNull(), F.array(*points))})
    spectrum = F.col(name("spectrum"))
    alphas = F.transform(spectrum, lambda p: p["alpha"])
    # largest f; of equal ones the first q
    peak = F.get(F.array_sort(F.transform(spectrum, lambda p: F.struct((-p["f"]).alias("f"), p["q"].alias("q"), p["alpha"].alias("alpha")))), 0)
    df = df.withColumn(name("alpha_min"), F.array_min(alphas)).withColumn(name("alpha_max"), F.array_max(alphas))
    df = df.withColumn(name("alpha_width"), F.col(name("alpha_max")) - F.col(name("alpha_min")))
    df = df.withColumn(name("alpha_peak"), peak["alpha"]).withColumn(name("f_alpha_peak"), -peak["f"])
    return df.drop("_abs", "_mx", "_sxx", "_z")


def hurst_loglog_level(df: DataFrame, low: int = 1, high: int | None = None, out: str = "H_loglog") -> DataFrame:
    """H as the slope of log2 energy on log2 level, less a half: another estimator than hurst_wavelet."""
    points = F.transform(level_energies("details", low, high), lambda p: F.struct(F.log2(p["x"]).alias("x"), p["y"].alias("y")))
    return with_fit(df, points, "_fit").withColumn(out, F.col("_fit.slope") - 0.5).drop("_fit")


def dfa_scales(n: int) -> list[int]:
    """Up to 12 segment lengths, even in logarithm, from 16 to the larger of 32 and n / 8."""
    lo, hi = math.log(16), math.log(max(32, n // 8))
    return list(dict.fromkeys(round(math.exp(lo + (hi - lo) * i / 11)) for i in range(12)))


def residual(s: int):
    """The mean squared residual of the k-th segment of s samples of the profile _y about its line."""
    sxx = s * (s * s - 1) / 12.0
    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("i", "y", "yy", "iy")))
    add = lambda a, v: F.struct((a["i"] + 1.0).alias("i"), (a["y"] + v).alias("y"), (a["yy"] + v * v).alias("yy"), (a["iy"] + a["i"] * v).alias("iy"))
    left = lambda a: (a["yy"] - a["y"] * a["y"] / float(s) - F.pow(a["iy"] - a["y"] * ((s - 1) / 2.0), 2) / sxx) / float(s)
    return lambda k: F.aggregate(F.slice("_y", k * s + 1, F.lit(s)), zero, add, left)


def trends(s: int, order: int) -> np.ndarray:
    """Orthonormal polynomials up to an order over s places, as columns."""
    u = (np.arange(s) - (s - 1) / 2) / s
    return np.linalg.qr(np.vander(u, order + 1, increasing=True))[0]


def detrended(y: np.ndarray, s: int, order: int) -> np.ndarray:
    """The mean squared residual of each segment of s samples of the profiles in rows about its polynomial."""
    segments = y[:, : y.shape[1] // s * s].reshape(len(y), -1, s)
    q = trends(s, order)
    return ((segments - segments @ q @ q.T) ** 2).mean(axis=2)


def dfa(windows: DataFrame, size: int, out: str = "H_dfa", order: int = 1) -> DataFrame:
    """windows with the exponent of detrended fluctuation; null below four usable scales or a zero fluctuation.

    Segments are detrended by polynomials of any order, for orders above 1 in one Arrow function.

    The profile is the running sum of the centred window; a segment's mean squared residual about its line is
    (Syy - Sxy^2 / Sxx) / s, taken from prefix sums, so each scale costs a few array reads per segment.
    """
    scales = [s for s in dfa_scales(size) if size // s >= 4]
    if order != 1:
        return dfa_of_order(windows, scales, order, out)
    # running sums of whole windows at once: growing an array in an aggregate would copy it for every sample
    centred = lambda m: m - m.mean(axis=1, keepdims=True)
    df = add_columns(windows, {"_y": REALS}, lambda b: {"_y": lists(centred(matrix(b.column("x"))).cumsum(axis=1))})
    points = []
    for s in scales:
        f2 = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(size // s - 1)), residual(s)), F.lit(0.0), lambda acc, v: acc + v) / float(size // s)
        points.append(F.struct(F.lit(float(s)).alias("s"), f2.alias("f2")))
    df = let(df, _f=F.filter(F.array(*points), lambda p: p["f2"] > 0)) if points else df.withColumn("_f", F.expr("cast(array() as array<struct<s:double,f2:double>>)"))
    df = with_fit(df, F.transform("_f", lambda p: F.struct(F.log(p["s"]).alias("x"), (F.log(p["f2"]) / 2).alias("y"))), "_fit")
    return df.withColumn(out, F.when(F.col("_fit.n") >= 4, F.col("_fit.slope"))).drop("_y", "_f", "_fit")


def dfa_of_order(windows: DataFrame, scales: list[int], order: int, out: str) -> DataFrame:
    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        x = matrix(b.column("x"))
        y = (x - x.mean(axis=1, keepdims=True)).cumsum(axis=1)
        return {"_f": lists(np.stack([detrended(y, s, order).mean(axis=1) for s in scales], axis=1) if scales else np.zeros((len(x), 0)))}

    df = add_columns(windows, {"_f": REALS}, run)
    points = F.transform("_f", lambda f, i: F.struct(F.log(F.get(F.array(*(F.lit(float(s)) for s in scales or [1])), i)).alias("x"), f.alias("f2")))
    df = let(df, _f=F.filter(points, lambda p: p["f2"] > 0))
    df = with_fit(df, F.transform("_f", lambda p: F.struct(p["x"].alias("x"), (F.log(p["f2"]) / 2).alias("y"))), "_fit")
    return df.withColumn(out, F.when(F.col("_fit.n") >= 4, F.col("_fit.slope"))).drop("_f", "_fit")


def hurst_rs(windows: DataFrame, size: int, out: str = "H_rs") -> DataFrame:
    """windows with the rescaled-range exponent: chunks of 8, 16, ... 1024 samples while eight of them fit.

    The range of a chunk's running deviation over its sample deviation, chunks without deviation left out, averaged by
    size; H is the slope of its logarithm. Fewer than two sizes give null.
    """
    sizes = [1 << i for i in range(3, 11) if 8 << i <= size]

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        x, means = matrix(b.column("x")), []
        for s in sizes:
            c = x[:, : x.shape[1] // s * s].reshape(len(x), -1, s)
            y = (c - c.mean(axis=2, keepdims=True)).cumsum(axis=2)
            spread = c.std(axis=2, ddof=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                means.append(np.nanmean(np.where(spread > 0, (y.max(axis=2) - y.min(axis=2)) / spread, np.nan), axis=1))
        rs = np.array(means).T if means else np.empty((len(x), 0))
        values = []
        for row in rs:
            ok = np.isfinite(row) & (row > 0)
            lx, ly = np.log(np.array(sizes)[ok]), np.log(row[ok])
            values.append(float(((lx - lx.mean()) * (ly - ly.mean())).sum() / ((lx - lx.mean()) ** 2).sum()) if ok.sum() >= 2 else None)
        return {out: pa.array(values if len(values) == len(x) else [None] * len(x), pa.float64())}

    return add_columns(windows, {out: T.DoubleType()}, run)


def whittle_objective(d: np.ndarray, freqs: np.ndarray, power: np.ndarray) -> np.ndarray:
    return np.log((freqs ** (2 * d[:, None]) * power).mean(axis=1)) - 2 * d * np.log(freqs).mean()


GOLDEN, SECTIONS, WIDEST = (math.sqrt(5) - 1) / 2, 60, 0.49


def whittle_frequencies(n: int) -> int:
    """How many of the lowest frequencies of n samples count: the larger of 10 and the smaller of n / 10 and sqrt(n)."""
    return min(max(10, min(n // 10, math.isqrt(n))), max(1, n // 2 - 1))


def whittle_minimum(freqs: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Per row of power the d that minimises the objective, by golden sections of (-0.49, 0.49)."""
    lo, hi = np.full(len(power), -WIDEST), np.full(len(power), WIDEST)
    for _ in range(SECTIONS):
        a, c = hi - GOLDEN * (hi - lo), lo + GOLDEN * (hi - lo)
        left = whittle_objective(a, freqs, power) < whittle_objective(c, freqs, power)
        hi, lo = np.where(left, c, hi), np.where(left, lo, a)
    return (lo + hi) / 2


def whittle_sql(points: str, keys: str) -> str:
    """(keys, H_lw) for DuckDB, by the same sections: points is a relation (keys, pts), a list of (l, p) by frequency."""
    value = lambda d: f"ln(list_sum(list_transform(pts, lambda q: power(q.l, 2 * {d}) * q.p)) / len(pts)) - 2 * {d} * logs"
    a, c = f"(hi - {GOLDEN!r} * (hi - lo))", f"(lo + {GOLDEN!r} * (hi - lo))"
    start = f"SELECT {keys}, pts, list_sum(list_transform(pts, lambda q: ln(q.l))) / len(pts) AS logs, -{WIDEST}::DOUBLE AS lo, {WIDEST}::DOUBLE AS hi, 0 AS it FROM {points}"
    step = f"SELECT {keys}, pts, logs, CASE WHEN low THEN lo ELSE {a} END AS lo, CASE WHEN low THEN {c} ELSE hi END AS hi, it + 1 AS it FROM (SELECT *, {value(a)} < {value(c)} AS low FROM lw WHERE it < {SECTIONS})"
    return f"lw AS ({start} UNION ALL {step}), lwh AS (SELECT {keys}, (lo + hi) / 2 + 0.5 AS H_lw FROM lw WHERE it = {SECTIONS})"


def local_whittle(windows: DataFrame, out: str = "H_lw") -> DataFrame:
    """windows with H = d + 1/2, se and m: d in (-0.49, 0.49) minimises the local Whittle objective.

    m is the larger of 10 and the smaller of n / 10 and sqrt(n). The minimum is found by golden sections, for all
    windows of a batch together. A window without power is null.
    """

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        x = matrix(b.column("x"))
        n = x.shape[1]
        m = whittle_frequencies(n)
        freqs = 2 * np.pi * np.arange(1, m + 1) / n
        power = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)[:, 1 : m + 1]) ** 2
        ok = power.sum(axis=1) > 0
        power[~ok] = 1.0
        h = whittle_minimum(freqs, power) + 0.5
        return {out: pa.array([float(v) if k else None for v, k in zip(h, ok)], pa.float64()), f"{out}_se": pa.array(np.full(len(x), 0.5 / math.sqrt(m))), f"{out}_m": pa.array(np.full(len(x), m, np.int64))}

    return add_columns(windows, {out: T.DoubleType(), f"{out}_se": T.DoubleType(), f"{out}_m": T.LongType()}, run)
