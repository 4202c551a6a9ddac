"""Spectra: segments are windows, each gives a periodogram, and Spark averages them by frequency."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .series import window_series, with_statistics
from .transforms import REALS, add_columns, lists, matrix


def taper_expr(kind: str, i: Column, size: int) -> Column:
    """The symmetric taper's value at place i."""
    c = F.cos(2 * math.pi * i / float(size - 1))
    if kind not in ("hann", "hamming", "rect"):
        raise ValueError(f"unknown taper {kind!r}")
    return {"hann": 0.5 - 0.5 * c, "hamming": 0.54 - 0.46 * c, "rect": F.lit(1.0)}[kind]


def taper(kind: str, size: int) -> np.ndarray:
    c = np.cos(2 * np.pi * np.arange(size) / (size - 1))
    if kind not in ("hann", "hamming", "rect"):
        raise ValueError(f"unknown taper {kind!r}")
    return {"hann": 0.5 - 0.5 * c, "hamming": 0.54 - 0.46 * c, "rect": np.ones(size)}[kind]


def welch_psd(t: DataFrame, size: int, fs: float = 1000.0, overlap: float = 0.5, kind: str = "hann") -> DataFrame:
    """series_id, bin, f, p: mean power by frequency over tapered segments; the series' mean is removed, no doubling.

    Sums by bin are formed within tasks before the shuffle, so it moves a row per bin and task.
    """
    mean = t.groupBy("series_id").agg(F.avg("value").alias("_mean"))
    centred = with_statistics(t, mean).select("series_id", "pos", (F.col("value") - F.col("_mean")).alias("value"))
    segments = window_series(centred, size, max(1, round(size * (1 - overlap))))
    w = taper(kind, size)
    bins = size // 2 + 1

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"_p": lists(np.abs(np.fft.rfft(matrix(b.column("x")) * w, axis=1)[:, :bins]) ** 2 / (fs * (w**2).sum()))}

    rows = add_columns(segments, {"_p": REALS}, run).select("series_id", F.posexplode("_p").alias("bin", "p"))
    return rows.groupBy("series_id", "bin").agg(F.avg("p").alias("p")).select("series_id", "bin", (F.col("bin") * (fs / 2 / (bins - 1))).alias("f"), "p")


def daniell_psd(psd: DataFrame, span: int = 7) -> DataFrame:
    """psd with p averaged over span bins to either side, fewer at the ends."""
    near = W.partitionBy("series_id").orderBy("bin").rowsBetween(-max(1, span), max(1, span))
    return psd.withColumn("p", F.avg("p").over(near))


def logbin_psd(psd: DataFrame, bins: int) -> DataFrame:
    """series_id, bin, f, p: medians over equal half-open bins of log10 f (so the top frequency falls out)."""
    logs = psd.where("f > 0").withColumn("lf", F.log10("f"))
    ends = logs.groupBy("series_id").agg(F.min("lf").alias("lo"), F.max("lf").alias("hi"))
    rows = logs.join(ends, "series_id").withColumn("bin", F.floor((F.col("lf") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("int")).where(F.col("bin") < bins)
    return rows.groupBy("series_id", "bin").agg(F.pow(F.lit(10.0), F.avg("lf")).alias("f"), F.expr("percentile(p, 0.5)").alias("p"))


def spectral_slope(psd: DataFrame, share: float = 0.1) -> DataFrame:
    """series_id, beta, intercept, n: log-log slope over the lowest max(5, share) of the frequencies above zero.

    The intercept runs through the first point.
    """
    rows = psd.where("f > 0").withColumn("_i", F.row_number().over(W.partitionBy("series_id").orderBy("f"))).withColumn("_n", F.count("*").over(W.partitionBy("series_id")))
    rows = rows.where(F.col("_i") <= F.greatest(F.lit(5), F.bround(F.col("_n") * share))).where("p > 0")
    x, y = F.log10("f"), F.log10("p")
    fit = rows.groupBy("series_id").agg(F.regr_slope(y, x).alias("beta"), F.min_by(F.struct(x.alias("x"), y.alias("y")), "_i").alias("_first"), F.count("*").alias("n"))
    return fit.select("series_id", "beta", (F.col("_first.y") - F.col("beta") * F.col("_first.x")).alias("intercept"), "n")


def simple_periodogram(windows: DataFrame) -> DataFrame:
    """windows with power: |rfft|^2 / n of the centred window, without the zero frequency."""

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        x = matrix(b.column("x"))
        return {"power": lists(np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)[:, 1:]) ** 2 / x.shape[1])}

    return add_columns(windows, {"power": T.ArrayType(T.DoubleType())}, run)
