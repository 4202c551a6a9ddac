"""Wavelet decompositions of windows.

A decomposed window has `approx` (array) and `details` (array of arrays; level 1, the finest, first). Two-tap banks,
Haar among them, are Spark array functions; longer filters are one Arrow function over all windows of a batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.wavelets import analyze, canonical, levels_of, synthesize
from .series import let

R = math.sqrt(0.5)
HAAR = ((R, R), (R, -R))


def bank(level: int, filters: str | None) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """Filters h and g of a level: Haar's, or those in a column array<struct<h: array, g: array>>."""
    if filters is None:
        return tuple(tuple(F.lit(v) for v in f) for f in HAAR)
    at = F.get(filters, level - 1)
    return tuple((F.get(at[k], 0), F.get(at[k], 1)) for k in ("h", "g"))


def two_tap_analyze(windows: DataFrame, levels: int, filters: str | None = None) -> DataFrame:
    """windows with approx and details of `levels` levels; each length must be divisible by two that often.

    Haar is one fold over the levels, which keeps the plan short; a bank of columns gets a projection for each level, as
    its filters would be looked up for every element.
    """
    if filters is None:
        return haar_analyze(windows, levels)
    out = let(windows, _a=F.col("x"))
    for j in range(1, levels + 1):
        h, g = bank(j, filters)
        pairs = F.sequence(F.lit(0), F.expr("int(size(_a) div 2) - 1"))
        out = let(out, _p=F.transform(pairs, lambda i: F.struct(F.get("_a", 2 * i).alias("u"), F.get("_a", 2 * i + 1).alias("v"))))
        part = lambda f: F.transform("_p", lambda p: p["u"] * f[0] + p["v"] * f[1])
        out = let(out, **{f"_d{j}": part(g), "_a": part(h)})
    details = [f"_d{j}" for j in range(1, levels + 1)]
    return let(out, details=F.array(*details), approx=F.col("_a")).drop("_a", "_p", *details)


def haar_analyze(windows: DataFrame, levels: int) -> DataFrame:
    """Each coefficient straight from the samples: the sum of a block's first half less its second, added up in their order,
    over the root of the length. Coefficients that are equal by rule get the last bits that this sum has in SQL."""
    add = "aggregate(slice(x, {at} + 1, {n}), {start}, (s, v) -> s {sign} v)".format
    first = add(at="shiftleft(k, j)", n="shiftleft(1, j - 1)", start="0D", sign="+")
    d = add(at="shiftleft(k, j) + shiftleft(1, j - 1)", n="shiftleft(1, j - 1)", start=first, sign="-")
    a = add(at=f"shiftleft(k, {levels})", n=1 << levels, start="0D", sign="+")
    blocks = "transform(sequence(0, shiftright(size(x), {j}) - 1), k -> {sum} / sqrt(double(shiftleft(1, {j}))))".format
    details = F.expr(f"transform(sequence(1, {levels}), j -> {blocks(j='j', sum=d)})") if levels else F.array().cast("array<array<double>>")
    return let(windows, details=details, approx=F.expr(blocks(j=levels, sum=a)))


def two_tap_synthesize(coefs: DataFrame, levels: int, filters: str | None = None, details: str = "details", out: str = "recon") -> DataFrame:
    """coefs with the signal that approx and details stand for."""
    if filters is None:
        both = lambda a, d: F.flatten(F.zip_with(a, d, lambda u, v: F.array(u * R + v * R, u * R - v * R)))
        return let(coefs, **{out: F.aggregate(F.reverse(details), F.col("approx"), both)})
    df = let(coefs, **{out: F.col("approx")})
    for j in range(levels, 0, -1):
        h, g = bank(j, filters)
        pairs = F.zip_with(out, F.get(details, j - 1), lambda a, d: F.array(a * h[0] + d * g[0], a * h[1] + d * g[1]))
        df = let(df, **{out: F.flatten(pairs)})
    return df


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as rows of a matrix."""
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(column), -1)


def lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, np.ascontiguousarray(rows, dtype=float).ravel())


def nested(levels: list[np.ndarray]) -> pa.Array:
    """Per row the arrays of all levels."""
    n = len(levels[0])
    inner = np.cumsum([0, *np.tile([x.shape[1] for x in levels], n)]).astype(np.int32)
    flat = np.concatenate([x for row in zip(*levels) for x in row]) if n else np.empty(0)
    lowest = pa.ListArray.from_arrays(inner, flat)
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(levels), lowest)


def add_columns(df: DataFrame, kinds: dict[str, T.DataType], run) -> DataFrame:
    """df with columns made from Arrow batches, map-only."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in kinds])
    kept = schema.fieldNames()
    for k, t in kinds.items():
        schema = schema.add(k, t)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = run(b)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(made[k] for k in kinds)], names=schema.fieldNames())

    return df.mapInArrow(each, schema)


REALS = T.ArrayType(T.DoubleType())


def dwt(windows: DataFrame, wavelet: str, levels: int | None = None, size: int | None = None, native: bool = True) -> DataFrame:
    """windows with wavelet, approx and details, by default as deep as the window length allows.

    All windows have one length (`size`, needed where `levels` isn't given). Ends are circular. native: Haar by array
    functions; a report that transforms many times takes the Arrow kernel instead, whose plan stays short.
    """
    family = canonical(wavelet)
    if levels is None:
        levels = levels_of(size)
    out = windows.withColumn("wavelet", F.lit(family))
    if family == "haar" and native:
        return two_tap_analyze(out, levels)

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        a, details = matrix(b.column("x")), []
        for _ in range(levels):
            a, d = analyze(a, family)
            details.append(d)
        return {"details": nested(details), "approx": lists(a)}

    return add_columns(out, {"details": T.ArrayType(REALS), "approx": REALS}, run)


def idwt(coefs: DataFrame, wavelet: str, levels: int, details: str = "details", out: str = "recon", native: bool = True) -> DataFrame:
    """coefs with the reconstructed signal."""
    family = canonical(wavelet)
    if family == "haar" and native:
        return two_tap_synthesize(coefs, levels, None, details, out)

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        a, d = matrix(b.column("approx")), b.column(details)
        flat, n = d.flatten(), len(d)
        rows = [matrix(flat.take(pa.array(np.arange(n) * levels + j))) for j in range(levels)]
        for j in range(levels - 1, -1, -1):
            a = synthesize(a, rows[j], family)
        return {out: lists(a)}

    return add_columns(coefs, {out: REALS}, run)


def coefficients(coefs: DataFrame, *extra: str) -> DataFrame:
    """The long form: a row (level, k, d) for each detail coefficient."""
    keys = [c for c in ("series_id", "window_id", "wavelet", "retain") if c in coefs.columns] + list(extra)
    level = coefs.select(*keys, F.posexplode("details").alias("_j", "_d"))
    return level.select(*keys, (F.col("_j") + 1).alias("level"), F.posexplode("_d").alias("k", "d"))
