"""Two-tap banks with complex filters.

A level's filters are read from a complex tensor; analysis takes them conjugated, synthesis as they are, so an orthonormal
bank gives a signal back. Complex columns are two arrays, real parts and imaginary parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .training import isometry_project
from .transforms import REALS, add_columns, lists, matrix

EPS = np.finfo(float).eps
BANKS = T.ArrayType(T.ArrayType(T.DoubleType()))


def random_tensors(levels: int, chi: int, chimid: int, seed: int) -> list[dict[str, np.ndarray]]:
    """By level the projected complex Gaussian tensors w (4, chimid, chi, chi), v (chi, 4, chimid) and u (chimid four times):
    w and v are isometries along their first axis, u along its second."""
    rng = np.random.default_rng(seed)
    gaussian = lambda *shape: (rng.standard_normal(shape) + 1j * rng.standard_normal(shape)) / np.sqrt(2)
    made = ({"w": gaussian(4, chimid, chi, chi), "v": gaussian(chi, 4, chimid), "u": gaussian(*[chimid] * 4)} for _ in range(levels))
    return [{k: isometry_project(t, 1 if k == "u" else 0) for k, t in level.items()} for level in made]


def complex_filters(w: np.ndarray) -> np.ndarray:
    """h and g of blocks of two rows: the first row at unit length (even, if it has none), and the second without its part
    along h, at unit length, or h's quadrature mirror if nothing is left."""
    size = np.linalg.norm(w[..., 0, :], axis=-1, keepdims=True)
    h = np.where(size > EPS, w[..., 0, :] / np.where(size > EPS, size, 1), np.sqrt(0.5))
    g = w[..., 1, :] - h * (np.conj(h) * w[..., 1, :]).sum(-1, keepdims=True)
    size = np.linalg.norm(g, axis=-1, keepdims=True)
    mirror = np.stack([np.conj(h[..., 1]), -np.conj(h[..., 0])], -1)
    return np.stack([h, np.where(size > EPS, g / np.where(size > EPS, size, 1), mirror)], -2)


def flat(bank: np.ndarray) -> list[list[float]]:
    """By level the eight numbers of h and g: real and imaginary parts of h0, h1, g0, g1."""
    return [np.stack([level.real, level.imag], -1).ravel().tolist() for level in bank]


def banks_of(column: pa.Array) -> np.ndarray:
    """flat() of all windows as (window, level, h or g, 2) complex numbers."""
    x = np.array(column.to_pylist(), float).reshape(len(column), -1, 2, 2, 2)
    return x[..., 0] + 1j * x[..., 1]


def with_random_bank(windows: DataFrame, levels: int, chi: int = 2, chimid: int = 2, seed: int = 1) -> DataFrame:
    """windows with `bank`, the filters of random tensors seeded by the window's number."""

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        ids = b.column("window_id").to_pylist()
        blocks = [np.stack([t["w"][:2, :2, 0, 0] for t in random_tensors(levels, chi, chimid, seed * 1_000_003 + (i or 0))]) for i in ids]
        return {"bank": pa.array([flat(complex_filters(w)) for w in blocks], pa.list_(pa.list_(pa.float64())))}

    return add_columns(windows, {"bank": BANKS}, run)


def parts(z: np.ndarray, name: str) -> dict[str, pa.Array]:
    return {f"{name}_re": lists(z.real), f"{name}_im": lists(z.imag)}


def analyze(windows: DataFrame, levels: int) -> DataFrame:
    """windows (x, bank) with approx_re, approx_im and d<level>_re, d<level>_im of `levels` levels."""

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        a, bank, out = matrix(b.column("x")).astype(complex), np.conj(banks_of(b.column("bank"))), {}
        for j in range(levels):
            p = a.reshape(len(a), -1, 2)
            a, d = ((p * bank[:, j, k, None]).sum(-1) for k in (0, 1))
            out |= parts(d, f"d{j + 1}")
        return out | parts(a, "approx")

    names = [f"{n}_{p}" for n in (*(f"d{j + 1}" for j in range(levels)), "approx") for p in ("re", "im")]
    return add_columns(windows, {n: REALS for n in names}, run)


def synthesize(coefs: DataFrame, levels: int) -> DataFrame:
    """coefs with recon_re and recon_im, what approx and details of a bank stand for."""

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        z = lambda n: matrix(b.column(f"{n}_re")) + 1j * matrix(b.column(f"{n}_im"))
        a, bank = z("approx"), banks_of(b.column("bank"))
        for j in range(levels - 1, -1, -1):
            a = (a[..., None] * bank[:, j, 0, None] + z(f"d{j + 1}")[..., None] * bank[:, j, 1, None]).reshape(len(a), -1)
        return parts(a, "recon")

    return add_columns(coefs, {"recon_re": REALS, "recon_im": REALS}, run)


def with_polar_factor(windows: DataFrame, columns: int = 2, imaginary: bool = False, out: str = "w") -> DataFrame:
    """windows with the nearest isometry to each window as a matrix of so many columns, row by row; with imaginary, pairs
    of samples are real and imaginary parts, and the result's are out_re and out_im."""
    names = [f"{out}_re", f"{out}_im"] if imaginary else [out]

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        made = []
        for x in matrix(b.column("x")) if b.num_rows else ():
            a = x[0::2] + 1j * x[1::2] if imaginary else x
            made.append(isometry_project(a.reshape(-1, columns)).ravel())
        z = np.array(made).reshape(b.num_rows, -1)
        return parts(z, out) if imaginary else {out: lists(z)}

    return add_columns(windows, {n: REALS for n in names}, run)


def long(coefs: DataFrame, levels: int) -> DataFrame:
    """window_id, level, k, re, im of all details."""
    rows = F.array(*(F.struct(F.lit(j).alias("level"), F.arrays_zip(F.col(f"d{j}_re").alias("re"), F.col(f"d{j}_im").alias("im")).alias("d")) for j in range(1, levels + 1)))
    found = coefs.select("series_id", "window_id", F.explode(rows).alias("r")).select("series_id", "window_id", "r.level", F.posexplode("r.d").alias("k", "d"))
    return found.select("series_id", "window_id", "level", "k", "d.re", "d.im")
