"""Compression results of many methods and shares for every window, in one pass.

Reports compare up to six methods at seven shares or more, and each result needs a reconstruction and its measures. As
array expressions every method would bring a branch of its own, with the windows made anew in each; here a window is
read once, and a task works through methods and shares for all windows of an Arrow batch. The measures are those of
`metrics`, and tests hold the two against each other.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.wavelets import analyze, canonical, levels_of, synthesize
from .series import EPS
from .transforms import matrix

QS = np.arange(-5.0, 6.0)
MEASURES = ("psnr", "H", "deltaH", "alpha_width", "alpha_peak", "f_alpha_peak", "delta_alpha_width")
#: Methods besides the wavelet families: a family with one pool for all levels, Haar with few levels, learned filters.
POOL, SHORT, LEARNED = "_pool", "haar_bank", "learned"
#: A level that lost all its coefficients comes back as rounding noise, which is no energy; a coefficient that was set to
#: zero comes back below FAINT, and is zero for the spectrum, whose negative powers would be those of the noise.
NOISE, FAINT = 1e-28, 1e-10


def decompose(x: np.ndarray, family: str, levels: int, filters: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Approximation and details; filters (window, level, h or g, 2) take the place of a family's."""
    details = []
    for j in range(levels):
        if filters is None:
            x, d = analyze(x, family)
        else:
            p = x.reshape(len(x), -1, 2)
            x, d = ((p * filters[:, j, k, None]).sum(-1) for k in (0, 1))
        details.append(d)
    return x, details


def block_sums(x: np.ndarray, levels: int) -> np.ndarray:
    """Haar's approximation straight from the samples, added up in their order."""
    return np.add.accumulate(x.reshape(len(x), -1, 1 << levels), axis=-1)[..., -1] / math.sqrt(1 << levels)


def block_details(x: np.ndarray, levels: int) -> list[np.ndarray]:
    """Haar's details likewise, as `transforms.haar_analyze` has them. decompose() gives the same but for the last bits, by
    which coefficients that are equal by rule get their order."""
    out = []
    for j in range(1, levels + 1):
        p = x.reshape(len(x), -1, 2, 1 << (j - 1))
        out.append(block_sums(np.stack([p[:, :, 0], -p[:, :, 1]], axis=2).reshape(len(x), -1), j))
    return out


def recompose(a: np.ndarray, details: list[np.ndarray], family: str, filters: np.ndarray | None) -> np.ndarray:
    for j in range(len(details) - 1, -1, -1):
        if filters is None:
            a = synthesize(a, details[j], family)
        else:
            a = (a[..., None] * filters[:, j, 0, None] + details[j][..., None] * filters[:, j, 1, None]).reshape(len(a), -1)
    return a


def ranks(d: np.ndarray) -> np.ndarray:
    """The place of each coefficient of a row by size, largest first, of equal ones the first."""
    order = np.argsort(-np.abs(d), axis=1, kind="stable")
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(d.shape[1]), d.shape), axis=1)
    return out


def budgets(sizes: list[int], retain: float, pool: bool) -> list[int]:
    """How many coefficients stay: of each level, or of all together."""
    if pool:
        total = sum(sizes)
        return [total if retain >= 1 else min(total, max(1, int(np.round(retain * total))))]
    return [min(n, max(0, int(np.ceil(retain * n)))) for n in sizes]


def slopes(y: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Per row the least-squares slope of y over the column numbers, where ok; NaN below two columns."""
    n = np.maximum(ok.sum(axis=1), 1)
    x, y = np.where(ok, np.arange(y.shape[1]), 0.0), np.where(ok, y, 0.0)
    dx = np.where(ok, x - (x.sum(axis=1) / n)[:, None], 0.0)
    sxx = (dx * dx).sum(axis=1)
    return np.where(sxx > EPS, (dx * y).sum(axis=1) / np.where(sxx > EPS, sxx, 1.0), np.nan)


def scaling(x: np.ndarray, low: int, floor: float, spectrum: bool, family: str = "haar", details: list[np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """H by a family's levels from low on, how many of these have energy (scales), and alpha_width, alpha_peak and
    f_alpha_peak of the spectrum. details: those of all levels, where they are known."""
    details = (details or decompose(x, family, levels_of(x.shape[1]), None)[1])[low - 1 :]
    with np.errstate(divide="ignore", invalid="ignore"):
        e = np.stack([(d * d).mean(axis=1) for d in details], axis=1) if details else np.zeros((len(x), 0))
        ok = (e > floor) & np.isfinite(e)
        out = {"H": (slopes(np.log2(np.where(ok, e, 1.0)), ok) + 1) / 2, "scales": ok.sum(axis=1).astype(float)}
        if spectrum:
            size = [np.where((floor > 0) & (np.abs(d) < FAINT), 0.0, np.abs(d)) + 1e-12 for d in details]
            logs = [np.stack([np.log(d).mean(axis=1) / np.log(2.0) if q == 0 else np.log2((d**q).mean(axis=1)) for d in size], axis=1) if size else np.zeros((len(x), 0)) for q in QS]
            zeta = np.stack([-slopes(y, np.ones_like(y, bool)) for y in logs], axis=1)
            lo, hi = np.maximum(np.arange(len(QS)) - 1, 0), np.minimum(np.arange(len(QS)) + 1, len(QS) - 1)
            alpha = (zeta[:, hi] - zeta[:, lo]) / (QS[hi] - QS[lo])
            f = QS * alpha - zeta + 1.0
            peak = np.argmax(f, axis=1)[:, None]
            out |= {"alpha_min": alpha.min(axis=1), "alpha_max": alpha.max(axis=1), "alpha_width": alpha.max(axis=1) - alpha.min(axis=1), "alpha_peak": np.take_along_axis(alpha, peak, 1)[:, 0], "f_alpha_peak": np.take_along_axis(f, peak, 1)[:, 0]}
    return out


#: A 31-bit prime, and the steps of a counter's hash below it that numpy and SQL have alike.
PRIME, STEPS = (1 << 31) - 1, ((1103515245, 12345, 16), (69069, 1, 13), (48271, 11, 15))


def drawn(counter: np.ndarray) -> np.ndarray:
    """Numbers below the prime that look random, one for each counter."""
    h = counter.astype(np.int64) % PRIME
    for a, b, shift in STEPS:
        h = (h * a + b) % PRIME
        h ^= h >> shift
    return h


def drawn_sql(counter: str) -> str:
    """drawn() for DuckDB."""
    h = f"(({counter}) % {PRIME})"
    for a, b, shift in STEPS:
        h = f"list_transform([({h} * {a} + {b}) % {PRIME}], lambda h: xor(h, h >> {shift}))[1]"
    return h


def resampled_spectra(windows: DataFrame, n_boot: int = 50, seed: int = 1, low: int = 2, analysis: str = "haar") -> DataFrame:
    """series_id, window_id, and the mean and the 2.5 and 97.5 % quantiles of alpha_min, alpha_max, alpha_width, alpha_peak
    and f_alpha_peak over resamples of each window, as <name>_mean, <name>_lower and <name>_upper.

    A resample draws as many of a window's samples as it has, with replacement, by a hash of the window's number, the
    resample's and the place; differences of a sample drawn twice are zero, whatever rounding leaves. It is drawn, measured and forgotten within a task; no window is copied. Null where a
    window's spectrum can't be had.
    """
    family, names = canonical(analysis), ("alpha_min", "alpha_max", "alpha_width", "alpha_peak", "f_alpha_peak")
    columns = [f"{n}_{s}" for n in names for s in ("mean", "lower", "upper")]
    schema = T.StructType([windows.schema[c] for c in ("series_id", "window_id")] + [T.StructField(c, T.DoubleType()) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x, window in zip(matrix(b.column("x")) if b.num_rows else (), b.column("window_id").to_pylist()):
                at = np.arange(n_boot * len(x)) + (window or 0) * n_boot * len(x) + seed * 7919
                found = scaling(x[drawn(at) % len(x)].reshape(n_boot, -1), low, NOISE, True, family)
                rows.append([float(v) if np.isfinite(v) else None for n in names for v in (found[n].mean(), *np.quantile(found[n], (0.025, 0.975)))])
            cols = zip(*rows) if rows else [()] * len(columns)
            yield pa.RecordBatch.from_arrays([b.column("series_id"), b.column("window_id"), *(pa.array(c, pa.float64()) for c in cols)], names=["series_id", "window_id", *columns])

    return windows.select("series_id", "window_id", "x").mapInArrow(run, schema)


def fidelity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    mse, peak = ((y - x) ** 2).mean(axis=1), np.abs(x).max(axis=1)
    ok = (mse >= EPS) & (peak > 0)
    return np.where(ok, 10 * np.log10(np.where(ok, peak * peak, 1.0) / np.where(ok, mse, 1.0)), np.nan)


def evaluated(windows: DataFrame, size: int, methods: tuple[str, ...], retains: tuple[float, ...], low: int = 2, levels: int = 5, measures: tuple[str, ...] = MEASURES, analysis: str = "haar", direct: bool = False) -> DataFrame:
    """method, series_id, window_id, retain, retain_ppm, kept, total and the measures asked for, for every window,
    method and share; one map over the windows (series_id, window_id, x, and filters for the learned method).

    analysis is the family by whose levels H and spectra are measured, of originals and reconstructions alike, whatever
    the method. Only what the measures need is computed; H and spectrum of the original stand in H_orig and width_orig if asked for,
    and the time a result took in `seconds`, shared equally by the windows that are worked on at once.
    What cannot be estimated is null. `scales`, if asked for, is how many levels from low on have energy left.

    direct: for Haar only, by Haar; coefficients come straight from the samples (block_details()), and reconstructions are
    measured by the coefficients that stay, which by orthonormality are theirs.
    """
    measured = canonical(analysis)
    names = [m if m in (LEARNED, SHORT) else canonical(m.removesuffix(POOL)) + m[len(m.removesuffix(POOL)) :] for m in methods]
    if direct and (measured != "haar" or not all(m.removesuffix(POOL) == "haar" or m == SHORT for m in names)):
        raise ValueError("direct is for Haar, measured by Haar")
    spectrum = any("alpha" in m or m == "width_orig" for m in measures)
    scaled, moved = spectrum or any(m in ("H", "deltaH", "H_orig", "scales") for m in measures), any("delta" in m or m.endswith("_orig") for m in measures)
    used = ["series_id", "window_id", "x"] + (["filters"] if LEARNED in names else [])
    schema = T.StructType([windows.schema[c] for c in ("series_id", "window_id")] + [T.StructField("method", T.StringType()), T.StructField("retain", T.DoubleType())])
    schema = T.StructType(schema.fields + [T.StructField(c, T.IntegerType()) for c in ("retain_ppm", "kept", "total")] + [T.StructField(m, T.DoubleType()) for m in measures])

    def rows(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, n = matrix(b.column("x")), b.num_rows
        blocks = block_details(x, levels_of(size)) if direct else None
        before = scaling(x, low, 0.0, spectrum, measured, blocks) if moved else {}
        for name in names:
            bank = None
            if name == LEARNED:
                bank = np.array([[[f["h"], f["g"]] for f in row] for row in b.column("filters").to_pylist()])
            few, pool = name in (SHORT, LEARNED), name.endswith(POOL)
            family = "haar" if few else name.removesuffix(POOL)
            depth = levels if few else levels_of(size)
            approx, details = (block_sums(x, depth), blocks[:depth]) if direct else decompose(x, family, depth, bank)
            sizes = [d.shape[1] for d in details]
            places = [ranks(np.concatenate(details, axis=1))] if pool else [ranks(d) for d in details]
            for r in retains:
                began = time.perf_counter()
                keep = budgets(sizes, r, pool)
                stay = [p < k for p, k in zip(places, keep)]
                if pool:
                    stay = np.split(stay[0], np.cumsum(sizes)[:-1], axis=1)
                left = [np.where(s, d, 0.0) for s, d in zip(stay, details)]
                y = recompose(approx, left, family, bank)
                found = {"psnr": fidelity(x, y)} if "psnr" in measures else {}
                if scaled:
                    found |= scaling(y, low, 0.0, spectrum, measured, left + blocks[depth:]) if direct else scaling(y, low, NOISE, spectrum, measured)
                if moved:
                    found |= {"H_orig": before["H"], "deltaH": found["H"] - before["H"]}
                    if spectrum:
                        found |= {"width_orig": before["alpha_width"], "delta_alpha_width": found["alpha_width"] - before["alpha_width"]}
                if "seconds" in measures:
                    found["seconds"] = np.full(n, (time.perf_counter() - began) / n)
                same = lambda v, t: pa.array([v] * n, t)
                whole = [same(v, pa.int32()) for v in (int(np.round(r * 1e6)), sum(keep), sum(sizes))]
                yield pa.RecordBatch.from_arrays([b.column("series_id"), b.column("window_id"), same(name, pa.string()), same(float(r), pa.float64()), *whole, *(pa.array(found[m], pa.float64(), mask=~np.isfinite(found[m])) for m in measures)], names=schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):  # a few windows at a time, whatever the batch holds
                yield from rows(b.slice(at, 64))

    return windows.select(*used).mapInArrow(run, schema)
