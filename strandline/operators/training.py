"""Filter banks learned per window.

A level of the bank is a block of 2 x 2 numbers whose rows give the low-pass and high-pass filters. Adam lowers the mean
absolute detail coefficient (plus a weighted reconstruction error, which an orthonormal bank keeps at zero), and after
each step every block is projected to the nearest isometry. Windows are rows: all windows of an Arrow batch are trained
together in one set of array operations, and Spark deals the batches out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .transforms import REALS, add_columns, matrix

FILTERS = T.ArrayType(T.StructType([T.StructField("h", REALS), T.StructField("g", REALS)]))
HISTORY = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("stage", T.IntegerType()), ("iterations", T.IntegerType()), ("lr", T.DoubleType()), ("loss", T.DoubleType()), ("levels", T.IntegerType()), ("chi", T.IntegerType()), ("chimid", T.IntegerType()), ("init", T.StringType()))]))


@dataclass(frozen=True)
class Stage:
    """One run of the optimiser; moments of Adam start anew. init: haar, random or previous.

    levels, chi and chimid are those of the stage before unless given. A stage that changes one of them, or says reinit,
    can't go on from the bank before it: with init previous it starts from random filters. mse_weight has no effect, since
    an orthonormal bank reconstructs without error; it is kept with the other settings of a run.
    """

    iterations: int = 50
    lr: float = 5e-3
    init: str = "previous"
    sparsity_weight: float = 1.0
    mse_weight: float = 0.0
    seed: int = 1
    param: str = "block"  # or angle: one angle per level instead of a projected block
    early_stop: bool = False
    tol: float = 1e-6
    patience: int = 10
    min_iter: int = 10
    levels: int | None = None
    chi: int | None = None
    chimid: int | None = None
    reinit: bool = False


DEFAULT_SCHEDULE = (Stage(200, 5e-3, "haar"), Stage(150, 2.5e-3))
PIPELINE_SCHEDULE = (Stage(50, 5e-3, "haar"), Stage(50, 2.5e-3))


def isometry_project(a: np.ndarray, axis: int = -1) -> np.ndarray:
    """The nearest tensor, real or complex, whose slices along axis are orthonormal: A V L^(-1/2) V* of its matrix, tiny
    eigenvalues dropped."""
    moved = np.moveaxis(np.where(np.isfinite(a), a, 0.0), axis, -1)
    m = moved.reshape(-1, moved.shape[-1])
    values, vectors = np.linalg.eigh(m.conj().T @ m)
    cut = values.max(initial=0.0) * np.finfo(float).eps
    inverse = np.where(values > cut, 1 / np.sqrt(np.where(values > cut, values, 1.0)), 0.0)
    return np.moveaxis((m @ (vectors * inverse) @ vectors.conj().T).reshape(moved.shape), -1, axis)


def project_blocks(w: np.ndarray) -> np.ndarray:
    """The polar factor of every 2 x 2 block (last two axes); sign of the determinant kept, in closed form.

    For det < 0 the factor is a reflection: the block's symmetric, traceless part made unit length; for det >= 0 it is
    a rotation, from the other part.
    """
    a, b, c, d = w[..., 0, 0], w[..., 0, 1], w[..., 1, 0], w[..., 1, 1]
    flip = a * d - b * c < 0
    p, q = np.where(flip, a - d, a + d), np.where(flip, b + c, b - c)
    size = np.hypot(p, q)
    p, q = np.where(size > 0, p / np.where(size > 0, size, 1), 1.0), np.where(size > 0, q / np.where(size > 0, size, 1), 0.0)
    s = np.where(flip, 1.0, -1.0)
    return np.stack([np.stack([p, q], -1), np.stack([s * q, -s * p], -1)], -2)


def extract_filters(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """h: the first row at unit length (even, if it has none); g: the second row without its part along h, at unit length,
    or h's quadrature mirror if nothing is left."""
    eps = np.finfo(float).eps
    size = np.linalg.norm(w[..., 0, :], axis=-1, keepdims=True)
    h = np.where(size > eps, w[..., 0, :] / np.where(size > eps, size, 1), math.sqrt(0.5))
    g = w[..., 1, :] - (w[..., 1, :] * h).sum(-1, keepdims=True) * h
    size = np.linalg.norm(g, axis=-1, keepdims=True)
    mirror = np.stack([h[..., 1], -h[..., 0]], -1)
    return h, np.where(size > eps, g / np.where(size > eps, size, 1), mirror)


def haar_blocks(n: int, levels: int) -> np.ndarray:
    r = math.sqrt(0.5)
    return np.broadcast_to(np.array([[r, r], [r, -r]]), (n, levels, 2, 2)).copy()


def random_blocks(n: int, levels: int, seeds: list[int], chi: int = 2, chimid: int = 2) -> np.ndarray:
    """Blocks cut from projected Gaussian tensors (4, chimid, chi, chi), seeded by window; then made orthogonal."""
    out = np.empty((n, levels, 2, 2))
    for i, s in enumerate(seeds):
        rng = np.random.default_rng(s)
        for j in range(levels):
            out[i, j] = isometry_project(rng.standard_normal((4, chimid, chi, chi)), 0)[:2, :2, 0, 0]
    h, g = extract_filters(out)
    return np.stack([h, g], -2)


def forward(x: np.ndarray, h: np.ndarray, g: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pairs that each level saw, and its details; windows in rows, filters (window, level, 2)."""
    pairs, details, a = [], [], x
    for j in range(h.shape[1]):
        p = a.reshape(len(a), -1, 2)
        pairs.append(p)
        details.append((p * g[:, j, None]).sum(-1))
        a = (p * h[:, j, None]).sum(-1)
    return pairs, details


def loss_and_slope(x: np.ndarray, w: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss by window, and its derivative when the first filter of a level turns towards the second (window, level)."""
    h, g = extract_filters(w)
    pairs, details = forward(x, h, g)
    m = sum(d.shape[1] for d in details)
    loss = weight * sum(np.abs(d).sum(1) for d in details) / m
    slope, back = np.zeros(w.shape[:2]), np.zeros((len(x), pairs[-1].shape[1]))
    for j in range(w.shape[1] - 1, -1, -1):
        dd = weight * np.sign(details[j]) / m
        to_h, to_g = (back[..., None] * pairs[j]).sum(1), (dd[..., None] * pairs[j]).sum(1)
        slope[:, j] = (to_h * g[:, j]).sum(-1) - (to_g * h[:, j]).sum(-1)
        back = (back[..., None] * h[:, j, None] + dd[..., None] * g[:, j, None]).reshape(len(x), -1)
    return loss, slope


def optimize(x: np.ndarray, w: np.ndarray, stage: Stage) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks, the loss before the last update, and the iterations used, by window.

    At an isometry a change of a block moves the filters only as far as it turns the first row towards the second, so the
    gradient of the first row is slope * g and that of the second is zero.
    """
    n = len(x)
    m1, m2 = np.zeros(w.shape[:2] + (2,)), np.zeros(w.shape[:2] + (2,))
    final, used, best, stale = np.zeros(n), np.zeros(n, int), np.full(n, np.inf), np.zeros(n, int)
    live = np.ones(n, bool)
    for k in range(1, stage.iterations + 1):
        loss, slope = loss_and_slope(x, w, stage.sparsity_weight)
        final, used = np.where(live, loss, final), used + live
        if stage.early_stop:
            better = loss < best - stage.tol
            best, stale = np.where(better, loss, best), np.where(better, 0, stale + 1)
            live &= (k < stage.min_iter) | (stale < stage.patience)
            if not live.any():
                break
        g = extract_filters(w)[1]
        grad = slope[..., None] * (g if stage.param == "block" else np.ones(2))
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        step = stage.lr * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-8)
        if stage.param == "block":
            new = w.copy()
            new[..., 0, :] -= step
            new = project_blocks(new)
        else:
            h, turn = extract_filters(w)[0], -step[..., :1]
            new = np.stack([h * np.cos(turn) + g * np.sin(turn), g * np.cos(turn) - h * np.sin(turn)], -2)
        w = np.where(live[:, None, None, None], new, w)
    return w, final, used


def settled(schedule: tuple[Stage, ...], levels: int, chi: int, chimid: int) -> list[tuple[Stage, int, int, int, str]]:
    """(stage, levels, chi, chimid, start) of every stage: what it inherits, and whether it starts from haar, random or previous."""
    out = []
    for stage in schedule:
        now = (stage.levels or levels, stage.chi or chi, stage.chimid or chimid)
        anew = stage.reinit or now != (levels, chi, chimid) or stage.init != "previous"
        start = "previous" if not anew else "haar" if stage.init == "haar" and now[1:] == (2, 2) else "random"
        levels, chi, chimid = now
        out.append((stage, *now, start))
    return out


def train(windows: DataFrame, levels: int = 5, schedule: tuple[Stage, ...] = PIPELINE_SCHEDULE, chi: int = 2, chimid: int = 2, resume: bool = False) -> DataFrame:
    """windows with filters (h and g by level), loss, iterations_used, history and error.

    A stage with init haar starts from Haar filters if chi = chimid = 2 and from random ones otherwise; previous goes on
    from the stage before, and a first stage from Haar filters or, with resume, from the filters that the windows bring
    (with_model() adds them from a table). A window that isn't finite, or can't be halved so often, gets an error and Haar
    filters instead of stopping the job; so does one whose own filters have another number of levels.
    """
    plan = settled(schedule, levels, chi, chimid)
    deepest = max([levels, *(p[1] for p in plan)])

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        x, ids = matrix(b.column("x")), b.column("window_id").to_pylist()
        n = len(x)
        ok = np.isfinite(x).all(axis=1) if x.shape[1] % (1 << deepest) == 0 else np.zeros(n, bool)
        w, loss, used, last = haar_blocks(n, levels), np.zeros(n), np.zeros(n, int), levels
        if resume:
            banks = b.column("filters").to_pylist()
            ok &= np.array([bank is not None and len(bank) == levels for bank in banks], bool)
            for k in np.flatnonzero(ok):
                w[k] = [[f["h"], f["g"]] for f in banks[k]]
        safe = np.where(ok[:, None], x, 0.0)
        history: list[list[dict]] = [[] for _ in range(n)]
        for i, (stage, last, wide, inner, start) in enumerate(plan):
            if start == "random":
                w = random_blocks(n, last, [stage.seed * 1_000_003 + (k or 0) for k in ids], wide, inner)
            elif start == "haar":
                w = haar_blocks(n, last)
            if ok.any():
                w, loss, steps = optimize(safe, w, stage)
                used = used + steps
            for k in range(n):
                history[k].append({"stage": i + 1, "iterations": int(used[k]), "lr": stage.lr, "loss": float(loss[k]) if ok[k] else None, "levels": last, "chi": wide, "chimid": inner, "init": start})
        w = np.where(ok[:, None, None, None], w, haar_blocks(n, last))
        h, g = extract_filters(w)
        return {
            "filters": pa.array([[{"h": h[i, j].tolist(), "g": g[i, j].tolist()} for j in range(last)] for i in range(n)], pa.list_(pa.struct([("h", pa.list_(pa.float64())), ("g", pa.list_(pa.float64()))]))),
            "loss": pa.array([float(v) if k else None for v, k in zip(loss, ok)], pa.float64()),
            "iterations_used": pa.array(used.astype(np.int32)),
            "history": pa.array(history, pa.list_(pa.struct([("stage", pa.int32()), ("iterations", pa.int32()), ("lr", pa.float64()), ("loss", pa.float64()), ("levels", pa.int32()), ("chi", pa.int32()), ("chimid", pa.int32()), ("init", pa.string())]))),
            "error": pa.array([None if k else "window is not finite or too short, or has another bank" for k in ok], pa.string()),
        }

    kinds = {"filters": FILTERS, "loss": T.DoubleType(), "iterations_used": T.IntegerType(), "history": HISTORY, "error": T.StringType()}
    return add_columns(windows, kinds, run)


def model_table(trained: DataFrame) -> DataFrame:
    """A row per window and level: filters as arrays, the angle of h and the sign of the determinant."""
    rows = trained.select("series_id", "window_id", F.posexplode("filters").alias("_j", "f"))
    h, g = F.col("f.h"), F.col("f.g")
    det = F.get(h, 0) * F.get(g, 1) - F.get(h, 1) * F.get(g, 0)
    return rows.select("series_id", "window_id", (F.col("_j") + 1).alias("level"), h.alias("h"), g.alias("g"), F.atan2(F.get(h, 1), F.get(h, 0)).alias("theta"), F.signum(det).alias("det"))


def training_history(trained: DataFrame, settings: bool = False) -> DataFrame:
    """A row for each stage of a window: what it had done by its end, and with settings the bank's size and its start."""
    names = ["stage", "iterations", "lr", "loss"] + (["levels", "chi", "chimid", "init"] if settings else [])
    return trained.select("series_id", "window_id", F.explode("history").alias("_h")).select("series_id", "window_id", *(f"_h.{n}" for n in names))


def with_model(windows: DataFrame, model: DataFrame, levels: int) -> DataFrame:
    """windows with the filters of a model table that was written earlier, for two_tap_analyze() and the reports.

    Windows without all `levels` levels in the table get Haar filters. Of several rows for a level the first h counts.
    """
    one = model.where(F.col("level") <= levels).groupBy("series_id", "window_id", "level").agg(F.min(F.struct("h", "g")).alias("_f"))
    banks = one.groupBy("series_id", "window_id").agg(F.array_sort(F.collect_list(F.struct("level", "_f"))).alias("_m"))
    banks = banks.where(F.size("_m") == levels).select("series_id", "window_id", F.transform("_m", lambda m: m["_f"]).alias("filters"))
    r = math.sqrt(0.5)
    haar = F.array_repeat(F.struct(F.array(F.lit(r), F.lit(r)).alias("h"), F.array(F.lit(r), F.lit(-r)).alias("g")), levels)
    return windows.drop("filters").join(banks, ["series_id", "window_id"], "left").withColumn("filters", F.coalesce("filters", haar))


def grid_search(windows: DataFrame, mse_weights: tuple[float, ...], retain_sets: tuple[tuple[float, ...], ...], evaluate, levels: int = 5, schedule: tuple[Stage, ...] = PIPELINE_SCHEDULE) -> DataFrame:
    """Results of evaluate(trained, retains) for every weight and retain set, side by side.

    An orthonormal bank reconstructs without error, so the error's weight moves neither loss nor gradient: one training
    serves all weights, and their rows are equal.
    """
    trained, out = train(windows, levels, schedule), None
    for i, retains in enumerate(retain_sets):
        part = evaluate(trained, retains).withColumn("retain_set", F.lit(i + 1))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("mse_weight", F.explode(F.array(*(F.lit(float(w)) for w in mse_weights))))
