"""Complex tensors and banks by their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import wavelets
from strandline.operators import complex_banks, training


def test_polar_factor_of_complex_tensors():
    r = np.random.default_rng(1)
    for shape, axis in (((4, 3, 2, 2), 0), ((2, 4, 3), 0), ((3, 3, 3, 3), 1), ((5, 2), 1)):
        a = r.standard_normal(shape) + 1j * r.standard_normal(shape)
        q = np.moveaxis(training.isometry_project(a, axis), axis, -1).reshape(-1, shape[axis])
        assert np.allclose(q.conj().T @ q, np.eye(shape[axis]))
        u, _, v = np.linalg.svd(np.moveaxis(a, axis, -1).reshape(-1, shape[axis]), full_matrices=False)
        assert np.allclose(q, u @ v)
    assert np.allclose(training.isometry_project(np.array([[np.nan + 1j, 0], [0, np.inf]])), 0)


def test_random_tensors_are_isometries():
    for level in complex_banks.random_tensors(3, 2, 3, 7):
        for name, axis in (("w", 0), ("v", 0), ("u", 1)):
            t = np.moveaxis(level[name], axis, -1)
            q = t.reshape(-1, t.shape[-1])
            assert np.allclose(q.conj().T @ q, np.eye(t.shape[-1])) and np.iscomplexobj(q)
    assert np.array_equal(complex_banks.random_tensors(1, 2, 2, 7)[0]["u"], complex_banks.random_tensors(1, 2, 2, 7)[0]["u"])


def test_filters_and_their_fallbacks():
    r = np.random.default_rng(2)
    w = r.standard_normal((6, 2, 2)) + 1j * r.standard_normal((6, 2, 2))
    w[0] = 0
    w[1, 1] = w[1, 0] * (2 - 3j)  # nothing of the second row is left
    for h, g in complex_banks.complex_filters(w):
        assert np.vdot(h, h) == pytest.approx(1) and np.vdot(g, g) == pytest.approx(1) and abs(np.vdot(h, g)) < 1e-12
    assert np.allclose(complex_banks.complex_filters(w)[0], [[np.sqrt(0.5)] * 2, [np.sqrt(0.5), -np.sqrt(0.5)]])


def test_banks_give_windows_back(spark):
    x = np.random.default_rng(3).standard_normal((5, 64))
    w = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "series_id string, window_id int, x array<double>").repartition(2)
    banked = complex_banks.with_random_bank(w, 4, 4, 3)
    coefs = complex_banks.analyze(banked, 4)
    for r in complex_banks.synthesize(coefs, 4).collect():
        assert np.allclose(r["recon_re"], r["x"]) and np.allclose(r["recon_im"], 0)
        energy = sum(np.sum(np.square(r[f"d{j}_{p}"])) for j in range(1, 5) for p in ("re", "im")) + np.sum(np.square(r["approx_re"])) + np.sum(np.square(r["approx_im"]))
        assert energy == pytest.approx(np.sum(np.square(r["x"])))
        bank = np.array(r["bank"]).reshape(4, 2, 2, 2)
        h, g = bank[0, ..., 0] + 1j * bank[0, ..., 1]
        assert np.allclose(np.array(r["d1_re"]) + 1j * np.array(r["d1_im"]), np.array(r["x"]).reshape(-1, 2) @ g.conj())
    assert complex_banks.long(coefs, 4).count() == 5 * 60 and complex_banks.analyze(banked.limit(0), 4).count() == 0


def test_families_of_a_column(spark):
    names = [" DB-1", "coif 6", "Bior4.4", "unknown", None, "SYM.8 "]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(wavelets.canonical_column(F.col("n")).alias("f")).collect()
    assert [r["f"] for r in rows] == ["haar", "c3", "bior4.4", None, None, "s8"]
