"""Transforms, measures and training against their definitions, and every query against DuckDB."""

import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import wavelets
from strandline.operators import compression, metrics, series, spectral, stats, training
from strandline.operators.transforms import dwt, idwt, two_tap_analyze, two_tap_synthesize
from strandline.plans import registry

X = np.random.default_rng(5).standard_normal((3, 64)).cumsum(axis=1)


@pytest.fixture(scope="module")
def wins(spark):
    return spark.createDataFrame([("s", i + 1, r.tolist()) for i, r in enumerate(X)], "series_id string, window_id int, x array<double>").cache()


@pytest.mark.parametrize("name", ["db4", "c3", "s8"])
def test_filters_are_orthonormal(name):
    h, g = wavelets.filters(name)
    for shift in range(0, len(h), 2):
        assert abs((h[shift:] * h[: len(h) - shift]).sum() - (shift == 0)) < 1e-9
    assert abs(h.sum() - math.sqrt(2)) < 1e-9 and abs(g.sum()) < 1e-9 and abs((h * g).sum()) < 1e-12


@pytest.mark.parametrize("name", ["haar", "db4", "c3", "s8", "bior4.4"])
def test_perfect_reconstruction(wins, name):
    out = idwt(dwt(wins, name, 4), name, 4)
    row = out.select(F.max(metrics.rel_l2_error()), F.max(metrics.parseval_error())).first()
    assert row[0] < 1e-9 and (name == "bior4.4" or row[1] < 1e-9)


def test_reference_signal(spark):
    w = spark.createDataFrame([("s", 1, [float(i) for i in range(1, 65)])], "series_id string, window_id int, x array<double>")
    row = idwt(dwt(w, "haar", 4), "haar", 4).select(metrics.rel_l2_error(), metrics.parseval_error()).first()
    assert row[0] < 1e-12 and row[1] < 1e-12


def test_known_level_one_values(spark):
    w = spark.createDataFrame([("s", 1, [1.2, 0.1, -0.6, 0.4, 0.9, -0.2, 0.3, -0.5])], "series_id string, window_id int, x array<double>")
    row = dwt(w, "haar", 1).first()
    assert np.allclose(row["approx"], [0.9192, -0.1414, 0.4950, -0.1414], atol=5e-5)
    assert np.allclose(row["details"][0], [0.7778, -0.7071, 0.7778, 0.5657], atol=5e-5)


@pytest.mark.parametrize("names", [("haar", "DB1", "Daubechies-1"), ("c3", "coif6", "Coiflet 3"), ("bior4.4", "CDF97", "bior44")])
def test_aliases(names):
    assert len({wavelets.canonical(n) for n in names}) == 1
    with pytest.raises(ValueError):
        wavelets.canonical("nope")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-3.2, 3.2), min_size=4, max_size=4), st.booleans())
def test_any_orthogonal_bank_reconstructs(angles, flip):
    h = np.array([[math.cos(a), math.sin(a)] for a in angles])[None]
    g = np.array([[math.sin(a), -math.cos(a)] for a in angles])[None] * (-1 if flip else 1)
    pairs, details = training.forward(X[:1], h, g)
    a = (pairs[-1] * h[:, 3, None]).sum(-1)
    assert abs((a**2).sum() + sum((d**2).sum() for d in details) - (X[0] ** 2).sum()) < 1e-6 * (X[0] ** 2).sum()
    for j in (3, 2, 1, 0):
        a = (a[..., None] * h[:, j, None] + details[j][..., None] * g[:, j, None]).reshape(1, -1)
    assert np.allclose(a, X[:1])


def test_slope_matches_differences():
    w = training.haar_blocks(3, 4)
    w = training.project_blocks(w + 0.2 * np.random.default_rng(1).standard_normal(w.shape))
    loss, slope = training.loss_and_slope(X, w, 1.0)
    for j in range(4):
        h, g = training.extract_filters(w)
        e = 1e-6
        turned = w.copy()
        turned[:, j, 0] = h[:, j] * math.cos(e) + g[:, j] * math.sin(e)
        turned[:, j, 1] = g[:, j] * math.cos(e) - h[:, j] * math.sin(e)
        assert np.allclose((training.loss_and_slope(X, turned, 1.0)[0] - loss) / e, slope[:, j], atol=1e-4)


def test_projection_is_polar():
    w = np.random.default_rng(2).standard_normal((50, 2, 2))
    for a, b in zip(w, training.project_blocks(w)):
        u, _, v = np.linalg.svd(a)
        assert np.allclose(b, u @ v) and np.allclose(training.isometry_project(a), u @ v)


@pytest.mark.parametrize("param", ["block", "angle"])
def test_training_lowers_the_loss(spark, param):
    t = np.linspace(0, 4 * math.pi, 256)
    x = np.sin(t) + 0.1 * np.random.default_rng(3).standard_normal(256)
    w = spark.createDataFrame([("s", 1, x.tolist()), ("s", 2, [float("nan")] * 256)], "series_id string, window_id int, x array<double>")
    rows = training.train(w, 5, (training.Stage(60, 5e-3, "haar", param=param), training.Stage(60, 2.5e-3, param=param, early_stop=True))).orderBy("window_id").collect()
    start = training.loss_and_slope(x[None], training.haar_blocks(1, 5), 1.0)[0][0]
    assert rows[0]["loss"] < start and rows[0]["error"] is None and [h["stage"] for h in rows[0]["history"]] == [1, 2]
    assert rows[1]["error"] and rows[1]["loss"] is None


def test_learned_bank_is_used(wins):
    trained = training.train(wins, 3, (training.Stage(20, 5e-3, "haar"),))
    out = two_tap_synthesize(two_tap_analyze(trained, 3, "filters"), 3, "filters")
    assert out.select(F.max(metrics.rel_l2_error())).first()[0] < 1e-12


def test_budgets_and_thresholds(wins):
    rows = compression.threshold_per_level(two_tap_analyze(wins, 3), (0.1, 1.0)).collect()
    for r in rows:
        assert r["total"] == 56 and r["kept"] == (4 + 2 + 1 if r["retain"] < 1 else 56)
        assert sum(v != 0 for d in r["kept_details"] for v in d) == r["kept"]
        for d, k in zip(r["details"], r["kept_details"]):
            assert min((abs(a) for a, b in zip(d, k) if b), default=0) >= max((abs(a) for a, b in zip(d, k) if not b), default=0)


def test_constant_window(spark):
    t = spark.range(64).select(F.lit("s").alias("series_id"), F.col("id").alias("pos"), F.lit(3.0).alias("value"))
    w = series.prepare_window_dataset(t, 32)
    assert {r["sigma"] for r in w.collect()} == {1.0}
    out = idwt(dwt(w, "haar", 5), "haar", 5).withColumn("psnr", metrics.psnr())
    assert {(r["H"], r["psnr"]) for r in metrics.hurst_wavelet(out).collect()} == {(None, None)}


def test_white_noise_has_hurst_one_half(spark):
    x = np.random.default_rng(7).standard_normal((8, 1024))
    w = spark.createDataFrame([("s", i, r.tolist()) for i, r in enumerate(x)], "series_id string, window_id int, x array<double>")
    out = metrics.local_whittle(metrics.hurst_rs(metrics.dfa(metrics.hurst_wavelet(dwt(w, "haar", 10)), 1024), 1024))
    for c, gap in (("H", 0.2), ("H_dfa", 0.15), ("H_rs", 0.2), ("H_lw", 0.2)):
        assert abs(out.agg(F.avg(c)).first()[0] - 0.5) < gap


def test_whittle_finds_the_minimum(wins):
    h = [r["H_lw"] for r in metrics.local_whittle(wins).orderBy("window_id").collect()]
    for x, found in zip(X, h):
        m = 10
        freqs = 2 * np.pi * np.arange(1, m + 1) / 64
        power = np.abs(np.fft.rfft(x - x.mean()))[1 : m + 1] ** 2
        grid = np.linspace(-0.49, 0.49, 4001)
        assert abs(grid[training.np.argmin(metrics.whittle_objective(grid, freqs, power))] + 0.5 - found) < 1e-3


def test_welch_of_a_sine(spark):
    t = spark.range(4096).select(F.lit("s").alias("series_id"), F.col("id").alias("pos"), F.sin(2 * math.pi * F.col("id") * 50 / 1000).alias("value"))
    peak = spectral.welch_psd(t, 256).orderBy(F.desc("p")).first()
    assert abs(peak["f"] - 50) < 1000 / 256


def test_bootstrap_intervals(spark):
    v = np.random.default_rng(1).standard_normal(200)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)] + [("b", 0, 1.5)], "k string, i int, v double")
    for out in (stats.block_bootstrap_ci(df, ["k"], "v", "i", 5, 300), stats.block_bootstrap_ci(df, ["k"], "v", "i"), stats.block_bootstrap_ci(df, ["k"], "v", "i", 1, 300)):
        got = {r["k"]: r for r in out.collect()}
        assert got["a"]["ci_low"] < v.mean() < got["a"]["ci_high"] and got["a"]["ci_high"] - got["a"]["ci_low"] < 0.5
        assert got["b"]["ci_low"] == got["b"]["ci_high"] == 1.5


def test_quantiles_are_exact(spark):
    v = [float(x) for x in np.random.default_rng(2).integers(0, 40, 500)] + [7.0] * 300 + [1e6]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
    wanted = {"a": 0.0, "b": 0.013, "c": 0.25, "d": 0.5, "e": 0.9991, "f": 1.0}
    for values, rows in ((v, df), ([3.5], df.where("v is null").unionByName(spark.createDataFrame([(3.5,)], "v double")))):
        assert list(stats.quantiles(rows, "v", wanted, 16).first()) == pytest.approx([np.quantile(values, q) for q in wanted.values()])
    assert list(stats.quantiles(df.where("v is null"), "v", wanted).first()) == [None] * 6


def test_scan_trace(spark, tmp_path):
    from strandline.sources.tables import newest_file, scan_trace

    (tmp_path / "t.csv").write_text("".join(f"{i * 3}\n" for i in range(500)))
    rows = scan_trace(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["pos"], r["value"]) for r in rows] == [(i, 3.0 * i) for i in range(500)]
    assert newest_file(spark, str(tmp_path / "none*"), str(tmp_path / "*.csv")).endswith("t.csv")


def test_write_results_replaces_its_run(spark, tmp_path):
    from strandline.sources.tables import write_results

    for run, n in (("a", 3), ("b", 2), ("a", 5)):
        write_results(spark.range(n), str(tmp_path / "out"), run)
    assert Counter(r["run_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == {"a": 5, "b": 2}


def test_streamed_windows_equal_batch(spark, data, tmp_path):
    from strandline.streaming.windows import stream_windows

    t = registry.events_trace(spark, data).where("pos < 330").withColumn("x", F.lit("clash"))
    found = str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    stream = stream_windows(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in")), 64)
    for part in ("pos % 3 = 0", "pos % 3 > 0"):  # every window needs the state that the first run left
        t.where(part).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream.writeStream.format("parquet").option("path", found).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        done = q.awaitTermination(120)
        q.stop()
        assert done
        assert spark.read.schema(stream.schema).parquet(found).count() == (0 if part.endswith("= 0") else 5)
    late = t.where("pos < 128").unionByName(t.where("pos = 3").withColumn("pos", F.lit(-3).cast("long")))
    late.write.mode("append").parquet(str(tmp_path / "in"))  # copies of two windows that went out, and no window's sample
    q = stream.writeStream.format("parquet").option("path", found).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    done, states = q.awaitTermination(120), [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    q.stop()
    assert done and states[-1] == 6 and spark.read.schema(stream.schema).parquet(found).count() == 5
    batch = {r["window_id"]: r["x"] for r in series.window_series(t, 64).collect()}
    assert {r["window_id"]: r["x"] for r in spark.read.parquet(found).collect()} == batch


def test_incomplete_windows_time_out(spark, tmp_path):
    from strandline.streaming.windows import stream_windows

    rows = spark.createDataFrame([("s", i, float(i)) for i in range(12)], "series_id string, pos long, value double")
    rows.where("pos < 10").write.parquet(str(tmp_path / "in"))
    stream = stream_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 4, timeout_ms=1)
    q = stream.writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    dropped = False
    for _ in range(40):
        q.awaitTermination(1)
        dropped = any(p["batchId"] > 0 and p["stateOperators"][0]["numRowsTotal"] == 0 for p in q.recentProgress)
        if dropped:
            break
    q.stop()
    assert dropped and {r["window_id"] for r in spark.sql("select * from timed").collect()} == {1, 2}


def test_window_times(spark, data):
    from strandline.operators.evaluation import evaluated

    t = spark.createDataFrame([(1, 2.0), (1, 5.0), (2, 1.0), (3, None)], "window_id int, seconds double")
    assert stats.window_time(t).collect() == [(3, 3.0)]
    assert stats.window_time(t.where("false")).collect() == [(0, None)]
    found = evaluated(registry.windows(spark, data, 64), 64, ("haar", "db4"), (0.1, 0.4), measures=("seconds",)).cache()
    times = [r["seconds"] for r in found.collect()]
    assert times and all(0 < s < 60 for s in times)
    measured = stats.window_time(found).first()
    assert measured["windows"] == len(times) // 4 and min(times) <= measured["mean_seconds"] <= max(times)
    assert registry.QUERIES["window_time_measured"](spark, data).first()["windows"] == 0  # too short for its windows


def test_evaluation_equals_the_operators(spark):
    from strandline.operators.evaluation import evaluated

    x = np.random.default_rng(9).standard_normal((3, 256))
    w = spark.createDataFrame([("s", i + 1, r.tolist()) for i, r in enumerate(x)], "series_id string, window_id int, x array<double>")
    trained = training.train(w, 3, (training.Stage(10, 5e-3, "haar"),)).cache()
    retains = (0.1, 0.4)
    got = {(r["method"], r["window_id"], r["retain_ppm"]): r for r in evaluated(trained, 256, ("Daubechies-4", "haar", "haar_pool", "haar_bank", "learned"), retains, levels=3).collect()}
    assert len(got) == 30
    cut = {"haar_pool": compression.threshold_global}
    for method in ("db4", "haar", "haar_pool", "haar_bank", "learned"):
        bank = "filters" if method == "learned" else None
        n = 3 if method in ("haar_bank", "learned") else 8
        coefs = two_tap_analyze(trained, n, bank) if n == 3 else dwt(trained, method.removesuffix("_pool"), 8)
        kept = cut.get(method, compression.threshold_per_level)(coefs, retains)
        recon = two_tap_synthesize(kept, n, bank, "kept_details") if n == 3 else idwt(kept, method.removesuffix("_pool"), 8, "kept_details")
        rows = recon.withColumn("psnr", metrics.psnr()).select("window_id", "retain_ppm", "kept", "total", "psnr", F.col("recon").alias("x"))
        again = metrics.multifractal(metrics.hurst_wavelet(dwt(rows, "haar", 8), floor=1e-28))
        for r in again.collect():
            g = got[method, r["window_id"], r["retain_ppm"]]
            assert (g["kept"], g["total"]) == (r["kept"], r["total"])
            assert (g["psnr"], g["H"]) == pytest.approx((r["psnr"], r["H"]), abs=1e-6)
            for m in ("alpha_width", "alpha_peak", "f_alpha_peak"):  # negative powers of emptied places, which are rounding noise
                assert g[m] == pytest.approx(r[m], abs=0.05)
    widths = {r["window_id"]: r["alpha_width"] for r in metrics.multifractal(dwt(w, "haar", 8)).collect()}
    for r in evaluated(w, 256, ("haar",), (0.1,), measures=("width_orig",)).collect():
        assert r["width_orig"] == pytest.approx(widths[r["window_id"]], abs=1e-9)


def test_model_is_read_back(spark, wins, tmp_path):
    from strandline.sources.tables import write_results

    trained = training.train(wins, 3, (training.Stage(20, 5e-3, "haar"),))
    write_results(training.model_table(trained).where("window_id < 3"), str(tmp_path / "m"), "a")
    model = spark.read.parquet(str(tmp_path / "m")).where("run_id = 'a'")
    again = {r["window_id"]: r["filters"] for r in training.with_model(wins, model, 3).collect()}
    first = {r["window_id"]: r["filters"] for r in trained.collect()}
    assert all(again[i] == first[i] for i in (1, 2)) and again[3][0]["h"] == pytest.approx([math.sqrt(0.5)] * 2)


def test_gaps_are_closed_before_windows(spark):
    rows = [("s", i, float("nan") if i % 7 == 3 else None if i == 50 else float(i)) for i in range(400)]
    t = spark.createDataFrame(rows, "series_id string, pos long, value double")
    kept = [v for _, _, v in rows if v is not None and v == v]
    assert [r["value"] for r in series.compact(series.finite_filter(t), 32).orderBy("pos").collect()] == kept
    got = {r["window_id"]: r["x"] for r in series.prepare_window_dataset(t, 64, normalize=False).collect()}
    assert got == {i + 1: kept[i * 64 : i * 64 + 64] for i in range(256 // 64)}


def test_statistics_of_many_series(spark):
    t = spark.range(90).select((F.col("id") % 3).cast("string").alias("series_id"), F.expr("id div 3").alias("pos"), F.col("id").cast("double").alias("value"))
    n = series.dyadic_lengths(t)
    for most in (1, 10):
        assert series.with_statistics(t, n, most).where("pos < length_pow2").count() == 48
    assert series.with_statistics(t.limit(0), n.limit(0)).count() == 0
    plan = series.truncate_dyadic(spark.range(3_000_000_000).select(F.lit("all").alias("series_id"), F.col("id").alias("pos"), F.lit(1.0).alias("value")).where("pos < 100"))
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in plan._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 8


def cell(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    expected = con.execute(registry.SQL[name]).df()
    found = registry.QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    bag = lambda df: Counter(tuple(map(cell, r)) for r in df[columns].itertuples(index=False))
    assert bag(found) == bag(expected)
