"""Whole series in blocks against the same done in one array."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.wavelets import analyze, levels_of
from strandline.operators import long_series, metrics, stats
from strandline.plans import reports

KIND = "series_id string, pos long, value double"
FAMILIES = ("haar", "db4", "c3", "s8", "bior4.4")
LENGTHS = {"one": 1, "two": 2, "short": 64, "block": 256, "next": 512, "long": 4096, "longest": 8192}


@pytest.fixture(scope="module")
def several(spark):
    r = np.random.default_rng(4)
    held = {s: r.standard_normal(n).cumsum() for s, n in LENGTHS.items()}
    rows = [(s, p, float(v)) for s, x in held.items() for p, v in enumerate(x)]
    return held, spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], KIND).repartition(5).cache()


@pytest.mark.parametrize("family", FAMILIES)
def test_margins_give_a_blocks_part(family):
    x, n, own = np.random.default_rng(1).standard_normal(4096), 4096, 512
    for levels in (1, 2, 3):
        before, behind = long_series.margins(family, levels)
        whole, details = x[None], []
        for _ in range(levels):
            whole, d = analyze(whole, family)
            details.append(d)
        for b in (0, 3, 7):
            part = x[np.arange(b * own - before, (b + 1) * own + behind) % n]
            a, found = long_series.block_levels(part[None], family, levels, own)
            assert np.allclose(a[0], whole[0, b * (own >> levels) : (b + 1) * (own >> levels)])
            for j, d in enumerate(found, 1):
                assert np.allclose(d[0], details[j - 1][0, b * (own >> j) : (b + 1) * (own >> j)])


@pytest.mark.parametrize("family", FAMILIES)
def test_levels_of_several_series(several, family):
    held, t = several
    found = {(r["series_id"], r["level"]): (r["e"], r["n"], r["series_length"]) for r in long_series.level_energies(t, family, 256).collect()}
    expected = {}
    for s, x in held.items():
        x = x[None]
        for level in range(1, levels_of(LENGTHS[s]) + 1):
            x, d = analyze(x, family)
            expected[s, level] = (float((d * d).sum()), d.shape[1], LENGTHS[s])
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(expected[k], rel=1e-9) for k in expected)


def test_blocks_do_not_matter(several):
    t = several[1].where("series_id in ('long', 'short')")
    rows = [reports.global_hurst_summary(t, analysis="db4", block=b).orderBy("series_id").collect() for b in (128, 1024, 1 << 14)]
    for other in rows[1:]:
        assert [r["H"] for r in other] == pytest.approx([r["H"] for r in rows[0]]) and [r["num_levels"] for r in other] == [11, 5]


def test_edges(spark, several):
    assert long_series.level_energies(several[1].limit(0), "db4").count() == 0
    with pytest.raises(ValueError, match="too short"):
        long_series.level_energies(several[1], "c3", 16)
    flat = spark.range(1024).select(F.lit("s").alias("series_id"), F.col("id").alias("pos"), F.lit(0.0).alias("value"))
    row = reports.global_hurst_summary(flat, analysis="haar", block=128).collect()
    assert row == []  # no level has energy


def dfa_by_hand(x, order):
    """(scale, mean squared residual) by fitting every segment."""
    y, n, out = np.cumsum(x - x.mean()), len(x), {}
    for s in metrics.dfa_scales(n):
        if n // s >= 4:
            parts = [y[k * s : (k + 1) * s] for k in range(n // s)]
            i = np.linspace(-1, 1, s)
            out[s] = np.mean([np.mean((p - np.polyval(np.polyfit(i, p, order), i)) ** 2) for p in parts])
    return out


@pytest.mark.parametrize("order", (1, 2, 3))
def test_fluctuations_of_whole_series(spark, order):
    r = np.random.default_rng(order)
    held = {"a": r.standard_normal(5000), "b": r.standard_normal(777).cumsum() * 5 + 1000, "c": r.standard_normal(100), "d": r.standard_normal(20)}
    rows = [(s, p, float(v)) for s, x in held.items() for p, v in enumerate(x)]
    t = spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], KIND).repartition(4)
    for block in (64, 1000, 1 << 14):
        found = {(f["series_id"], f["s"]): f["f2"] for f in long_series.fluctuations(t, order, block).collect()}
        expected = {(s, k): v for s, x in held.items() for k, v in dfa_by_hand(x, order).items()}
        assert found.keys() == expected.keys()
        assert all(found[k] == pytest.approx(expected[k], rel=1e-6) for k in expected)
    for h in long_series.dfa(t, order, 256).collect():
        f = dfa_by_hand(held[h["series_id"]], order)
        assert h["H_dfa"] == pytest.approx(np.polyfit(np.log(list(f)), np.log(list(f.values())) / 2, 1)[0], rel=1e-6) if len(f) > 3 else h["H_dfa"] is None


@pytest.mark.parametrize("order", (2, 3))
def test_dfa_of_windows_by_order(spark, order):
    x = np.random.default_rng(9).standard_normal((3, 512))
    w = spark.createDataFrame([("s", i, r.tolist()) for i, r in enumerate(x)] + [("s", 9, [1.0] * 512)], "series_id string, window_id int, x array<double>")
    for r in metrics.dfa(w, 512, order=order).collect():
        if r["window_id"] == 9:
            assert r["H_dfa"] is None or abs(r["H_dfa"]) < 10
            continue
        f = dfa_by_hand(x[r["window_id"]], order)
        assert r["H_dfa"] == pytest.approx(np.polyfit(np.log(list(f)), np.log(list(f.values())) / 2, 1)[0], rel=1e-8)


def test_chirp_gives_fourier_terms():
    x = np.random.default_rng(3).standard_normal(1000)
    whole = np.fft.fft(x)[1:41]
    for cuts in ((0, 1000), (0, 1, 333, 999, 1000)):
        found = sum(long_series.lowest_terms(x[a:b], a, 1000, 40) for a, b in zip(cuts, cuts[1:]))
        assert np.allclose(found, whole, atol=1e-9)


def test_local_whittle_of_whole_series(spark):
    r = np.random.default_rng(6)
    held = {"noise": r.standard_normal(5000), "walk": r.standard_normal(3000).cumsum(), "flat": np.zeros(50), "tiny": np.ones(2)}
    t = spark.createDataFrame([(s, p, float(v)) for s, x in held.items() for p, v in enumerate(x)], KIND).repartition(4)
    for block in (128, 1 << 14):
        for f in long_series.local_whittle(t, block).collect():
            x = held[f["series_id"]]
            n, m = len(x), metrics.whittle_frequencies(len(x))
            if f["series_id"] in ("flat", "tiny"):
                assert f["H_lw"] is None and f["H_lw_ci_low"] is None
                continue
            power = np.abs(np.fft.rfft(x - x.mean())[1 : m + 1]) ** 2
            d = metrics.whittle_minimum(2 * np.pi * np.arange(1, m + 1) / n, power[None])[0]
            assert (f["n"], f["m"]) == (n, m) and f["H_lw"] == pytest.approx(d + 0.5, abs=1e-6) and f["H_lw_ci_high"] - f["H_lw"] == pytest.approx(0.98 / np.sqrt(m))


def resampled(values, block, n_boot, seed, ends):
    """The moving-block bootstrap as it is defined, with the digest's draws."""
    n, means = len(values), []
    size = max(1, min(block, n))
    for b in range(1, n_boot + 1):
        sample = []
        for j in range(1, -(-n // size) + 1):
            at = int(hashlib.md5(f"{seed}:{b}:{j}".encode()).hexdigest()[:12], 16) % (n - size + 1)
            sample += values[at : at + size]
        means.append(np.mean(sample[:n]))
    means.sort()
    if ends == "order":
        return means[max(1, int(0.025 * n_boot)) - 1], means[min(n_boot, math.ceil(0.975 * n_boot)) - 1]
    return np.quantile(means, 0.025), np.quantile(means, 0.975)


@pytest.mark.parametrize("block, ends", ((1, "order"), (4, "quantile"), (7, "quantile"), (50, "order")))
def test_moving_blocks(spark, block, ends):
    r = np.random.default_rng(block)
    groups = {"a": 1, "b": 2, "c": 13, None: 30, "d": 9000}
    rows = [(g, i * 3 + 5, float(v), i) for g, n in groups.items() for i, v in enumerate(r.standard_normal(n))]
    rows += [("a", 1, None, 0), ("c", 10**6, None, 0), ("gone", 1, None, 0)]
    df = spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], "g string, place long, v double, n long").repartition(4)
    few = df.where("g is null or g <> 'd'") if block == 1 else df
    found = {f["g"]: f for f in stats.moving_block_ci(few, ["g"], "v", "place", block, 40, 2, ends).collect()}
    assert found.keys() == {g for g in groups if block > 1 or g != "d"}
    for g, f in found.items():
        values = [v for k, _, v, _ in sorted((x for x in rows if x[2] is not None), key=lambda x: x[1]) if k == g]
        assert f["n"] == len(values) and f["mean"] == pytest.approx(np.mean(values))
        assert (f["ci_low"], f["ci_high"]) == pytest.approx(resampled(values, block, 40, 2, ends), abs=1e-9)


def test_moving_blocks_without_keys_or_replicates(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(20)], "place long, v double")
    values = [float(i % 7) for i in range(20)]
    one = stats.moving_block_ci(df, [], "v", "place", 3, 25).collect()
    assert len(one) == 1 and (one[0]["ci_low"], one[0]["ci_high"]) == pytest.approx(resampled(values, 3, 25, 1, "quantile"))
    plain = stats.moving_block_ci(df, [], "v", "place", 3, 0).first()
    assert plain["ci_high"] - plain["mean"] == pytest.approx(metrics.Z95 * np.std(values, ddof=1) / np.sqrt(20))
    assert stats.moving_block_ci(df.limit(0), ["place"], "v", "place").collect() == []
    with pytest.raises(ValueError, match="unknown ends"):
        stats.moving_block_ci(df, [], "v", "place", ends="nearest")


def test_describe(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal(700)
    rows = [(float(v), float(i % 3), None if i % 5 else float("nan"), i) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, n long").repartition(4)
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    found = {f["variable"]: f for f in stats.describe(df, ["a", "b", "c", "n"], parts=16).collect()}
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
    for name, values in (("a", x), ("b", [i % 3 for i in range(700)]), ("n", range(700))):
        f, v = found[name], np.array(list(values), float)
        assert (f["count"], f["missing"]) == (700, 0) and (f["mean"], f["std"]) == pytest.approx((v.mean(), v.std(ddof=1)))
        assert [f[k] for k in stats.FIVE] == pytest.approx([np.quantile(v, q) for q in stats.FIVE.values()])
    assert (found["c"]["count"], found["c"]["missing"], found["c"]["median"]) == (0, 700, None)
    assert stats.describe(df.limit(0), ["a"]).collect()[0]["count"] == 0
