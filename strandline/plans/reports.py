"""Reports: what is computed for every window, method and share to retain, and what is summarised from that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.wavelets import MANDATORY, canonical
from ..operators import compression, long_series, metrics, stats, training
from ..operators.evaluation import LEARNED, SHORT, evaluated
from ..operators.transforms import two_tap_analyze, two_tap_synthesize

KEYS = ["series_id", "window_id"]


def run_window(windows: DataFrame, size: int, retains: tuple[float, ...] = compression.RETAINS, levels: int = 5, baselines: tuple[str, ...] = ("haar", *MANDATORY), schedule: tuple[training.Stage, ...] = training.PIPELINE_SCHEDULE, learned: bool = True, analysis: str = "db4") -> DataFrame:
    """Learned bank and every baseline for each window and share, as a long table; windows are read and trained once.

    H and spectra are measured by the levels of the analysis family.
    """
    base = training.train(windows, levels, schedule) if learned else windows
    return evaluated(base, size, (*([LEARNED] if learned else []), *baselines), retains, levels=levels, analysis=analysis)


def run_window_sequential(windows: DataFrame, size: int, retains: tuple[float, ...], levels: int = 5, learned: bool = True, analysis: str = "db4") -> DataFrame:
    """One method only: the learned bank, or the same bank with Haar filters."""
    return run_window(windows, size, retains, levels, (), analysis=analysis) if learned else evaluated(windows, size, (SHORT,), retains, levels=levels, analysis=analysis)


def wide(results: DataFrame, values: tuple[str, ...] = ("psnr", "H", "deltaH", "alpha_width", "kept", "total"), methods: tuple[str, ...] = ("learned", "haar", *MANDATORY)) -> DataFrame:
    """A row per window and share with a column per method and value."""
    return results.groupBy("window_id", "retain_ppm").pivot("method", list(methods)).agg(*(F.first(v).alias(v) for v in values))


def pr_report(windows: DataFrame, levels: int = 5, filters: str | None = None) -> DataFrame:
    """Perfect-reconstruction checks of a bank: errors of nothing removed, energy balance, mean |d|."""
    out = two_tap_synthesize(two_tap_analyze(windows, levels, filters), levels, filters)
    return out.select(*KEYS, metrics.pr_check().alias("pr"), metrics.rel_l2_error().alias("rel_l2_error"), metrics.parseval_error().alias("parseval_error"), metrics.sparsity_loss().alias("sparsity_loss")).select(*KEYS, "pr.*", "rel_l2_error", "parseval_error", "sparsity_loss")


def global_hurst_summary(t: DataFrame, low: int = 2, analysis: str = "db4", block: int = 1 << 14) -> DataFrame:
    """Hurst exponent with its interval for whole dyadic series (series_id, pos, value), by all levels of a family.

    residual_std, level range, family, length and the parameters stand beside it, as in a run's summary.
    """
    energies = long_series.level_energies(t, analysis, block).where((F.col("level") >= low) & (F.col("e") > 0)).select("series_id", "level", F.log2(F.col("e") / F.col("n")).alias("y"), "series_length")
    x, y = F.col("level"), F.col("y")
    fit = energies.groupBy("series_id").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.count("*").alias("num_levels"), F.min("level").alias("level_min"), F.max("level").alias("level_max"), F.max("series_length").alias("series_length"))
    fit = fit.withColumn("residual_variance", F.when(F.col("num_levels") >= 3, F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy")) / F.greatest(F.col("num_levels") - 2, F.lit(1))))
    fit = fit.withColumn("H", (F.col("slope") + 1) / 2).withColumn("se_slope", F.sqrt(F.try_divide(F.col("residual_variance"), F.col("sxx")))).withColumn("se_H", F.col("se_slope") / 2)
    cut = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    fit = fit.withColumn("residual_std", F.sqrt("residual_variance")).withColumn("dof", F.col("num_levels") - 2).withColumn("wavelet", F.lit(canonical(analysis))).withColumn("min_level_param", F.lit(low)).withColumn("alpha", F.lit(0.05))
    ends = (cut(F.col("H") - metrics.Z95 * F.col("se_H")).alias("ci_low"), cut(F.col("H") + metrics.Z95 * F.col("se_H")).alias("ci_high"))
    return fit.select("series_id", "H", *ends, "slope", "intercept", "se_H", "se_slope", "residual_variance", "residual_std", "dof", "num_levels", "level_min", "level_max", "min_level_param", "alpha", "wavelet", "series_length")


def hurst_summary(values: DataFrame, value: str = "H", keys: list[str] | None = None, levels: tuple[str, int] | None = None, n_boot: int = 0, block: int = 8, seed: int = 1) -> DataFrame:
    """n, mean, std, standard error and normal interval of per-window exponents; with n_boot also the interval of a
    block bootstrap (ci_boot_low, ci_boot_high). levels: a column of level numbers and the one to keep, rounded."""
    keys = keys or []
    values = values.where(F.bround(levels[0]) == levels[1]) if levels else values
    out = values.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("h_mean"), F.stddev_samp(value).alias("h_std"))
    out = out.withColumn("se", F.col("h_std") / F.sqrt("n"))
    out = out.withColumn("ci_norm_low", F.col("h_mean") - 1.96 * F.col("se")).withColumn("ci_norm_high", F.col("h_mean") + 1.96 * F.col("se"))
    if not n_boot:
        return out
    boot = stats.block_bootstrap_ci(values, keys, value, "window_id", block, n_boot, seed).select(*keys, F.col("ci_low").alias("ci_boot_low"), F.col("ci_high").alias("ci_boot_high"))
    return out.join(boot, keys) if keys else out.crossJoin(boot)  # one row each


def multifractal_diag(spectra: DataFrame) -> DataFrame:
    """Mean width with its interval; multifractal if the mean exceeds 0.1 and the interval lies above zero."""
    out = stats.block_bootstrap_ci(spectra, ["series_id"], "alpha_width", "window_id")
    return out.withColumn("diagnosis", F.when((F.col("mean") > 0.1) & (F.col("ci_low") > 0), "multifractal").otherwise("monofractal"))


def diagnosed(resampled: DataFrame) -> DataFrame:
    """resampled_spectra() with a verdict by window: multifractal if the mean width exceeds 0.1 and its lower end is above zero."""
    yes = (F.col("alpha_width_mean") > 0.1) & (F.col("alpha_width_lower") > 0)
    return resampled.withColumn("diagnosis", F.when(yes, "multifractal").otherwise("monofractal"))


def paired_gain(results: DataFrame, a: str, b: str, value: str = "psnr", n_boot: int = 0, seed: int = 1) -> DataFrame:
    """Per share the mean of a's value less b's over windows that both have, with the interval of the differences."""
    pairs = stats.paired(results.where(F.col("method") == a), results.where(F.col("method") == b), value)
    return stats.block_bootstrap_ci(pairs, ["retain_ppm"], "gain", "window_id", 8, n_boot, seed)


def delta_h_summary(results: DataFrame, n_boot: int = 0) -> DataFrame:
    """Per share and method the mean change of H with its interval."""
    return stats.block_bootstrap_ci(results, ["method", "retain_ppm"], "deltaH", "window_id", 8, n_boot)


def align_cr_series(results: DataFrame, main: str, others: tuple[str, ...]) -> DataFrame:
    """Per share the compression ratio, each method's mean and std of PSNR, and gains as differences of the means.

    Every share of the main method has a row; methods without it have nulls. The gains are not paired.
    """
    by = results.groupBy("retain_ppm").pivot("method", [main, *others]).agg(F.avg("psnr").alias("mean"), F.stddev_samp("psnr").alias("std"))
    by = by.where(F.col(f"{main}_mean").isNotNull())
    return by.withColumn("cr", 1e6 / F.col("retain_ppm")).select("*", *((F.col(f"{main}_mean") - F.col(f"{o}_mean")).alias(f"gain_{o}") for o in others))


def robustness(results: DataFrame, main: str, baselines: tuple[str, ...], covariates: dict[str, str]) -> DataFrame:
    """baseline, metric, retain_ppm, r, slope, intercept, n of the PSNR gain over a covariate of the main method's windows."""
    a = results.where(F.col("method") == main).select("window_id", "retain_ppm", "psnr", *covariates)
    b = results.where(F.col("method").isin(list(baselines))).select("window_id", "retain_ppm", F.col("method").alias("baseline"), F.col("psnr").alias("_b"))
    rows = a.join(b, ["window_id", "retain_ppm"]).withColumn("gain", F.col("psnr") - F.col("_b"))
    long = rows.select("baseline", "retain_ppm", "gain", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).alias("v")) for c, m in covariates.items()))).alias("_c")).select("baseline", "retain_ppm", "gain", "_c.*")
    return stats.correlation(long, ["baseline", "metric", "retain_ppm"], "v", "gain")


def method_stats(results: DataFrame, values: tuple[str, ...] = ("deltaH", "psnr", "alpha_width")) -> DataFrame:
    """Per method, share and metric: n, mean, std and the margin of the mean."""
    long = results.select("method", "retain_ppm", F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).alias("v")) for v in values))).alias("_m")).select("method", "retain_ppm", "_m.*")
    out = long.where("v is not null").groupBy("method", "retain_ppm", "metric").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    return out.withColumn("margin", stats.confidence_margin(F.col("n"), F.col("std")))


def raw_hurst_report(windows: DataFrame, size: int, trace: DataFrame | None = None, order: int = 1, n_boot: int = 500, seed: int = 1) -> DataFrame:
    """Mean, std and bootstrap interval of DFA over windows; with the whole trace (series_id, pos, value) also its length
    and its local Whittle estimate with the interval of 1.96 standard errors."""
    h = metrics.dfa(windows, size, order=order).select("series_id", "window_id", "H_dfa")
    names = {"n": "dfa_windows", "mean": "H_dfa_mean", "std": "H_dfa_std", "ci_low": "H_dfa_ci_low", "ci_high": "H_dfa_ci_high"}
    out = stats.moving_block_ci(h, ["series_id"], "H_dfa", "window_id", 1, n_boot, seed, "order").withColumnsRenamed(names)
    if trace is None:
        return out
    whole = long_series.local_whittle(trace).withColumnsRenamed({"n": "N", "m": "lw_m"})
    return whole.join(out, "series_id", "left")


def external_compare(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Mean PSNR by share of two tables for the shares that both have, and each one's change from the reference share."""
    a = ours.groupBy("retain_ppm").agg(F.avg("psnr").alias("psnr"))
    b = theirs.groupBy("retain_ppm").agg(F.avg("psnr").alias("psnr"))
    left = stats.delta_vs_reference(a.join(b, "retain_ppm", "left_semi"), "psnr").select("retain_ppm", F.col("psnr").alias("psnr_ours"), F.col("delta").alias("delta_ours"))
    right = stats.delta_vs_reference(b.join(a, "retain_ppm", "left_semi"), "psnr").select("retain_ppm", F.col("psnr").alias("psnr_theirs"), F.col("delta").alias("delta_theirs"))
    return left.join(right, "retain_ppm")


def external_summary(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row: how many shares both tables have, each one's mean PSNR at the largest of these, and by how much ours is
    better on the mean, as it is and from the reference share on."""
    both = external_compare(ours, theirs)
    at_most = lambda c: F.max_by(c, "retain_ppm").alias(f"{c}_at_most")
    gain = lambda c: F.avg(F.col(f"{c}_ours") - F.col(f"{c}_theirs"))
    return both.agg(F.count("*").alias("shares"), at_most("psnr_ours"), at_most("psnr_theirs"), gain("psnr").alias("mean_gain"), gain("delta").alias("mean_delta_gain"))

