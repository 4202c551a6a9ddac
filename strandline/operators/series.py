"""Series and windows: rows (series_id, pos, value) in, arrays per window out.

A series has an explicit position; nothing here relies on the order of rows. Windows are built with one shuffle on
(series_id, window_id); everything after that works on the array of a row and needs none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

EPS = 2.220446049250313e-16
KEYS = ["series_id", "window_id"]


def let(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are evaluated once for a row, however often later expressions use them.

    Spark merges neighbouring projections, and an array expression that lands within another's loop would be
    evaluated for every element; a generator of one row keeps them apart.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def trace(df: DataFrame, pos: str, value: str, series: str | None = None) -> DataFrame:
    """(series_id, pos, value) from any table that has a dense 0-based position."""
    name = F.col(series).cast("string") if series else F.lit("all")
    return df.select(name.alias("series_id"), F.col(pos).cast("long").alias("pos"), F.col(value).cast("double").alias("value"))


def first_numeric_column(df: DataFrame, skip: tuple[str, ...] = ()) -> str:
    """The first column of a numeric type, found in the schema without reading data."""
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType) and f.name not in skip:
            return f.name
    raise ValueError("no numeric column")


def finite() -> Column:
    return F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))


def finite_filter(t: DataFrame) -> DataFrame:
    """Samples that are neither null, NaN nor infinite."""
    return t.where(finite())


def with_statistics(t: DataFrame, statistics: DataFrame, most: int = 10_000) -> DataFrame:
    """t with the columns of statistics (a row per series_id); series without a row fall out.

    Statistics are computed once, here. One series gets them as literals, so a filter on them reaches the scan; up to
    `most` series get them by a broadcast of that many small rows; beyond that both sides are shuffled by series.
    """
    rows = statistics.limit(most + 1).collect()
    return t.join(statistics, "series_id") if len(rows) > most else with_rows(t, rows, statistics.schema)


def with_rows(t: DataFrame, rows: list, schema: T.StructType) -> DataFrame:
    """with_statistics() of a few rows that are known already."""
    if len(rows) == 1:
        return t.where(F.col("series_id") == rows[0]["series_id"]).select("*", *(F.lit(rows[0][f.name]).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != "series_id"))
    return t.join(F.broadcast(t.sparkSession.createDataFrame(rows, schema)), "series_id")


def compact(t: DataFrame, block: int = 65_536) -> DataFrame:
    """t with dense positions in the old order, from 0 in each series: what is left after samples were dropped.

    Positions count anew within blocks of old ones, and a running sum of the blocks' counts is added, so no task sees a
    whole series; of rows with one position any comes first. Sums by block are all that is ordered for a series.
    """
    rows = t.withColumn("_block", F.expr(f"pos div {block}"))
    counts = rows.groupBy("series_id", "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("series_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("series_id", "_block").orderBy("pos", "value")) - 1
    out = rows.withColumn("_place", place).join(counts.select("series_id", "_block", before.alias("_before")), ["series_id", "_block"])
    return out.select("series_id", (F.col("_before") + F.col("_place")).alias("pos"), "value")


def dyadic_lengths(t: DataFrame) -> DataFrame:
    """series_id, n, length_pow2 (the largest power of two within n) and removed."""
    n = t.groupBy("series_id").agg(F.count("*").alias("n"))
    return n.select("series_id", "n", dyadic().alias("length_pow2"), (F.col("n") - dyadic()).alias("removed"))


def dyadic(n: str = "n") -> Column:
    return F.expr(f"shiftleft(1L, length(bin({n})) - 1)")


def truncate_dyadic(t: DataFrame) -> DataFrame:
    """The first 2 ** floor(log2 n) samples of each series."""
    return with_statistics(t, dyadic_lengths(t).select("series_id", "length_pow2")).where("pos < length_pow2").drop("length_pow2")


def window_series(t: DataFrame, size: int, step: int | None = None, tasks: int | None = None, alone: bool = False) -> DataFrame:
    """series_id, window_id (from 1), x: full windows of `size` samples every `step`; a partial tail is dropped.

    One shuffle of the samples, into `tasks` tasks if given, whether windows overlap or not. alone: t is a single series,
    whose name is a constant in the plan, so it can't take part in the keys by which the shuffle serves the grouping.
    """
    step = step or size
    if size < 1 or step < 1:
        raise ValueError("window size and step must be positive")
    if step < size:
        return overlapping(t, size, step, tasks, alone)
    rows = t.where(F.expr(f"pos % {step} < {size}")) if step > size else t
    rows = rows.select("series_id", F.expr(f"int(pos div {step} + 1)").alias("window_id"), "pos", "value")
    rows = rows.repartition(tasks, *KEYS[alone:]) if tasks else rows
    return let(rows.groupBy(*KEYS).agg(F.collect_list(F.struct("pos", "value")).alias("x")).where(F.size("x") == size), x=F.transform(F.array_sort("x"), lambda s: s["value"]))


def overlapping(t: DataFrame, size: int, step: int, tasks: int | None = None, alone: bool = False) -> DataFrame:
    """window_series() for windows that overlap.

    Samples are grouped once, into panes of many steps. A window that reaches into the next pane needs only that one's
    first samples, so of a pane no more than `size` samples are shuffled again, to the pane before it.
    """
    pane = step * max(1, -(-16 * size // step))
    rows = t.select("series_id", F.expr(f"pos div {pane}").alias("_pane"), "pos", "value")
    rows = rows.repartition(tasks, *["series_id", "_pane"][alone:]) if tasks else rows
    own = rows.groupBy("series_id", "_pane").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_s"))
    head = F.filter(F.slice("_s", 1, F.lit(size)), lambda s: s["pos"] < F.col("_pane") * pane + size)
    heads = own.select("series_id", (F.col("_pane") - 1).alias("_before"), head.alias("_next")).withColumnRenamed("_before", "_pane")
    both = own.join(heads, ["series_id", "_pane"], "left")
    both = let(both, _s=F.when(F.col("_next").isNull(), F.col("_s")).otherwise(F.concat("_s", "_next")), _own=F.size("_s"))
    starts = F.sequence(F.lit(0), F.lit(pane // step - 1))
    first = F.col("_pane") * pane + F.col("_w") * step
    # where nothing is missing a window's place is known; else its first sample is looked up
    whole = F.col("_own") == pane
    place = F.when(whole, F.col("_w") * step + 1).otherwise(F.array_position(F.transform("_s", lambda s: s["pos"]), first)).cast("int")
    cut = both.withColumn("_w", F.explode(starts)).withColumn("_at", place).where("_at > 0")
    cut = let(cut.withColumn("_first", first), x=F.slice("_s", F.col("_at"), F.lit(size)))
    full = (F.size("x") == size) & (F.get("x", 0)["pos"] == F.col("_first")) & (F.get("x", size - 1)["pos"] == F.col("_first") + size - 1)
    return cut.where(full).select("series_id", F.expr(f"int(_first div {step} + 1)").alias("window_id"), F.transform("x", lambda s: s["value"]).alias("x"))


def overlap_windows(t: DataFrame, size: int, overlap: float) -> DataFrame:
    """Windows whose step is max(1, floor(size * (1 - overlap)))."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    return window_series(t, size, max(1, math.floor(size * (1 - overlap))))


def window_slice(windows: DataFrame, start: int = 1, count: int = 0) -> DataFrame:
    """Windows from `start` on, `count` of them (0: all)."""
    out = windows.where(F.col("window_id") >= start)
    return out.where(F.col("window_id") < start + count) if count else out


def make_windows(t: DataFrame, size: int, step: int, most: int) -> DataFrame:
    """The first `most` windows; samples beyond the last of them are never grouped."""
    return window_series(t.where(F.col("pos") < (most - 1) * step + size), size, step)


def total(x: Column, f=lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + f(v))


def squares(x: Column) -> Column:
    """The sum of squared distances from the mean, by Welford's updates in the order of the samples.

    Databases have deviations so, and equal last bits matter: coefficients that are equal or zero by rule differ by these
    bits only, and they say which of them is the larger, or whether one is zero.
    """
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

    def update(s: Column, v: Column) -> Column:
        mean = s["m"] + (v - s["m"]) / (s["n"] + 1.0)
        return F.struct((s["n"] + 1.0).alias("n"), mean.alias("m"), (s["q"] + (v - mean) * (v - s["m"])).alias("q"))

    return F.aggregate(x, start, update)["q"]


def normalize_windows(windows: DataFrame) -> DataFrame:
    """x as (x - mean) / sample deviation, with mu and sigma; a deviation below machine epsilon counts as 1."""
    n = F.size("x")
    out = let(windows, mu=total(F.col("x")) / n)
    out = let(out, sigma=F.sqrt(F.try_divide(squares(F.col("x")), (n - 1).cast("double"))))
    out = let(out, sigma=F.when(F.coalesce("sigma", F.lit(0.0)) < EPS, 1.0).otherwise(F.col("sigma")))
    return let(out, x=F.transform("x", lambda v: (v - F.col("mu")) / F.col("sigma")))


def zscore(t: DataFrame) -> DataFrame:
    """The whole series as z-scores."""
    s = t.groupBy("series_id").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sigma"))
    s = s.withColumn("sigma", F.when(F.coalesce("sigma", F.lit(0.0)) < EPS, 1.0).otherwise(F.col("sigma")))
    return with_statistics(t, s).withColumn("z", (F.col("value") - F.col("mu")) / F.col("sigma"))


def window_tasks(windows: int, size: int, cores: int, most: int = 4096, task_bytes: int = 1 << 30) -> int:
    """How many tasks so many windows are dealt to.

    What is done to a window costs far more than its bytes tell, so tasks must not be joined by bytes: 64 windows a task
    or as few as the cores take at once, until `most` tasks are full; then more windows a task, up to `task_bytes`.
    """
    by_cost = max(1, min(windows, max(cores, windows // 64)))
    return max(min(by_cost, most), -(-windows * size * 8 // task_bytes))


def facts(t: DataFrame) -> DataFrame:
    """series_id, n, good (finite samples) and whether positions run from 0 on without a gap: one pass over the series."""
    found = t.groupBy("series_id").agg(F.count("*").alias("n"), F.count_if(finite()).alias("good"), F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    return found.select("series_id", "n", "good", ((F.col("_lo") == 0) & (F.col("_hi") == F.col("n") - 1)).alias("dense"))


def prepare_window_dataset(t: DataFrame, size: int, step: int | None = None, normalize: bool = True, most: int = 10_000) -> DataFrame:
    """Finite samples, numbered anew if any was dropped, dyadic truncation, windows, normalisation.

    One pass for what the plan needs to know of the series, and one shuffle of their samples.
    """
    known = facts(t).where("good > 0").withColumn("length_pow2", dyadic("good"))
    rows = known.limit(most + 1).collect()
    few = len(rows) <= most
    if few:
        dropped, dense = any(r["n"] > r["good"] for r in rows), all(r["dense"] for r in rows)
        samples = sum(r["length_pow2"] for r in rows)
    else:
        r = known.agg(F.max(F.col("n") > F.col("good")).alias("dropped"), F.min("dense").alias("dense"), F.sum("length_pow2").alias("samples")).first()
        dropped, dense, samples = r["dropped"], r["dense"], r["samples"]
    ok = finite_filter(t) if dropped else t
    ok = compact(ok) if dropped or not dense else ok
    lengths = known.select("series_id", "length_pow2")
    cut = with_rows(ok, [Row(series_id=r["series_id"], length_pow2=r["length_pow2"]) for r in rows], lengths.schema) if few else ok.join(lengths, "series_id")
    tasks = window_tasks(samples // (step or size) + 1, size, t.sparkSession.sparkContext.defaultParallelism)
    windows = window_series(cut.where("pos < length_pow2").drop("length_pow2"), size, step, tasks, len(rows) == 1)
    return normalize_windows(windows) if normalize else windows


def aggregate_series(t: DataFrame, factor: int, how: str = "mean") -> DataFrame:
    """Means or sums of blocks of `factor` samples; a partial tail is dropped, and a series with no full block stays."""
    return multiscale(t, [factor], how).drop("factor")


def multiscale(t: DataFrame, factors: list[int], how: str = "mean") -> DataFrame:
    """factor, series_id, pos, value: the series aggregated at every factor in one pass."""
    if how not in ("mean", "sum"):
        raise ValueError(f"unknown aggregation {how}")
    n = t.groupBy("series_id").agg(F.count("*").alias("n"))
    rows = with_statistics(t, n).withColumn("factor", F.explode(F.array(*(F.lit(int(f)) for f in factors))))
    rows = rows.withColumn("factor", F.when(F.col("n") < F.col("factor"), 1).otherwise(F.col("factor")))
    rows = rows.where(F.expr("pos < n - n % factor"))
    agg = F.avg("value") if how == "mean" else F.sum("value")
    return rows.groupBy("factor", "series_id", F.expr("pos div factor").alias("pos")).agg(agg.alias("value"))


def multiscale_factors(fs: float, millis: list[float]) -> list[int]:
    """Aggregation factors of time scales in milliseconds: at least 1, each once, in the order given."""
    return list(dict.fromkeys(max(1, round(fs * m / 1000)) for m in millis))


def downsample(t: DataFrame, most: int) -> DataFrame:
    """At most `most` samples at evenly spaced positions, rounded half to even, both ends included."""
    n = t.groupBy("series_id").agg(F.count("*").alias("n"))
    rows = with_statistics(t, n)
    if most < 2:
        return rows.where("pos = 0").drop("n")
    # A position is taken if some i of 0..most-1 lands on it: only the i nearest to it and its neighbours can.
    near = F.expr(f"round(pos * {most - 1}D / greatest(n - 1, 1))")
    hit = F.exists(F.transform(F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0)), lambda o: near + o), lambda i: (i >= 0) & (i <= most - 1) & (F.bround(i * (F.col("n") - 1) / float(most - 1)) == F.col("pos")))
    return rows.where((F.col("n") <= most) | hit).drop("n")
