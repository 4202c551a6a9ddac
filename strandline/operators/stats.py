"""Summaries, resampling and comparisons of per-window results, as grouped aggregations."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import Z95


#: Shares of a Poisson variable of mean one that are at or below 0, 1, 2, ...
POISSON = tuple(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(9))


def poisson_weight(seed: int, *parts: Column) -> Column:
    """How often a block counts in a replicate: a Poisson number of mean one, drawn by a digest of seed and parts."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("double") / 2.0**32
    return sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))


def block_bootstrap_ci(df: DataFrame, keys: list[str], value: str, order: str, block: int = 8, n_boot: int = 0, seed: int = 1) -> DataFrame:
    """keys, n, mean, std, ci_low, ci_high of value by block bootstrap.

    With n_boot = 0 the interval is the normal one. Otherwise `block` neighbours in the whole numbers of `order` make a
    block, and a replicate is the mean over blocks that each count a Poisson number of times; the interval's ends are
    its quantiles. Blocks are summed first, and replicates are summed within tasks before they are shuffled, so no group
    holds a series, however long. Replicates that drew no block are left out; a group of one block has its mean as both
    ends. Nulls are left out.
    """
    rows = df.where(F.col(value).isNotNull())
    std = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), std.alias("std"))
    if n_boot <= 0:
        gap = Z95 * F.col("std") / F.sqrt("n")
        return out.withColumn("ci_low", F.col("mean") - gap).withColumn("ci_high", F.col("mean") + gap)
    number = F.floor((F.col(order) - 1) / max(1, block)).cast("long")
    blocks = rows.groupBy(*keys, number.alias("_block")).agg(F.sum(value).alias("_sum"), F.count("*").alias("_n"))
    drawn = blocks.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    drawn = drawn.withColumn("_w", poisson_weight(seed, F.col("_b").cast("string"), F.col("_block").cast("string"))).where("_w > 0")
    means = drawn.groupBy(*keys, "_b").agg((F.sum(F.col("_w") * F.col("_sum")) / F.sum(F.col("_w") * F.col("_n"))).alias("_mean"))
    ends = means.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.expr("percentile(_mean, 0.025)").alias("ci_low"), F.expr("percentile(_mean, 0.975)").alias("ci_high"))
    same = [out[k].eqNullSafe(ends[f"_k{i}"]) for i, k in enumerate(keys)]
    joined = out.join(ends, reduce(lambda a, b: a & b, same)) if keys else out.crossJoin(ends)  # without keys one row each
    return joined.select(*keys, "n", "mean", "std", "ci_low", "ci_high")


def ranked_sums(rows: DataFrame, part: int = 4096) -> DataFrame:
    """_g, _i, _p: of the values of each group in order, the first _i of them and their sum, for every _i from 1 on.

    rows: _g, _o (a whole number that gives the order) and _v. Places and sums run within parts of the order, and a
    running sum over the parts' own is added, so no task holds a group.
    """
    rows = rows.withColumn("_part", F.floor(F.col("_o") / part).cast("long"))
    parts = rows.groupBy("_g", "_part").agg(F.count("*").alias("_c"), F.sum("_v").alias("_s"))
    earlier = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("_g", "_part", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c"), F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s"))
    inside = Window.partitionBy("_g", "_part").orderBy("_o", "_v")
    placed = rows.withColumn("_i", F.row_number().over(inside)).withColumn("_p", F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.join(before, ["_g", "_part"]).select("_g", (F.col("_i") + F.col("_c")).alias("_i"), (F.col("_p") + F.col("_s")).alias("_p"))


def drawn(seed: int, b: Column, j: Column, n: Column) -> Column:
    """The start of the j-th block of replicate b: a digest modulo the number of starts."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), b.cast("string"), j.cast("string"))), 1, 12), 16, 10).cast("long"), n)


def moving_block_ci(df: DataFrame, keys: list[str], value: str, order: str, block: int = 8, n_boot: int = 500, seed: int = 1, ends: str = "quantile", alpha: float = 0.05) -> DataFrame:
    """keys, n, mean, std, ci_low, ci_high of value by moving blocks.

    The n values of a group, in the whole numbers of `order`, have n - block + 1 blocks of neighbours that overlap. A
    replicate draws ceil(n / block) of them with replacement, cuts the last so that n values are drawn in all, and takes
    their mean. Blocks of one value are the plain bootstrap. The interval's ends are quantiles of the replicates between
    ranks, or (ends "order") the replicates of rank floor(alpha / 2 B) and ceil((1 - alpha / 2) B). With n_boot 0 the
    interval is the normal one. A single value has itself as ends; nulls are left out.

    Every block's sum is a difference of two running sums, found by a join on places; drawn places are joined with these
    sums and added up by replicate, so no group stands in one task, however long its series. Draws are made in as many tasks
    as the session has shuffle partitions. They outnumber by far what Spark takes them for, the few groups that they come
    from; as the left side of a left join they are never sent to all tasks by way of the driver, as block sums may be where
    they are few.
    """
    group = F.struct(*keys) if keys else F.lit(0)
    rows = df.where(F.col(value).isNotNull()).select(group.alias("_g"), F.col(order).cast("long").alias("_o"), F.col(value).cast("double").alias("_v"))
    totals = rows.groupBy("_g").agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("std"))
    named = [F.col("_g")[k].alias(k) for k in keys]
    if n_boot <= 0:
        gap = Z95 * F.col("std") / F.sqrt("n")
        return totals.select(*named, "n", "mean", "std", (F.col("mean") - gap).alias("ci_low"), (F.col("mean") + gap).alias("ci_high"))
    size = F.least(F.lit(max(1, block)).cast("long"), F.col("n"))
    shape = totals.select("_g", "n", size.alias("_b")).withColumn("_k", F.expr("(n + _b - 1) div _b")).withColumn("_r", F.expr("n - (_k - 1) * _b"))
    sums = ranked_sums(rows).unionByName(totals.select("_g", F.lit(0).cast("long").alias("_i"), F.lit(0.0).alias("_p")))
    at = lambda shift, kind: F.struct((F.col("_i") - shift).alias("_s"), F.lit(kind).alias("_kind"))
    starts = sums.join(shape, "_g").select("_g", "_p", "n", "_b", F.inline(F.array(at(F.lit(0), 0), at(F.col("_b"), 1), at(F.col("_r"), 2)))).where("_s >= 0 and _s <= n - _b")
    pick = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_p")))
    starts = starts.groupBy("_g", "_s").agg((pick(1) - pick(0)).alias("_whole"), (pick(2) - pick(0)).alias("_cut"))
    chunk = 4096
    draws = shape.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n_boot)))).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_k - 1) div {chunk}"))))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = draws.repartition(tasks, "_g", "b", "_c").withColumn("_j", F.explode(F.sequence(F.col("_c") * chunk + 1, F.least(F.col("_c") * chunk + chunk, F.col("_k")))))
    draws = draws.select("_g", "b", (F.col("_j") == F.col("_k")).alias("_last"), drawn(seed, F.col("b"), F.col("_j"), F.col("n") - F.col("_b") + 1).alias("_s"))
    found = draws.join(starts, ["_g", "_s"], "left").groupBy("_g", "b").agg(F.sum(F.when(F.col("_last"), F.col("_cut")).otherwise(F.col("_whole"))).alias("_sum"))
    means = found.join(totals.select("_g", "n"), "_g").select("_g", (F.col("_sum") / F.col("n")).alias("_m"))
    if ends == "quantile":
        low, high = F.expr(f"percentile(_m, {alpha / 2})"), F.expr(f"percentile(_m, {1 - alpha / 2})")
    elif ends == "order":
        ranks = max(1, math.floor(alpha / 2 * n_boot)), min(n_boot, math.ceil((1 - alpha / 2) * n_boot))
        low, high = (F.element_at(F.sort_array(F.collect_list("_m")), r) for r in ranks)  # n_boot numbers
    else:
        raise ValueError(f"unknown ends {ends!r}")
    return totals.join(means.groupBy("_g").agg(low.alias("ci_low"), high.alias("ci_high")), "_g").select(*named, "n", "mean", "std", "ci_low", "ci_high")


def moving_sql(keys: str, value: str, source: str, order: str, block: int, n_boot: int, seed: int = 1, ends: str = "quantile", alpha: float = 0.05) -> str:
    """moving_block_ci() for DuckDB, value by value as it is defined; results rounded to six places."""
    names = [k.strip() for k in keys.split(",")]
    by, using = ", ".join(names), f"USING ({', '.join(names)})"
    if ends == "quantile":
        low, high = f"quantile_cont(m, {alpha / 2})", f"quantile_cont(m, {1 - alpha / 2})"
    else:
        low, high = (f"list_sort(list(m))[{r}]" for r in (max(1, math.floor(alpha / 2 * n_boot)), min(n_boot, math.ceil((1 - alpha / 2) * n_boot))))
    ranked = f"SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY {order}, {value}) - 1 AS i, {value} AS v FROM {source} WHERE {value} IS NOT NULL"
    shape = f"SELECT {by}, count(*) AS n, least({block}, count(*)) AS bs, avg({value}) AS mean, coalesce(stddev_samp({value}), 0) AS std FROM {source} WHERE {value} IS NOT NULL GROUP BY {by}"
    draws = f"SELECT {by}, n, bs, b, j, CAST('0x' || substr(md5('{seed}:' || b || ':' || j), 1, 12) AS BIGINT) % (n - bs + 1) AS s FROM (SELECT *, unnest(range(1, (n + bs - 1) // bs + 1)) AS j FROM ({shape})), (SELECT unnest(range(1, {n_boot + 1})) AS b)"
    values = f"SELECT {by}, b, s + o AS i FROM (SELECT *, unnest(range(0, bs)) AS o FROM ({draws})) WHERE (j - 1) * bs + o < n"
    means = f"SELECT {by}, b, avg(v) AS m FROM ({values}) JOIN ({ranked}) USING ({by}, i) GROUP BY {by}, b"
    return f"""SELECT {by}, n, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high
FROM ({shape}) JOIN (SELECT {by}, {low} AS ci_low, {high} AS ci_high FROM ({means}) GROUP BY {by}) {using}"""


def bootstrap_sql(keys: str, value: str, source: str, order: str, block: int, n_boot: int, seed: int = 1) -> str:
    """block_bootstrap_ci() for DuckDB; results rounded to six places."""
    weight = " + ".join(f"CAST(u >= {p!r} AS INTEGER)" for p in POISSON)
    on = " AND ".join(f"a.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {', '.join(f'a.{k.strip()}' for k in keys.split(','))}, n, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high
FROM (SELECT {keys}, count(*) AS n, avg({value}) AS mean, coalesce(stddev_samp({value}), 0) AS std FROM {source} WHERE {value} IS NOT NULL GROUP BY {keys}) a
JOIN (SELECT {keys}, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM (
  SELECT {keys}, b, sum(w * s) / sum(w * c) AS m FROM (
    SELECT *, {weight} AS w FROM (
      SELECT *, CAST('0x' || substr(md5('{seed}:' || b || ':' || block), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM (
        SELECT {keys}, CAST(floor(({order} - 1) / {float(block)}) AS BIGINT) AS block, sum({value}) AS s, count(*) AS c FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL), (SELECT unnest(range(1, {n_boot + 1})) AS b)))
  WHERE w > 0 GROUP BY {keys}, b) GROUP BY {keys}) c ON {on}"""


#: Two-sided 95 % points of Student's t for 1 to 29 degrees of freedom.
T95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045)


def confidence_margin(n: Column, std: Column) -> Column:
    """Half the width of a 95 % interval of a mean: normal from 30 values on, Student's t below; null for one value."""
    t = F.get(F.array(*(F.lit(v) for v in T95)), (n - 2).cast("int"))
    return F.when(n >= 30, 1.959964 * std / F.sqrt(n)).when(n >= 2, t * std / F.sqrt(n))


def window_time(df: DataFrame, window: str = "window_id", seconds: str = "seconds") -> DataFrame:
    """windows and mean_seconds: the longest time of each window over its methods and shares, then the mean of these.

    Windows without any time count, but not in the mean, which is null without times.
    """
    longest = df.groupBy(window).agg(F.max(seconds).alias("_s"))
    return longest.agg(F.count("*").alias("windows"), F.avg("_s").alias("mean_seconds"))


def summary(df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """keys, mean and std of each value, and rows."""
    aggs = [f(v).alias(f"{v}_{s}") for v in values for f, s in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return df.groupBy(*keys).agg(*aggs, F.count("*").alias("rows"))


FIVE = {"min": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "max": 1.0}


def describe(df: DataFrame, columns: list[str], wanted: dict[str, float] = FIVE, parts: int = 256) -> DataFrame:
    """variable, count, missing, mean, std and the exact quantiles wanted, for each numeric column; between ranks by proportion.

    All columns are worked on together. Approximate quantiles part each one's values into at most `parts` ranges, whose
    counts tell in which range each rank lies; only these ranges are sorted, each in a task of its own and equal values as
    one row. NaN counts as missing. The result is a row a column, so it is small, and what was kept for it is released.
    """
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("v")) for c in columns)))
    rows = df.select(values.alias("x")).select("x.*").persist()
    cuts = [i / parts for i in range(1, parts)]
    known = rows.groupBy("variable").agg(F.count("*").alias("n"), F.count("v").alias("c"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.percentile_approx("v", cuts, 10_000).alias("cuts")).collect()
    few = df.sparkSession.createDataFrame([(r["variable"], sorted(set(r["cuts"] or []))) for r in known], "variable string, cuts array<double>") if known else None
    out = []
    if known:
        placed = rows.where("v is not null").join(F.broadcast(few), "variable").withColumn("p", F.size(F.filter("cuts", lambda c: c <= F.col("v")))).select("variable", "p", "v")
        sizes: dict[str, list[tuple[int, int]]] = {}
        for r in placed.groupBy("variable", "p").count().orderBy("variable", "p").collect():  # a row for each range
            sizes.setdefault(r["variable"], []).append((r["p"], r["count"]))

        def place(variable: str, rank: int) -> tuple[int, int]:
            """The range that holds a rank (from 0), and the rank in it from 1."""
            for p, c in sizes.get(variable, []):
                if rank < c:
                    return p, rank + 1
                rank -= c
            return -1, 0

        ends = {(r["variable"], name): [place(r["variable"], f(q * (r["c"] - 1))) for f in (math.floor, math.ceil)] for r in known for name, q in wanted.items()}
        asked = df.sparkSession.createDataFrame(sorted({(v, *e) for (v, _), both in ends.items() for e in both}), "variable string, p int, r long")
        used = placed.join(F.broadcast(asked.select("variable", "p").distinct()), ["variable", "p"]).groupBy("variable", "p", "v").agg(F.count("*").alias("c"))
        upto = used.withColumn("to", F.sum("c").over(Window.partitionBy("variable", "p").orderBy("v")))
        hits = upto.join(F.broadcast(asked), ["variable", "p"]).where("r <= to and r > to - c")
        at = {(r["variable"], r["p"], r["r"]): r["v"] for r in hits.select("variable", "p", "r", "v").collect()}  # two a quantile
        for r in known:
            row = [r["variable"], r["c"], r["n"] - r["c"], r["mean"], r["std"]]
            for name, q in wanted.items():
                lo, hi = (at.get((r["variable"], *e)) for e in ends[r["variable"], name])
                share = q * (r["c"] - 1) - math.floor(q * (r["c"] - 1))
                row.append(None if lo is None else lo + (hi - lo) * share)
            out.append(tuple(row))
    else:
        out = [(c, 0, 0, None, None, *(None for _ in wanted)) for c in columns]
    rows.unpersist()
    kind = "variable string, count long, missing long, mean double, std double" + "".join(f", `{name}` double" for name in wanted)
    return df.sparkSession.createDataFrame(sorted(out), kind)


def quantiles(df: DataFrame, value: str, wanted: dict[str, float], parts: int = 256) -> DataFrame:
    """One row with the exact quantiles of value by name, as describe() finds them; null without values."""
    return describe(df, [value], wanted, parts).select(*wanted)


def guarded_corr(x: str, y: str) -> Column:
    """Pearson's r of pairs without nulls; null below three pairs or without variance."""
    sx, sy = F.regr_sxx(y, x), F.regr_syy(y, x)
    return F.when((F.regr_count(y, x) >= 3) & (sx > 1e-300) & (sy > 1e-300), F.try_divide(F.regr_sxy(y, x), F.sqrt(sx) * F.sqrt(sy)))


def line(x: str, y: str) -> tuple[Column, Column]:
    """Slope and intercept of y on x."""
    return F.regr_slope(y, x), F.regr_intercept(y, x)


def correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, r, slope, intercept, n over pairs without nulls."""
    slope, intercept = line(x, y)
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(guarded_corr(x, y).alias("r"), slope.alias("slope"), intercept.alias("intercept"), F.count("*").alias("n"))


def paired(a: DataFrame, b: DataFrame, value: str, on: tuple[str, ...] = ("window_id", "retain_ppm")) -> DataFrame:
    """on and gain: value of a less value of b for the keys that both have, each once."""
    right = b.select(*on, F.col(value).alias("_b"))
    return a.join(right, list(on)).select(*on, (F.col(value) - F.col("_b")).alias("gain"))


def merge_wide(long: DataFrame, methods: tuple[str, ...], value: str = "psnr") -> DataFrame:
    """A row per (window_id, retain_ppm) with value of every method as a column; one shuffle."""
    wide = long.groupBy("window_id", "retain_ppm").pivot("method", list(methods)).agg(F.first(value))
    return wide.select("window_id", "retain_ppm", *(F.col(m).alias(f"{value}_{m}") for m in methods))


def delta_vs_reference(df: DataFrame, value: str, at_ppm: int = 800_000) -> DataFrame:
    """df with delta: value less that at the reference share, or less the largest where no row has it."""
    ref = df.agg(F.max(F.when(F.col("retain_ppm") == at_ppm, F.col(value))).alias("_r"), F.max(value).alias("_m"))
    return df.crossJoin(F.broadcast(ref)).withColumn("delta", F.col(value) - F.coalesce("_r", "_m")).drop("_r", "_m")  # one row


def by_window_order(df: DataFrame, value: str) -> DataFrame:
    """The metric by window and method, in order: what a chart of it would show."""
    return df.select("method", "retain_ppm", "window_id", value).orderBy("method", "retain_ppm", "window_id")

