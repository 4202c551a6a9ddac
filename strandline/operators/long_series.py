"""Whole series, however long, in blocks that a task can hold.

A filter reaches beyond a block's end, so each block gets some samples of its neighbours, circular at the series' ends.
Several levels are taken at once: a block with a margin gives its own part of all of them, and one coarse sample for many
fine ones. The coarse samples are the next round's series, a small share of the last one, until a block holds it all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.wavelets import TAPS, analyze, canonical, levels_of
from .metrics import detrended, dfa_scales, whittle_frequencies, whittle_minimum
from .series import with_statistics

#: How many samples to the left and right one level of the lifting scheme needs.
LIFTED = 4


def reach(family: str) -> tuple[int, int]:
    """How many samples before and behind its own a block needs for one level."""
    if family == "bior4.4":
        return LIFTED, LIFTED
    return 0, len(TAPS.get(family, (0, 0))) - 2


def margins(family: str, levels: int) -> tuple[int, int]:
    """How many samples before and behind its own a block needs for so many levels at once."""
    return tuple(((1 << levels) - 1) * r for r in reach(family))


def block_levels(x: np.ndarray, family: str, levels: int, own: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Approximation and details of the `own` samples in the middle of each row, which has the margins of `levels`.

    Every level is taken as if the row were circular; what wrapping spoilt at the ends is cut off.
    """
    before, behind = reach(family)
    left, details = margins(family, levels)[0], []
    for _ in range(levels):
        a, d = analyze(x, family)
        x, d = (v[:, before // 2 : v.shape[1] - behind // 2] for v in (a, d))
        left, own = (left - before) // 2, own // 2
        details.append(d[:, left : left + own])
    return x[:, left : left + own], details


#: As many levels as a position of 63 bits can have.
DEEPEST = 62


def finished(x: np.ndarray, family: str) -> list[float]:
    """The sum of squared details of every level of a whole series."""
    out, x = [], x[None]
    for _ in range(levels_of(x.shape[1])):
        x, d = analyze(x, family)
        out.append(float((d * d).sum()))
    return out


def next_round(t: DataFrame, family: str, levels: int, block: int) -> DataFrame:
    """t, a row for each sample (series_id, pos, value, n, series_length, e), after `levels` more levels.

    n is the length of the series by now, e the sums of squares of the levels so far, held by one sample of a block and
    null elsewhere. A series that fits into a block goes all the way, to one sample. The only shuffle is that of the
    samples; those near a block's ends go to its neighbour as well.
    """
    before, behind = margins(family, levels)
    own, inside, last = F.expr(f"pos div {block}"), F.expr(f"int(pos % {block})"), F.expr(f"n div {block}") - 1
    put = lambda b, i, e=F.lit(None): F.struct(b.cast("long").alias("block"), i.cast("int").alias("place"), e.cast("array<double>").alias("sums"))
    places, cut = F.array(put(own, inside + before, F.col("e"))), F.col("n") > block
    if behind:
        places = F.when(cut & (inside < behind), F.concat(places, F.array(put(F.when(own == 0, last).otherwise(own - 1), inside + before + block)))).otherwise(places)
    if before:
        places = F.when(cut & (inside >= block - before), F.concat(places, F.array(put(F.when(own == last, F.lit(0)).otherwise(own + 1), inside - block + before)))).otherwise(places)
    rows = t.select("series_id", "value", "n", "series_length", F.inline(places)).groupBy("series_id", "block")
    rows = rows.agg(F.collect_list(F.struct("place", "value")).alias("x"), F.collect_list("sums").alias("sums"), F.max("n").alias("n"), F.max("series_length").alias("series_length"))

    def one(row: dict) -> tuple:
        n, total, sums = row["n"], row["series_length"], np.zeros(DEEPEST)
        for e in row["sums"]:
            sums += e
        x = np.zeros(before + min(n, block) + behind)
        x[row["x"].field(0).to_numpy()] = row["x"].field(1).to_numpy()
        done = levels_of(total) - levels_of(n)
        if n <= block:
            more, a, n = finished(x[before : before + n], family), np.zeros(1), 1
        else:
            a, details = block_levels(x[None], family, levels, block)
            more, a, n = [float((d * d).sum()) for d in details], a[0], n >> levels
        sums[done : done + len(more)] += more
        return row["series_id"], row["block"], n, total, a.tolist(), sums.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = [b.column(c).to_pylist() for c in ("series_id", "block", "n", "series_length", "sums")]
            for k in range(b.num_rows):
                made = one(dict(zip(("series_id", "block", "n", "series_length", "sums"), (c[k] for c in plain))) | {"x": b.column("x")[k].values})
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(made, kinds)], names=["series_id", "block", "n", "series_length", "approx", "sums"])

    out = rows.mapInArrow(run, "series_id string, block long, n long, series_length long, approx array<double>, sums array<double>")
    out = out.select("series_id", "block", "n", "series_length", "sums", F.size("approx").alias("size"), F.posexplode("approx").alias("i", "value"))
    return out.select("series_id", (F.col("block") * F.col("size") + F.col("i")).alias("pos"), "value", "n", "series_length", F.when(F.col("i") == 0, F.col("sums")).alias("e"))


def level_energies(t: DataFrame, wavelet: str, block: int = 1 << 14, most: int = 10_000) -> DataFrame:
    """series_id, level, e (the sum of squared details), n (their number), series_length for every level of each series.

    t: series_id, pos and value of series whose lengths are powers of two; block is one too. A round shuffles the
    series of the round before, which is by far smaller, and hands its sums on, so no sample is read twice. A series of one
    sample has no level and no row.
    """
    family = canonical(wavelet)
    lengths = t.groupBy("series_id").agg(F.count("*").alias("n"))
    rows = with_statistics(t, lengths, most).withColumn("series_length", F.col("n")).withColumn("e", F.lit(None).cast("array<double>"))
    longest = lengths.agg(F.max("n")).first()[0] or 0
    step = max([j for j in range(1, block.bit_length()) if sum(margins(family, j)) <= block // 8], default=0)
    if longest > block and not step:
        raise ValueError(f"blocks of {block} samples are too short for {family}")
    while longest > block:
        rows, longest = next_round(rows, family, step, block), longest >> step
    rows = next_round(rows, family, max(1, step), block)
    found = rows.where("e is not null").select("series_id", "series_length", F.posexplode("e").alias("j", "e")).withColumn("level", F.col("j") + 1)
    return found.where("shiftleft(1L, level) <= series_length").select("series_id", "level", "e", F.expr("series_length div shiftleft(1L, level)").alias("n"), "series_length")


def in_blocks(t: DataFrame, block: int) -> DataFrame:
    """series_id, block, x (places and centred values), n and mean of the blocks of t, after one shuffle of the samples."""
    known = t.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    rows = with_statistics(t, known).select("series_id", F.expr(f"pos div {block}").alias("block"), F.expr(f"int(pos % {block})").alias("place"), (F.col("value") - F.col("mean")).alias("value"), "n")
    return rows.groupBy("series_id", "block").agg(F.collect_list(F.struct("place", "value")).alias("x"), F.max("n").alias("n"))


def offsets(t: DataFrame, block: int) -> DataFrame:
    """series_id, block, before: the running sum of the centred series at each block's start, from the blocks' sums."""
    known = t.groupBy("series_id").agg(F.avg("value").alias("mean"))
    sums = with_statistics(t, known).groupBy("series_id", F.expr(f"pos div {block}").alias("block")).agg(F.sum(F.col("value") - F.col("mean")).alias("s"))
    earlier = W.partitionBy("series_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("series_id", "block", F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("before"))


def values_of(x: pa.StructArray) -> np.ndarray:
    """The values of one block, each at its place."""
    out = np.zeros(len(x))
    out[x.field(0).to_numpy()] = x.field(1).to_numpy()
    return out


def fluctuations(t: DataFrame, order: int = 1, block: int = 1 << 14) -> DataFrame:
    """series_id, s, f2: the mean squared residual of whole series' profiles about polynomials, for each segment length.

    t: series_id, pos (dense from 0) and value. Segments that lie in a block are finished there. Of a segment that
    blocks share, each hands on its sums of squares and of the profile times powers of the place; these add up, and the
    residual follows from them and the powers' own sums, which have closed forms. order is 1 to 3.
    """
    if not 1 <= order <= 3:
        raise ValueError("the order is 1 to 3")
    names = ["f", "c", "yy", *(f"y{k}" for k in range(4))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                name, at, n, before = (b.column(c)[k].as_py() for c in ("series_id", "block", "n", "before"))
                y = before + values_of(b.column("x")[k].values).cumsum()
                first, rows = at * block, []
                for s in dfa_scales(n):
                    m = n // s
                    if m < 4:
                        continue
                    stop = min(len(y), m * s - first)  # what is behind the last whole segment doesn't count
                    lo = min(max(stop, 0), -first % s)
                    hi = lo + max(0, stop - lo) // s * s
                    if hi > lo:
                        rows.append((s, -1, float(detrended(y[None, lo:hi], s, order).sum()), (hi - lo) // s, *[0.0] * 5))
                    for a, z in ((0, lo), (hi, stop)):
                        if z > a:
                            part, segment = y[a:z], (first + a) // s
                            u = ((first + np.arange(a, z)) - segment * s - (s - 1) / 2) / s
                            rows.append((s, segment, 0.0, 0, float((part * part).sum()), *(float((part * u**p).sum()) for p in range(4))))
                if rows:
                    cols = [pa.array([name] * len(rows), pa.string()), *(pa.array(c, pa.int64() if i in (0, 1, 3) else pa.float64()) for i, c in enumerate(zip(*rows)))]
                    yield pa.RecordBatch.from_arrays(cols, names=["series_id", "s", "segment", *names])

    kind = "series_id string, s long, segment long, f double, c long, yy double, y0 double, y1 double, y2 double, y3 double"
    found = in_blocks(t, block).join(offsets(t, block), ["series_id", "block"]).mapInArrow(run, kind)
    sums = found.groupBy("series_id", "s", "segment").agg(*(F.sum(n).alias(n) for n in names))
    s = F.col("s").cast("double")
    # sums of even powers of the places (i - (s - 1) / 2) / s
    g0, g2 = s, (s * s - 1) / (12 * s)
    g4, g6 = (s * s - 1) * (3 * s * s - 7) / (240 * F.pow(s, 3)), (s * s - 1) * (3 * F.pow(s, 4) - 18 * s * s + 31) / (1344 * F.pow(s, 5))
    pair = lambda a, b, p, q, r: (r * a * a - 2 * q * a * b + p * b * b) / (p * r - q * q)
    y0, y1, y2, y3 = (F.col(f"y{k}") for k in range(4))
    even, odd = y0 * y0 / g0 if order < 2 else pair(y0, y2, g0, g2, g4), y1 * y1 / g2 if order < 3 else pair(y1, y3, g2, g4, g6)
    whole = F.when(F.col("segment") < 0, F.col("f")).otherwise(F.greatest(F.col("yy") - even - odd, F.lit(0.0)) / s)
    count = F.when(F.col("segment") < 0, F.col("c")).otherwise(1)
    return sums.groupBy("series_id", "s").agg((F.sum(whole) / F.sum(count)).alias("f2"))


def dfa(t: DataFrame, order: int = 1, block: int = 1 << 14) -> DataFrame:
    """series_id, H_dfa, scales of whole series; null below four scales with fluctuation."""
    f = fluctuations(t, order, block).where("f2 > 0")
    out = f.groupBy("series_id").agg(F.regr_slope(F.log("f2") / 2, F.log("s")).alias("slope"), F.count("*").alias("scales"))
    return out.select("series_id", F.when(F.col("scales") >= 4, F.col("slope")).alias("H_dfa"), "scales")


def lowest_terms(x: np.ndarray, first: int, n: int, m: int) -> np.ndarray:
    """What samples first, first + 1, ... of a series of n give to its Fourier terms 1 to m.

    A convolution with a chirp, whose phases are whole numbers modulo 2 n, so they stay exact however long the series is.
    """
    j, k = np.arange(len(x)), np.arange(m + 1)
    chirp = lambda i: np.exp(-1j * np.pi * (i * i % (2 * n)) / n)
    size = 1 << (len(x) + m).bit_length()
    kernel = np.zeros(size, complex)
    kernel[: m + 1] = np.conj(chirp(k))
    kernel[size - len(x) + 1 :] = np.conj(chirp(j[:0:-1]))
    found = np.fft.ifft(np.fft.fft(x * chirp(j), size) * np.fft.fft(kernel))[: m + 1] * chirp(k)
    return (found * np.exp(-2j * np.pi * (k * first % n) / n))[1:]


def local_whittle(t: DataFrame, block: int = 1 << 14) -> DataFrame:
    """series_id, n, H_lw, H_lw_se, ci_low, ci_high, m of whole series by the local Whittle estimator.

    Each task adds up what its blocks give to the lowest Fourier terms, and hands on a row a term. A series without power,
    or too short for a frequency, is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                name, at, n = (b.column(c)[i].as_py() for c in ("series_id", "block", "n"))
                found = lowest_terms(values_of(b.column("x")[i].values), at * block, n, whittle_frequencies(n))
                held[name, n] = held[name, n] + found if (name, n) in held else found
        for (name, n), z in held.items():
            cols = [pa.array([name] * len(z), pa.string()), pa.array([n] * len(z), pa.int64()), pa.array(np.arange(1, len(z) + 1)), pa.array(z.real), pa.array(z.imag)]
            yield pa.RecordBatch.from_arrays(cols, names=["series_id", "n", "k", "re", "im"])

    terms = in_blocks(t, block).mapInArrow(run, "series_id string, n long, k long, re double, im double").groupBy("series_id", "n", "k").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    rows = terms.groupBy("series_id", "n").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p")))).alias("x"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for i in range(b.num_rows):
                n, power = b.column("n")[i].as_py(), b.column("x")[i].values.field(1).to_numpy()
                ok = power.sum() > 0 and n > 3
                found.append(float(whittle_minimum(2 * np.pi * np.arange(1, len(power) + 1) / n, power[None])[0]) + 0.5 if ok else None)
            sizes = np.diff(b.column("x").offsets.to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("series_id"), b.column("n"), pa.array(found, pa.float64()), pa.array(sizes)], names=["series_id", "n", "H_lw", "m"])

    out = rows.mapInArrow(fit, "series_id string, n long, H_lw double, m long").withColumn("H_lw_se", F.when(F.col("H_lw").isNotNull(), 0.5 / F.sqrt("m")))
    return out.select("series_id", "n", "H_lw", "H_lw_se", (F.col("H_lw") - 1.96 * F.col("H_lw_se")).alias("H_lw_ci_low"), (F.col("H_lw") + 1.96 * F.col("H_lw_se")).alias("H_lw_ci_high"), "m")
