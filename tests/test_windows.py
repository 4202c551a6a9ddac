"""Windows that overlap or leave gaps against slices of one array, and what preparing them costs."""

import io
import random
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import series

KIND = "series_id string, pos long, value double"


def cut(values, size, step):
    """(window_id, samples) of the windows of a dictionary of samples by position that lack none."""
    last = max(values, default=-1)
    return {(w + 1, tuple(values[p] for p in range(w * step, w * step + size))) for w in range(last // step + 1) if all(p in values for p in range(w * step, w * step + size))}


@pytest.mark.parametrize("size, step", ((8, 8), (8, 3), (8, 1), (7, 20), (64, 32), (5, 4)))
@pytest.mark.parametrize("lost", ((), (0,), (17, 130, 131, 255, 256, 399)))
def test_windows_are_slices(spark, size, step, lost):
    r = random.Random(size * step)
    held = {s: {p: r.random() for p in range(n) if p not in lost} for s, n in (("a", 400), ("b", 57), ("c", size - 1))}
    rows = [(s, p, v) for s, x in held.items() for p, v in x.items()]
    r.shuffle(rows)
    found = series.window_series(spark.createDataFrame(rows, KIND).repartition(3), size, step)
    assert found.columns == ["series_id", "window_id", "x"]
    rows = [(w["series_id"], w["window_id"], tuple(w["x"])) for w in found.collect()]
    assert len(rows) == len(set(rows))
    assert {r for r in rows} == {(s, *w) for s, x in held.items() for w in cut(x, size, step)}


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_overlap_shuffles_samples_once(spark, data):
    t = spark.read.parquet(f"{data}/events.parquet").select(F.lit("s").alias("series_id"), F.col("event_id").alias("pos"), "value")
    text = plan(series.window_series(t, 64, 16))
    exchanges = [line for line in text.splitlines() if "Exchange" in line]
    below = text[text.index(exchanges[-1]) :]
    assert "Generate" not in below  # nothing is multiplied before it is shuffled


def test_preparing_takes_one_shuffle(spark, data):
    t = spark.read.parquet(f"{data}/events.parquet").select(F.lit("s").alias("series_id"), F.col("event_id").alias("pos"), "value")
    text = plan(series.prepare_window_dataset(t, 64))
    assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text
    assert "PushedFilters: [IsNotNull(event_id), LessThan(event_id," in text.replace("\n", " ")


@pytest.mark.parametrize("windows, low, high", ((1, 1, 1), (8, 8, 8), (64 * 8, 8, 8), (10**5, 1000, 2000), (10**10, 10**4, 10**5)))
def test_number_of_tasks(windows, low, high):
    tasks = series.window_tasks(windows, 1024, 8)
    assert low <= tasks <= high and windows * 8192 / tasks <= (1 << 30) + 8192


def test_many_series_and_bad_samples(spark):
    """More series than fit into a plan, with nulls and NaN: the same windows as series by series."""
    r = np.random.default_rng(1)
    held = {f"s{i}": [None if k % 11 == 3 and i % 3 == 0 else float("nan") if k == 5 and i % 4 == 0 else float(v) for k, v in enumerate(r.random(20 + i))] for i in range(9)}
    rows = [(s, p, v) for s, x in held.items() for p, v in enumerate(x)] + [("none", 0, None)]
    t = spark.createDataFrame(rows, KIND).repartition(3)
    expected = set()
    for s, x in held.items():
        good = [v for v in x if v is not None and v == v]
        good = good[: 1 << (len(good).bit_length() - 1)]
        expected |= {(s, w + 1, tuple(good[w * 4 : w * 4 + 4])) for w in range(len(good) // 4)}
    for most in (3, 10_000):
        found = series.prepare_window_dataset(t, 4, normalize=False, most=most)
        assert {(w["series_id"], w["window_id"], tuple(w["x"])) for w in found.collect()} == expected
    nothing = t.where("series_id = 'none'")
    assert series.prepare_window_dataset(nothing, 4).count() == 0
