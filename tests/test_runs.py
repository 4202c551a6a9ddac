"""Runs that stop and go on, their records, and schedules of changing banks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import training
from strandline.operators.evaluation import evaluated
from strandline.operators.training import Stage
from strandline.sources import runs

KIND = "series_id string, window_id int, x array<double>"


@pytest.fixture(scope="module")
def wins(spark):
    x = np.random.default_rng(2).standard_normal((20, 64)).cumsum(axis=1)
    return spark.createDataFrame([("s", i + 1, r.tolist()) for i, r in enumerate(x)], KIND).repartition(3).cache()


def counting(spark, fails_at=None):
    """Training work that counts its windows, and fails when the window is among those given."""
    seen = spark.sparkContext.accumulator(0)

    def work(part):
        def run(batches):
            for b in batches:
                ids = b.column("window_id").to_pylist()
                if fails_at in ids:
                    raise RuntimeError("killed")
                seen.add(len(ids))
                yield b

        trained = training.train(part.mapInArrow(run, part.schema), 3, (Stage(5, 5e-3, "haar"),))
        return evaluated(trained, 64, ("learned",), (0.1, 0.4), levels=3, measures=("psnr",))

    return work, seen


def test_a_killed_run_finishes_only_the_rest(spark, wins, tmp_path):
    run = runs.Run(str(tmp_path / "L_3"), seed=5)
    work, seen = counting(spark, fails_at=14)
    with pytest.raises(Exception, match="killed"):
        run.resume(wins, "learned", work, each=4)
    done = run.manifest(spark).count()
    assert done == 12 and {r["windows"] for r in run.records(spark).collect()} == {4}
    assert run.results(spark, "learned").count() == 24  # what the killed part wrote doesn't count
    again, more = counting(spark)
    assert run.resume(wins, "learned", again, each=4) == 2 and more.value == 8
    assert run.resume(wins, "learned", again, each=4) == 0 and more.value == 8
    rows = {(r["window_id"], r["retain_ppm"]): r["psnr"] for r in run.results(spark, "learned").collect()}
    whole = {(r["window_id"], r["retain_ppm"]): r["psnr"] for r in counting(spark)[0](wins).collect()}
    assert rows == pytest.approx(whole) and len(rows) == 40
    record = run.records(spark).first()
    assert record["seed"] == 5 and record["seconds"] > 0 and record["rows"] == 8 and record["threads"] >= 1
    assert run.pending(wins, "haar").count() == 20  # another stage has its own manifest


def test_provenance_and_levels_by_path(spark, wins, tmp_path):
    found = runs.provenance()
    assert set(found) == {"git_commit", "git_dirty", "manifest_sha256"} and (found["git_commit"] is None or len(found["git_commit"]) == 40)
    assert runs.provenance(str(tmp_path)) == {"git_commit": None, "git_dirty": None, "manifest_sha256": None}
    for n in (3, 12):
        spark.range(n).write.parquet(str(tmp_path / f"t/L_{n}/a"))
    spark.range(2).withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "t/other"))
    assert {r["L"]: r["count"] for r in runs.read_runs(spark, str(tmp_path / "t")).groupBy("L").count().collect()} == {3: 3, 12: 12, None: 2}
    row = runs.with_settings(spark.range(1), L=3, param="block", seconds=1.5, **found).first()
    assert (row["L"], row["param"], row["seconds"]) == (3, "block", 1.5) and runs.with_settings(spark.range(1), git_dirty=None).schema["git_dirty"].dataType.typeName() == "boolean"


def test_stages_inherit_and_start_anew():
    plan = training.settled((Stage(1, init="haar"), Stage(1), Stage(1, levels=2), Stage(1), Stage(1, chi=4), Stage(1, init="haar"), Stage(1, reinit=True), Stage(1, chi=2, init="haar")), 3, 2, 2)
    assert [(p[1:4], p[4]) for p in plan] == [((3, 2, 2), "haar"), ((3, 2, 2), "previous"), ((2, 2, 2), "random"), ((2, 2, 2), "previous"), ((2, 4, 2), "random"), ((2, 4, 2), "random"), ((2, 4, 2), "random"), ((2, 2, 2), "haar")]


def test_a_restart_equals_an_unbroken_run(spark, wins):
    first, second = Stage(15, 5e-3, "haar"), Stage(10, 2.5e-3)
    whole = {r["window_id"]: r for r in training.train(wins, 3, (first, second)).collect()}
    model = training.model_table(training.train(wins, 3, (first,))).cache()
    again = {r["window_id"]: r for r in training.train(training.with_model(wins, model, 3), 3, (second,), resume=True).collect()}
    assert whole.keys() == again.keys()
    for k, r in whole.items():
        assert again[k]["loss"] == pytest.approx(r["loss"], abs=1e-12)
        for f, g in zip(r["filters"], again[k]["filters"]):
            assert f["h"] == pytest.approx(g["h"], abs=1e-9) and f["g"] == pytest.approx(g["g"], abs=1e-9)
    short = training.train(training.with_model(wins, model, 2), 3, (second,), resume=True)
    assert {r["error"] is not None for r in short.collect()} == {True}  # a bank of two levels for three


def test_resampled_spectra(spark, wins):
    """Replicate by replicate with Python's whole numbers, by two families; a window without power is null or flat."""
    from strandline.operators import evaluation

    def pick(counter):
        h = counter % (2**31 - 1)
        for a, b, shift in ((1103515245, 12345, 16), (69069, 1, 13), (48271, 11, 15)):
            h = (h * a + b) % (2**31 - 1)
            h ^= h >> shift
        return h

    for family in ("haar", "db4"):
        found = evaluation.resampled_spectra(wins, 6, 3, 2, family).collect()
        assert len(found) == 20 and len(found[0]) == 17
        for r in found[:4]:
            x = np.array(wins.where(f"window_id = {r['window_id']}").first()["x"])
            rows = np.array([[x[pick(r["window_id"] * 6 * 64 + b * 64 + i + 3 * 7919) % 64] for i in range(64)] for b in range(6)])
            width = evaluation.scaling(rows, 2, evaluation.NOISE, True, family)["alpha_width"]
            assert r["alpha_width_mean"] == pytest.approx(width.mean()) and r["alpha_width_upper"] == pytest.approx(np.quantile(width, 0.975))
    at = evaluation.drawn(np.arange(200_000)) % 1000
    assert abs(np.bincount(at, minlength=1000) - 200).max() < 100  # about even
    assert evaluation.resampled_spectra(wins.limit(0)).count() == 0


def test_a_smaller_bank_gives_its_own_levels(spark, wins):
    out = training.train(wins, 3, (Stage(5, 5e-3, "haar"), Stage(5, 5e-3, "haar", levels=2))).first()
    assert len(out["filters"]) == 2 and [(h["levels"], h["init"]) for h in out["history"]] == [(3, "haar"), (2, "haar")]
    assert training.training_history(training.train(wins, 3, (Stage(5, 5e-3, "haar"),))).columns == ["series_id", "window_id", "stage", "iterations", "lr", "loss"]
    longer = training.train(wins, 3, (Stage(1, init="haar"), Stage(1, init="haar", levels=7))).first()
    assert longer["error"] and len(longer["filters"]) == 7 and longer["filters"][0]["h"] == pytest.approx([math.sqrt(0.5)] * 2)
