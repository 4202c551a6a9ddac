"""Time the headline queries: python bench.py prints one JSON line."""

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("OMP_NUM_THREADS", "1")


def main() -> None:
    from pyspark.sql import SparkSession

    from strandline.plans import registry

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = {"bench_hurst": "hurst_wavelet", "bench_compress": "threshold_per_level", "bench_multifractal": "multifractal", "bench_baseline": "baseline_wavelet_psnr", "bench_train": "optimize_wavelet_sparsity", "bench_dfa": "dfa", "bench_welch": "welch_psd", "bench_global_hurst": "global_hurst_summary"}
    found = {}
    for key, name in names.items():
        times = []
        for _ in range(4):
            began = time.time()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
            print(f"{key}: {times[-1]:.1f} s", file=sys.stderr, flush=True)
        found[key] = round(statistics.median(times[1:]), 3)  # the first run compiles code
    print(json.dumps({"metric": "total_seconds_of_headline_queries", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
