"""Runs: results of windows written part by part, taken up again where they stopped, with a record of what ran.

A run is a folder. Results of a part of the windows are written first, then the part's manifest (its windows and a record),
and a part counts once it has a manifest: a run that was killed leaves at most results that nobody reads.
"""

from __future__ import annotations

import hashlib
import os
import subprocess
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["series_id", "window_id"]
RECORD = T.StructType([T.StructField(n, t) for n, t in (
    ("part", T.StringType()), ("stage", T.StringType()), ("windows", T.LongType()), ("rows", T.LongType()), ("seconds", T.DoubleType()), ("threads", T.IntegerType()),
    ("seed", T.IntegerType()), ("git_commit", T.StringType()), ("git_dirty", T.BooleanType()), ("manifest_sha256", T.StringType()),
)])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the one that driver and executors share (spark.checkpoint.dir). Local sessions without one, as
    in tests, get a folder of their own; on a cluster that is an error. It goes when the application ends."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="strandline-")
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def provenance(root: str | None = None) -> dict[str, str | bool | None]:
    """git_commit, git_dirty and manifest_sha256 (of pyproject.toml) of the code that runs; null where there is none."""
    root = root or os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

    def git(*what: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", root, *what], capture_output=True, text=True, timeout=30)
        except OSError:
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    manifest, status = os.path.join(root, "pyproject.toml"), git("status", "--porcelain")
    sha = None
    if os.path.isfile(manifest):
        with open(manifest, "rb") as f:
            sha = hashlib.sha256(f.read()).hexdigest()
    return {"git_commit": git("rev-parse", "HEAD"), "git_dirty": None if status is None else bool(status), "manifest_sha256": sha}


@dataclass(frozen=True)
class Run:
    """The folder of a run, and the seed that its records name."""

    path: str
    seed: int = 1

    def manifest(self, spark: SparkSession) -> DataFrame:
        """series_id, window_id, stage, part of everything that is finished."""
        where = f"{self.path}/manifest"
        if not exists(spark, where):
            return spark.createDataFrame([], "series_id string, window_id int, stage string, part string")
        return spark.read.parquet(where)

    def records(self, spark: SparkSession) -> DataFrame:
        """A row for each finished part: how many windows and rows, how long it took, and by what code."""
        where = f"{self.path}/records"
        return spark.read.schema(RECORD).json(where) if exists(spark, where) else spark.createDataFrame([], RECORD)

    def pending(self, windows: DataFrame, stage: str) -> DataFrame:
        """The windows that a stage hasn't finished; asked before any work on them."""
        done = self.manifest(windows.sparkSession).where(F.col("stage") == stage).select(*KEYS)
        return windows.join(done, KEYS, "left_anti")

    def resume(self, windows: DataFrame, stage: str, work: Callable[[DataFrame], DataFrame], each: int = 4096) -> int:
        """Do a stage's work on all windows it hasn't finished, `each` window numbers at a time; how many parts were done.

        A part is committed with its manifest, so what a killed run had finished is not done again. Nothing but the ends
        of the window numbers comes to the driver.
        """
        spark, parts = windows.sparkSession, 0
        left = self.pending(windows, stage)
        lo, hi = left.agg(F.min("window_id"), F.max("window_id")).first()
        code = provenance()
        for at in range(lo, hi + 1, each) if lo is not None else ():
            part, began, seen = uuid.uuid4().hex[:12], time.time(), Observation(f"windows-{uuid.uuid4().hex}")
            todo = left.where(F.col("window_id").between(at, at + each - 1)).observe(seen, F.count("*").alias("windows"))
            wrote = Observation(f"rows-{uuid.uuid4().hex}")
            work(todo).observe(wrote, F.count("*").alias("rows")).write.parquet(f"{self.path}/results/stage={stage}/part={part}")
            rows, windows_done = wrote.get["rows"], seen.get["windows"]
            record = (part, stage, windows_done, rows, time.time() - began, spark.sparkContext.defaultParallelism, self.seed, code["git_commit"], code["git_dirty"], code["manifest_sha256"])
            spark.createDataFrame([record], RECORD).coalesce(1).write.mode("append").json(f"{self.path}/records")
            keys = left.where(F.col("window_id").between(at, at + each - 1)).select(*KEYS, F.lit(stage).alias("stage"), F.lit(part).alias("part"))
            keys.write.mode("append").parquet(f"{self.path}/manifest")
            parts += 1
        return parts

    def results(self, spark: SparkSession, stage: str) -> DataFrame:
        """The rows of a stage's finished parts."""
        parts = self.manifest(spark).where(F.col("stage") == stage).select("part").distinct()
        found = spark.read.option("basePath", f"{self.path}/results").parquet(f"{self.path}/results/stage={stage}")
        return found.join(F.broadcast(parts), "part", "left_semi").drop("part", "stage")  # a part has thousands of windows


def level_of_path() -> Column:
    """The bank's levels as a file's path tells them: the number of its folder L_<n>; null without one."""
    return F.regexp_extract(F.col("_metadata.file_path"), "/L_([0-9]+)/", 1).try_cast("int")


def read_runs(spark: SparkSession, *paths: str) -> DataFrame:
    """Results of several runs, each in a folder L_<n> somewhere on its path, with the number as column L. Columns that
    some lack are null."""
    found = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(*paths)
    return found.select("*", level_of_path().alias("L"))


def with_settings(df: DataFrame, **values: int | float | str | bool | None) -> DataFrame:
    """df with a run's settings and provenance as columns of their kinds; null where unknown."""
    kinds = {bool: "boolean", int: "int", float: "double", str: "string", type(None): "string"}
    return df.select("*", *(F.lit(v).cast("boolean" if k == "git_dirty" else kinds[type(v)]).alias(k) for k, v in values.items()))
