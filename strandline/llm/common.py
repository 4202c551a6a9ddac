"""Small helpers that the text operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The words of every contract here: runs of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the one set by setCheckpointDir.

    Where neither is set, a local session gets a folder of its own (tests); on a cluster that is an error, since no
    machine's own folder is seen by the others.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or getattr(sc, "_strandline_shared", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = sc._strandline_shared = tempfile.mkdtemp(prefix="strandline-")
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) as Spark's own readers see them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    fs, where = hadoop_path(spark, path)
    fs.deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str, keep_shuffles: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here, and lost executors lose nothing.

    The shuffle files behind the written table are no longer needed, so Spark may drop them as soon as it is written.
    The table goes when the application ends, or earlier by discard().
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with settings(spark, {} if keep_shuffles else {FILE_CLEANUP: "true"}):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by stored() that no later plan reads."""
    for t in tables:
        fs, where = hadoop_path(t.sparkSession, t._strandline_path)
        fs.delete(where, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the actions in the block; the earlier ones return after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Arrow batches of at most so many rows and about so many bytes, since one text may have many megabytes.

    The session keeps the limits: a result is computed after the call that plans it. Smaller ones of its own stay.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= size:
        spark.conf.set(key, f"{size}b")


def with_arrow_columns(df: DataFrame, run: Callable[[pa.RecordBatch], dict[str, pa.Array]], kinds: dict[str, str]) -> DataFrame:
    """df with columns that run makes from each Arrow batch; one that has the name of an input column takes its place.

    Map-only, in the partitions that df has. The other columns pass through untouched.
    """
    small_batches(df.sparkSession)
    names = df.columns
    plain = [f"_{i}_{n.replace('.', '_').replace('`', '_')}" if "." in n or "`" in n else n for i, n in enumerate(names)]
    df = df.toDF(*plain) if plain != names else df  # Spark's Arrow functions don't take such names
    shown = dict(zip(plain, names))
    schema = T.StructType([f for f in df.schema.fields if f.name not in kinds])
    for name, kind in kinds.items():
        schema = schema.add(T.StructType.fromDDL(f"`{name}` {kind}").fields[0])
    kept = [f.name for f in df.schema.fields if f.name not in kinds]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = run(b)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(made[k] for k in kinds)], names=[*kept, *kinds])

    out = df.mapInArrow(each, schema)
    return out.toDF(*(shown.get(n, n) for n in schema.fieldNames())) if plain != names else out


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it from being that of a column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """Every column of df by its name, whatever signs that has."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def whole_text(name: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))
