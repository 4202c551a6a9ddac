"""Reading series from files and tables, and writing results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..cluster import ship
from ..operators.series import first_numeric_column, trace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of events as one series, by event_id; only these two columns are read."""
    return trace(table(spark, sf_dir, "events"), "event_id", "value")


def scan_trace(spark: SparkSession, path: str, header: bool = False, limit: int | None = None) -> DataFrame:
    """(series_id, pos, value) of one-column CSV files, one series for each file; values in a line follow one another.

    Positions come from the row index of each file split's partition and the sizes of the partitions before it, so
    no single task sees a whole file. The first line is data unless header is set.
    """
    lines = spark.read.option("header", header).csv(path)
    name = F.col("_metadata.file_path")
    columns = [F.trim(c).try_cast("double") for c in lines.columns]
    rows = lines.select(name.alias("series_id"), F.col("_metadata.file_block_start").alias("_block"), F.array(*columns).alias("_v"), F.monotonically_increasing_id().alias("_id"))
    rows = rows.select("series_id", "_block", "_id", F.posexplode("_v").alias("_c", "value")).where("value is not null")
    parts = rows.groupBy("series_id", "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("series_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(W.partitionBy("series_id", "_block").orderBy("_id", "_c")) - 1
    out = rows.withColumn("_i", local).join(parts.select("series_id", "_block", before.alias("_before")), ["series_id", "_block"])
    out = out.select("series_id", (F.col("_before") + F.col("_i")).alias("pos"), "value")
    return out.where(F.col("pos") < limit) if limit else out


def newest_file(spark: SparkSession, *patterns: str) -> str | None:
    """The path of the newest file that the first matching pattern finds, by its time of change; contents aren't read."""
    for p in patterns:
        try:
            found = spark.read.format("binaryFile").load(p).select("path", "modificationTime")
            row = found.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        if row["p"]:
            return row["p"]
    return None


def numeric_trace(df: DataFrame, pos: str) -> DataFrame:
    """The first numeric column other than the position as a series, without nulls."""
    return trace(df, pos, first_numeric_column(df, (pos,))).where("value is not null")


def write_results(df: DataFrame, path: str, run_id: str, fmt: str = "parquet") -> None:
    """One run's results in a partition of their own: writing the run again replaces it, other runs stay."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").format(fmt).save(path)


def union_results(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; columns that some lack are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
