"""What the two learned classifiers share: labelled rows by a hash rule, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def held_out(modulus: int, value: int) -> Column:
    return F.coalesce(remainder("doc_id", modulus) == value, F.lit(False))


def training_labels(labels: DataFrame, column: str, modulus: int, value: int, most: int) -> DataFrame:
    """(doc_id, label): labelled rows that aren't held out, about `most` of them at most, chosen by a hash of doc_id.

    An id that has several labels gets the largest. The sample serves fitting alone and is bounded by `most`.
    """
    rows = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(modulus, value))
    rows = rows.groupBy("doc_id").agg(F.max(F.col(column).cast("double")).alias("label"))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < most)
    return rows
