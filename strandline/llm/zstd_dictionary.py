"""Zstandard dictionaries from a bounded sample of records."""

from __future__ import annotations

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(df: DataFrame, data: Column, rows: int = 1000, largest: int = 32_768) -> list:
    """About `rows` rows of df at most whose data has 1 to `largest` bytes, those with the smallest hashes of it.

    Each task picks its own first, so `rows` times `largest` bytes bound what reaches the driver. Whole rows are taken,
    and the same ones in every run. The sample only tunes compression: every record is written whole whatever it holds.
    """
    size, order = F.length(data), F.xxhash64(data)
    n = max(1, df.where((size > 0) & (size <= largest)).count())
    few = df.where((size > 0) & (size <= largest) & (F.pmod(order, F.lit(n)) < 2 * rows))
    return few.orderBy(order).limit(rows).collect()


def train(samples: list[bytes], size: int = 262_144) -> bytes:
    """The bytes of a dictionary; without enough to train on, the samples' own bytes, or none."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def as_dict(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None
