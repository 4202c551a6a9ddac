"""The registered query of each text operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, media, mixing, packing, pii, quality, simhash, spelling, substrings, token_files, toxicity, warc, winnowing
from ..cluster import ship
from .common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.query(table(spark, sf_dir, "documents"), gram=5, window=8)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), size=4096, end=2)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), reject=0.7)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return substrings.deduplicated(table(spark, sf_dir, "documents"), window=35)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=0.3)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, shingle=3)
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return media.query(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return warc.query(table(spark, sf_dir, "pages"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pii.digest(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix(table(spark, sf_dir, "documents"), share=0.6, max_epochs=2, seed=7)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spelling.query(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_files.query(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end=2)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_winnowing": op1_winnowing,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_substrings": op4_substrings,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_media": op7_media,
    "op8_warc": op8_warc,
    "op9_pii": op9_pii,
    "op10_mixing": op10_mixing,
    "op11_spelling": op11_spelling,
    "op12_token_files": op12_token_files,
    "op13_divergence": op13_divergence,
}
ORACLE_SQL: dict[str, str] = {"op10_mixing": mixing.sql(share=0.6, max_epochs=2, seed=7), "op11_spelling": spelling.sql(), "op13_divergence": divergence.sql()}
