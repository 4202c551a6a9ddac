"""From raw documents to packed training sequences.

Stages in order: documents rejected as toxic go; one document of each near-duplicate group stays; personal data is
replaced in the texts; sources are mixed to target weights; what is left is packed into sequences. Each stage works
on all that its predecessor kept. All but the last return the columns of documents.

Every stage takes empty tables, null or empty texts, repeated rows and extra columns, and gives what its docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import mixing, packing, pii, simhash, toxicity
from strandline.cluster import ship
from strandline.llm.common import stored, table
from strandline.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text scores below 0.7. A null or empty text is scored by zero features, a row without doc_id is judged
    like any other, repeated rows go or stay together, and an empty table stays empty; extra columns pass through."""
    ship(spark)
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"), reject=0.7)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by a likeness of 0.8 or more of their 5-word shingles: that with the smallest
    doc_id, of repeated rows the first. The Gray-order index over fingerprints links those within 2 bits, each link confirmed
    on the shingles; a prefix filter finds the links that lie further apart. Null and wordless texts are one group; rows
    without doc_id come last in theirs. An empty table stays empty; extra columns pass through."""
    ship(spark)
    return simhash.keep_one(docs, radius=2, least=0.8)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, personal data in its text replaced by its kind. A null text stays null, an empty one empty; repeated rows
    and those without doc_id are rows like others. An empty table stays empty; extra columns pass through."""
    ship(spark)
    return pii.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that one seeded epoch takes, 80 % of all words under the target weights. A null text has no words; rows that
    share a doc_id or have none are taken by their texts, equal rows together. An empty table stays empty; extra columns
    pass through."""
    return mixing.mix_documents(docs, share=0.8, seed=7)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a text in a sequence, instead of the rows of documents. A null or empty text is one piece that
    holds the end id; repeated rows and those without doc_id are packed like others. An empty table gives no piece."""
    ship(spark)
    return packing.pack(docs, tokenizer_path(), size=4096, end=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can neither fit the classifier nor tokenize; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage's table written to the shared folder and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
