"""Stages leave a user's columns alone, even those that bear every name a stage uses for itself."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import mixing, pii, simhash, toxicity
from strandline.llm.common import unused
from tests.llm.conftest import prose
from tests.llm.test_operators import labelled

NAMES = (
    "_row _node row node component first fp rep _pii _pii_ spans base a b h n c key mask set bits x y _x _p _p_ _raw _class _features _score features label fold p prediction probability "
    "rawPrediction _toxic_x _toxic_out _toxic_features _digest _taken _own digest place slice epoch domain tokens rest before Text2 odd.name tick`name"
).split()


@pytest.fixture(scope="module")
def odd(spark):
    """Some documents, copies among them, with a column of every such name and its own value in each row."""
    table, marks, _, _ = labelled(spark, 150)
    more = spark.createDataFrame([(200 + i, prose(i, 60) + f" a.b{i}@mail.example.com", "en", "s", 0) for i in (1, 1, 2, 3, 3)], table.schema)
    table = table.unionByName(more)
    return table.select("*", *(F.concat(F.lit(n + ":"), F.col("doc_id").cast("string")).alias(n) for n in NAMES)).repartition(3).cache(), marks


def values(df):
    """Rows without the text, and whether extra columns hold what they were given."""
    rows = df.collect()
    assert all(r[n] == f"{n}:{r['doc_id']}" for r in rows for n in NAMES)
    return Counter((r["doc_id"], r["lang"], r["source"]) for r in rows)


@pytest.mark.parametrize("stage", ("keep_one", "keep_alike", "redact", "reject", "mix"))
def test_extra_columns_pass_through(odd, stage):
    docs, marks = odd
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    run = {
        "keep_one": simhash.keep_one, "keep_alike": lambda d: simhash.keep_one(d, least=0.8), "redact": pii.redact_documents,
        "reject": lambda d: toxicity.reject_toxic(d, marks), "mix": lambda d: mixing.mix_documents(d, 0.5),
    }[stage]
    out = run(docs)
    assert out.columns == docs.columns
    assert values(out) == Counter((r["doc_id"], r["lang"], r["source"]) for r in run(plain).collect())


def test_stages_by_their_functions(spark, odd, data):
    docs, _ = odd
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        values(out)


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "_X int, _x_ int, `a.b` int")
    assert unused(df, "_x", "_x", "_y") == ["_x__", "_x___", "_y"]
