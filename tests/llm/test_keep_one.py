"""keep_one picks rows, not ids: one of each component, whether ids repeat or are missing."""

from collections import Counter

from strandline.llm import simhash
from tests.llm.conftest import prose, rows


def test_one_row_of_each_component(spark, docs):
    values = [simhash.fingerprint(r[1]) for r in rows()]
    group = [min(j for j, y in enumerate(values) if bin(x ^ y).count("1") <= 2) for x in values]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {g: min((r[0] for r, h in zip(rows(), group) if h == g and r[0] is not None), default=None) for g in group}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(ids.values())


def test_rows_that_share_an_id_or_have_none(spark):
    a, b = prose(1, 80), prose(2, 80)
    table = [(1, a)] * 50 + [(1, b), (2, b), (None, a), (None, prose(3, 50)), (None, prose(3, 50))]
    docs = spark.createDataFrame([(i, t, 7) for i, t in table], "doc_id long, text string, run long").repartition(3)
    kept = Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect())
    assert kept == Counter([(1, a), (1, b), (None, prose(3, 50))])
