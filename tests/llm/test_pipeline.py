"""The stages against brute force: what each drops, keeps and changes."""

from collections import Counter

import corpus_pipeline
from strandline.llm import mixing, pii, toxicity
from strandline.llm.common import stored
from tests.llm.test_likeness import brute


def test_stages_by_hand(spark, data):
    docs, names = spark.read.parquet(f"{data}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    columns, tables = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], data), "test-stage"))
    assert all(t.columns == columns for t in tables[:-1])
    raw, clean, single, private, mixed, packed = ([tuple(r) for r in t.collect()] for t in tables)
    bad = {r["doc_id"] for r in toxicity.query(docs, spark.read.parquet(f"{data}/labels.parquet")).where("predicted = 1").collect()}
    assert Counter(clean) == Counter(r for r in raw if r[0] not in bad)
    groups = brute([r[1] or "" for r in sorted(clean)])
    assert sorted(r[0] for r in single) == sorted({sorted(clean)[g][0] for g in groups})
    expected = {r[0]: pii.redact(r[1], pii.find(r[1], pii.anchors())) for r in single}
    assert {r[0]: r[1] for r in private} == expected and all(r[4] == len(r[1]) for r in private)
    taken = {r["doc_id"] for r in mixing.mix(tables[3], 0.8, 1).collect()}
    assert Counter(mixed) == Counter(r for r in private if r[0] in taken)
    assert {r[0] for r in packed} == {r[0] for r in mixed}


def test_run_is_the_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, data), "test-run")
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    key = ["doc_id", "doc_tokens"]
    tokens = lambda df: Counter(map(tuple, df.select(*key).distinct().collect()))
    assert tokens(corpus_pipeline.run(spark, data)) == tokens(last)


def test_empty_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, data), "test-empty")
        assert out.count() == 0
