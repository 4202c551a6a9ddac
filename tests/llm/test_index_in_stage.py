"""The Gray-order index within the near-duplicate stage: its links are there, are confirmed, and spare candidates."""

import corpus_pipeline
from strandline.llm import likeness, simhash
from strandline.llm.common import stored
from tests.llm.conftest import prose
from tests.llm.test_likeness import brute, edited

KIND = "doc_id long, text string"


def texts():
    """Long near copies within 2 bits, equal fingerprints of unlike sets of shingles, and texts by themselves."""
    out = [edited(prose(i, 600), 50 + j, 0.0001) if j else prose(i, 600) for i in range(8) for j in range(5)]
    line = "the very same line again and again "
    return out + [line * 40 + prose(200 + i, 30) for i in range(6)] + [prose(300 + i, 50) for i in range(10)] + ["", "one", "one"]


def near_groups(values):
    parent = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 2 and parent[i] != parent[j]:
                parent = [parent[j] if p == parent[i] else p for p in parent]
    return parent


def by_group(names, groups):
    found = {}
    for n, g in zip(names, groups):
        found.setdefault(g, set()).add(n)
    return sorted(map(sorted, found.values()))


def test_stage_links_by_the_index(spark, data, monkeypatch):
    """With the prefix filter silenced, the stage links exactly what lies within 2 bits and is alike."""
    table = list(enumerate(texts()))
    docs = spark.createDataFrame(table, KIND).repartition(3)
    full = likeness.candidates
    monkeypatch.setattr(likeness, "candidates", lambda *a: full(*a).where("false"))
    kept = sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, data).collect())
    values = [simhash.fingerprint(t) for _, t in table]
    sets = [set(likeness.shingles(t).tolist()) for _, t in table]
    parent = list(range(len(table)))
    for i in range(len(table)):
        for j in range(i):
            close = bin(values[i] ^ values[j]).count("1") <= 2 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if close and parent[i] != parent[j]:
                parent = [parent[j] if p == parent[i] else p for p in parent]
    assert len(kept) == len(set(parent)) < len(table) - 20
    monkeypatch.undo()
    kept = sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, data).collect())
    assert kept == sorted(set(brute([t for _, t in table])))


def test_pairs_connect_all_fingerprints_within_reach(spark):
    table = [(simhash.fingerprint(t), likeness.node_of(likeness.shingles(t))) for t in texts()]
    signed = [(f - (1 << 64) if f >> 63 else f, n) for f, n in table]
    pairs = simhash.near_nodes(spark.createDataFrame(signed, "fp long, node long"), 2).collect()
    assert all(p["a"] < p["b"] for p in pairs)
    parent = {n: n for _, n in table}
    for p in pairs:
        x, y = parent[p["a"]], parent[p["b"]]
        parent = {n: x if g == y else g for n, g in parent.items()}
    nodes = [n for _, n in table]
    assert by_group(nodes, [parent[n] for n in nodes]) == by_group(nodes, near_groups([f for f, _ in table]))


def test_candidates_that_stand_together_are_not_compared(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (6, 7), (1, 6)], "a long, b long")
    group = spark.createDataFrame([(1, 1), (2, 1), (6, 6), (8, 6)], "node long, component long")
    assert sorted(map(tuple, likeness.joined_apart(pairs, group).collect())) == [(1, 3), (1, 6), (4, 5), (6, 7)]
    assert stored(likeness.joined_apart(pairs, group), "test-apart").columns == ["a", "b"]
