"""The near-duplicate stage against brute-force likeness of 5-word shingles."""

import random

import corpus_pipeline
from strandline.llm import likeness, simhash
from strandline.llm.common import stored
from tests.llm.conftest import KIND, prose


def grams(text):
    w = text.lower().split()
    return frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def brute(texts, least=0.8):
    """For each text the place of the first one of its component."""
    sets, parent = [grams(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) >= least * len(x | y) - 1e-9:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def edited(text, seed, share):
    r = random.Random(seed)
    words = text.split()
    for i in r.sample(range(len(words)), max(1, int(share * len(words)))):
        words[i] = f"new{seed}x{i}"
    return " ".join(words)


def near_copies():
    """Edits around the limit, one large group of edits of one text, a common passage, texts of few words."""
    texts = [edited(prose(100 + i, 150), i * 10 + j, 0.004 * j) for i in range(12) for j in range(10)]
    texts += [edited(prose(99, 120), 1000 + i, 0.012 + 0.01 * (i % 3)) for i in range(90)]
    texts += [prose(98, 60) + " " + prose(500 + i, 10 + 2 * i) for i in range(40)]
    return texts + ["", " \n", "one", "one", "ONE two", "one two", prose(97, 5), prose(97, 6)]


def test_stage_equals_brute_force_likeness(spark, data):
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, data)
    expected = set(brute(texts))
    assert 20 < len(expected) < len(texts) - 100
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(expected)


def test_stage_on_the_given_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id")
    table = docs.collect()
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, data)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({table[g]["doc_id"] for g in brute([r["text"] or "" for r in table])})


def test_rows_that_share_an_id_or_have_none(spark):
    a, b = prose(1, 80), prose(2, 80)
    table = [(1, a)] * 50 + [(1, b), (2, b), (None, a), (None, prose(3, 50)), (None, prose(3, 50))]
    docs = spark.createDataFrame([(i, t, 7) for i, t in table], "doc_id long, text string, run long").repartition(3)
    kept = sorted(((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(docs, least=0.8).collect()))
    assert kept == sorted([(1, a), (1, b), (0, prose(3, 50))])
    assert simhash.keep_one(spark.createDataFrame([], KIND), least=0.8).count() == 0


def test_one_shingle_in_every_text(spark):
    """A passage that all texts share, in batches so small that it is counted many times, and a low limit of what is sent out."""
    shared = prose(77, 12)
    texts = [f"{shared} {prose(i % 60, 30 + i % 7)}" for i in range(240)] + [edited(f"{shared} {prose(5, 90)}", i, 0.01) for i in range(60)]
    base = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string").repartition(6)
    base = stored(likeness.with_node(base), "test-base").cache()
    nodes = {r["row"]: r["node"] for r in base.select("row", "node").collect()}
    for limit in (1, 50, 40_000_000):
        found = {r["node"]: r["component"] for r in likeness.alike(base, 0.8, broadcast=limit).collect()}
        groups, by_component = {}, {}
        for i, g in enumerate(brute(texts)):
            groups.setdefault(g, set()).add(nodes[i])
        for n in nodes.values():
            by_component.setdefault(found.get(n, n), set()).add(n)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, by_component.values()))


def test_common_shingles_are_counted_over_all_batches(spark):
    from collections import Counter

    texts = [f"{prose(1, 8)} {prose(i, 9)} {prose(i % 3, 7)}" for i in range(40)]
    base = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    counts = Counter(h for t in texts for h in likeness.shingles(t).tolist())
    for most in (1, 12, 39):
        assert likeness.common(base, 5, most, 5).tolist() == sorted(h for h, n in counts.items() if n > most)
