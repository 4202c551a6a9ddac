"""The audit against its SQL on awkward rows, and against plain Python on many ties."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.llm import divergence
from tests.llm.conftest import prose, rows


def by_sql(table, **limits):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [list(r[:4]) for r in table])
    return Counter(con.execute(divergence.sql(**limits)).fetchall())


def by_hand(table, least, most):
    """The contract term by term, in Python's whole numbers."""
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in table:
        terms, run = [], ""
        for ch in (text or "") + " ":
            if ch > "\x7f" or "A" <= ch <= "Z" or "a" <= ch <= "z":
                run += ch.lower() if ch < "\x80" else ch
            elif run:
                terms, run = [*terms, run], ""
        counts[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = Counter()
    for lang in seen:
        kept = [t for t in seen[lang] if seen[lang][t] >= least]
        own = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        shares, q = {s: p(c) for s, c in own.items()}, p(whole)
        for s, a in shares.items():
            pairs = sorted((-sum((a[t] - b[t]) ** 2 // b[t] for t in kept), x.encode(), x) for x, b in shares.items() if x != s)
            terms = sorted((-((a[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if own[s][t] and a[t] > q[t])
            for part, found in (("pair", pairs), ("term", terms[:most])):
                out.update((lang, s, part, x, -v, k) for k, (v, _, x) in enumerate(found, 1))
    return out


def grouped(seed, n):
    """Few words with many ties, a source without kept terms, nulls and one hot source."""
    r = random.Random(seed)
    words = ["Ab", "ab", "cd", "éa", "漢字", "ÿ", "zz", "😀", "￿", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))]
    out = [(i, " ".join(r.choices(words, k=r.randrange(12))), r.choice(("en", "de", None)), r.choice(("hot", "hot", "hot", "b", "c", None))) for i in range(n)]
    return [*out, (n, "unseen alone", "en", "lonely"), (n + 1, None, "en", "empty"), (n + 2, "rare", "xx", "y"), (n + 3, "", "xx", "z"), (None, "ab", "", ""), (None, "ab", "", "")]


@pytest.mark.parametrize("least, most", ((3, 200), (1, 4)))
def test_audit(spark, docs, least, most):
    found = divergence.audit(docs, least, most)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, found.collect())) == by_sql(rows(), least=least, most=most) == by_hand(rows(), least, most)


def test_ties_and_hot_source(spark):
    table = grouped(7, 400)
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string").repartition(5)
    for most in (1, 7, 30, 200):
        assert Counter(map(tuple, divergence.audit(docs, 3, most).collect())) == by_hand(table, 3, most)


def test_one_long_text_among_copies(spark):
    table = [(i, prose(3, 40), "en", f"s{i % 3}") for i in range(60)] + [(99, prose(5, 30_000), "en", "long")]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string")
    assert Counter(map(tuple, divergence.audit(docs, 3, 20).collect())) == by_hand(table, 3, 20)


def test_counts_come_in_parts(spark, docs):
    whole = Counter(map(tuple, divergence.term_counts(docs).collect()))
    assert Counter(map(tuple, divergence.term_counts(docs, most=3).collect())) == whole


def test_empty_tables_and_large_counts(spark, empty):
    assert divergence.audit(empty).collect() == []
    big = spark.createDataFrame([(10**13, 10**14, 10**6), (0, 0, 0)], "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")))
    assert [r[0] for r in big.collect()] == [1 + 10**9 * (10**13 + 1) // (10**14 + 10**6), None]

