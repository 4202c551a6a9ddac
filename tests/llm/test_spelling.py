"""Spelling variants against brute force, and what the gram index promises under every edit."""

import random
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import spelling
from tests.llm.conftest import rows


def edits(word, letters="abé"):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + d :] for i in range(len(word) + 1) for c in letters for d in (0, 1) if i + d <= len(word)}
    return out - {word}


@settings(max_examples=200, deadline=None)
@given(st.text("abé", min_size=5, max_size=40), st.sets(st.text("abé\x02\x03", min_size=2, max_size=5), max_size=60), st.integers(2, 3), st.sampled_from((8, 24)))
def test_a_lookup_survives_every_edit(word, frequent, least, reach):
    """Whatever grams are frequent, the longer of two near words holds one of the shorter one's two grams, and only the
    one that the agreeing beginning names need be looked up."""
    grams = spelling.Grams({g: 40 + len(g) for g in frequent}, least, 5, reach)
    s = grams.marked(word)
    found = grams.decompose(s)
    (a, e), (c, d) = grams.lookups(s, found)
    assert {(a, e), (c, d)} <= set(found) and d - e >= grams.longest
    for other in edits(word):
        if len(other) < len(word):
            continue
        t = grams.marked(other)
        held = {(t[x:y], x, len(t) - y) for x, y in grams.decompose(t)}
        longer, upto = len(other) - len(word), max(0, e - grams.marks)
        if word[:upto] == other[:upto]:
            assert (s[a:e], a, len(s) - e + longer) in held
        else:
            assert (s[c:d], c + longer, len(s) - d) in held


def brute(table, one_in=97):
    """The contract word by word; near words by trying all pairs of about equal length."""
    found = Counter()
    for doc, text, *_ in table:
        run = ""
        for ch in (text or "") + " ":
            if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                run += ch.lower() if ch < "\x80" else ch
            elif run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                at = h % len(run)
                found[run[:at] + run[at + 1 :] if h % one_in == 0 else run] += 1
                run = ""
    words = {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[i:] == b[i + 1 :])

    out, form = {}, {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = [form[w], None, n, len(close), words.get(form[w])]
    for w in out:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w][1] = root
    return {(w, *v) for w, v in out.items()}


def test_query(spark, docs, empty):
    found = spelling.query(docs)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in found.collect()} == brute(rows())
    assert spelling.query(empty).collect() == []


def test_chains_hot_grams_and_long_words(spark):
    r = random.Random(3)
    base = ["antiform", "informal", "performer", "éclairé", "x" * 300, "a" * 700 + "b" * 700]
    words = [*base, *(w[:i] + c + w[i + d :] for w in base for i, c, d in ((r.randrange(len(w)), r.choice("abé"), r.randrange(2)) for _ in range(40)))]
    table = [(None if i % 9 == 0 else i % 5, " ".join(r.choice(words) for _ in range(60)).upper() + "!" + " ".join(r.sample(words, 30))) for i in range(120)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    found = {tuple(x) for x in spelling.query(docs).collect()}
    assert found == brute(table)
    assert any(f is not None and root != f for _, f, root, *_ in found) and max(len(w) for w, *_ in found) > 1000


def test_counts_come_in_parts(spark, docs):
    whole = {tuple(x) for x in spelling.variants(docs).collect()}
    assert {tuple(x) for x in spelling.variants(docs, most=5).collect()} == whole
    assert {tuple(x) for x in spelling.vocabulary(docs, 1, 1).collect()} == whole
