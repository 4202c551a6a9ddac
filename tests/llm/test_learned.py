"""The learned classifiers and the media store, piece by piece against plain Python."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandline.llm import media, packing, quality, toxicity
from strandline.llm.common import stored
from strandline.llm.queries import tokenizer_path
from tests.llm.conftest import prose, rows

SMALL, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def area(scores, labels):
    """The share of pairs of unequal labels that the scores put in order, ties half."""
    pos, neg = ([s for s, y in zip(scores, labels) if y == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_toxicity_orders_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    found = [(r["score"], known[r["doc_id"]]) for r in toxicity.query(docs, labels).where("held_out").collect() if r["doc_id"] in known]
    scores, marks = zip(*found)
    assert area(scores, marks) > 0.93
    assert len(set(scores)) > len(scores) // 3  # no few steps that tie nearly all
    assert np.mean([(s >= 0.7) == (y == 1) for s, y in found]) > 0.95


def test_calibration_is_by_rows_not_seen(spark):
    """Labels that no feature explains: trees fit their own rows, a calibration on others must not believe them."""
    r = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(r.random(900) < 0.3)], "doc_id long, toxic int")
    scores = [x["score"] for x in toxicity.query(docs, labels).collect()]
    assert abs(np.mean(scores) - 0.3) < 0.08


def test_few_labels_fit_without_a_fold_of_their_own(spark):
    docs = spark.createDataFrame([(i, prose(i, 20) + (" idiot" if i % 2 else "")) for i in range(12)], "doc_id long, text string")
    for n in (2, 3, 12):
        found = toxicity.query(docs, spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")).collect()
        assert len(found) == 12 and all(0 <= r["score"] <= 1 for r in found)


def test_line_through_steps(spark):
    corners = toxicity.knots([0.1, 0.3, 0.5, 0.9], [0.0, 0.0, 0.5, 1.0])
    assert corners == [(0.0, 0.0), (0.2, 0.0), (0.5, 0.5), (0.9, 1.0), (1.0, 1.0)]
    p = [0.0, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9, 0.95, 1.0]
    found = [r["v"] for r in spark.createDataFrame([(x,) for x in p], "p double").select("p", toxicity.along(corners, F.col("p")).alias("v")).orderBy("p").collect()]
    assert found == pytest.approx(np.interp(p, *zip(*corners)))
    assert toxicity.knots([0.4], [0.3]) == [(0.0, 0.0), (0.4, 0.3), (1.0, 1.0)]


def statistics(text):
    """quality.statistics() by plain Python."""
    text = text or ""
    words, lines = re.split(r"[ \t\n\x0b\f\r]+", text.lower()), text.split("\n")
    n, nw, nl = len(text), len(words), len(lines)
    share = lambda a, b: a / b if b else 0.0
    count = lambda chars: sum(c in chars for c in text)
    doubled, at = 0, 0
    tokens = [t.encode().lower() for t in re.findall(r"[^ \t\n\x0b\f\r]+", text)]  # case counts beyond ASCII
    while at < len(tokens) - 1:  # pairs of equal neighbours, none used twice
        if tokens[at] == tokens[at + 1]:
            doubled, at = doubled + 1, at + 2
        else:
            at += 1
    return [
        math.log1p(n), share(n, nw), share(len(set(words)), nw), share(len(set(lines)), nl), math.log1p(share(n, nl)), share(count("#$%&*@\\^~<>{}[]"), n),
        share(count("|"), nw), share(count("!"), nw), share(sum(c.isupper() for c in text), n), share(count("0123456789"), n), share(count(".,;:?"), nw), share(doubled, nw),
    ]


def test_statistics(spark, docs):
    more = [(100, "A A a\nb|c! d; é É"), (101, "x x x x y"), (102, "line\nline\n\n#$ ^~ {1}"), (103, "the The THE end.")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    found, names = quality.statistics(table)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, *(round(r[n], 9) for n in names)) for r in found.collect())
    texts = [(r[0], r[1]) for r in rows()] + more
    assert got == sorted((i is not None, i or 0, *(round(v, 9) for v in statistics(t))) for i, t in texts)


def test_compiled_rules_are_the_rules(spark):
    table, names = spark.createDataFrame([(i, (i * 7 % 11) / 10, (i * 5 % 13) / 10) for i in range(60)], "doc_id long, u double, v double"), ["u", "v"]
    rules = [(1.5, quality.Rule(((0, 1, 0.5),))), (-2.0, quality.Rule(((0, -1, 0.3), (1, 1, 0.7)))), (0.25, quality.Rule(((1, -1, 0.2), (1, 1, 0.9))))]

    def by_hand(row):
        fired = lambda rule: all(row[i] <= cut if side > 0 else row[i] > cut for i, side, cut in rule.terms)
        return 1 / (1 + math.exp(-(-0.4 + sum(w for w, rule in rules if fired(rule)))))

    for r in table.select("u", "v", quality.compiled(-0.4, rules, names).alias("p")).collect():
        assert r["p"] == pytest.approx(by_hand((r["u"], r["v"])))


def test_quality_keeps_good_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    found = [(r["score"], known[r["doc_id"]]) for r in quality.query(docs, labels).where("held_out").collect() if r["doc_id"] in known]
    assert area(*zip(*found)) > 0.97 and np.mean([(s >= 0.3) == (y == 1) for s, y in found]) > 0.95


def test_media_by_hand(docs):
    """Stored form, feature and chunk ends from their definitions."""
    found = {(r["doc_id"], r["n_bytes"]): r for r in media.query(docs).collect()}
    for i, t, *_ in rows():
        data = (t or "").encode()
        payload = data + b"\0" * (max(64, (len(data) + 63) // 64 * 64) - len(data))
        n = len(payload)
        head = b"RIFF" + (n + 36).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + bytes([1, 0, 1, 0]) + (8000).to_bytes(4, "little") * 2 + bytes([1, 0, 8, 0]) + b"data" + n.to_bytes(4, "little")
        r = found[i, len(data)]
        assert r["media_bytes"] == n + 44 and r["media_sha256"] == hashlib.sha256(head + payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        counts = [payload.count(b) for b in range(256)]
        mean = sum(b * c for b, c in enumerate(counts)) / n
        spread = math.sqrt(sum((b - mean) ** 2 * c for b, c in enumerate(counts)) / n)
        entropy = -sum(c / n * math.log2(c / n) for c in counts if c)
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:]))
        got = dict(x.split("=") for x in r["feature"].split(";"))
        assert [float(got[k]) for k in ("mean", "std", "entropy")] == pytest.approx([mean, spread, entropy], abs=2e-6) and int(got["crossings"]) == crossings


def test_chunk_ends_roll():
    data = media.padded(prose(5, 9_000))
    h, ends, last, mask = 0, [], 0, (1 << 64) - 1
    gear = media.gear_table().tolist()
    for i, b in enumerate(data):
        h = ((h << 1) + gear[b]) & mask  # a byte's word is shifted out after 64 bytes
        if i + 1 - last >= media.LEAST and (h >> 40) & (media.AVERAGE - 1) == 0 or i + 1 - last == media.MOST or i + 1 == len(data):
            ends.append(i + 1)
            last = i + 1
    assert media.cuts(data) == ends and len(ends) > 3


def test_a_spoilt_chunk_is_noticed(spark):
    docs = spark.createDataFrame([(i, prose(i, 3_000)) for i in range(4)], "doc_id long, text string")
    recipes = stored(media.catalog(docs), "test-catalog")
    store, raw = media.chunk_store(docs)
    store = stored(store, "test-chunks")
    other = store.orderBy("digest").first()
    spoilt = store.withColumn("z", F.when(F.col("digest") != F.lit(bytearray(other["digest"])), F.lit(bytearray(other["z"]))).otherwise(F.col("z")))
    assert media.read(store, raw, recipes.select("media", "digests")).count() == 4
    with pytest.raises(Exception, match="isn't what its digest says"):
        media.read(spoilt, raw, recipes.select("media", "digests")).count()


@pytest.mark.parametrize("folder, most", ((SMALL, 1_000), (LARGE, 8_192)))
def test_most_tokens_stay_where_sum_of_squares_put_them(folder, most):
    texts = pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist()[:most]
    ids, p, total = packing.ids_of(tokenizer_path(), 2), packing.Packer(4096, 0), 0
    for doc, text in enumerate(texts):
        x = ids(text)
        total += len(x) // 4
        p.add(doc, x)
    p.finish()
    assert len(texts) == most and p.moved < 0.1 * total
    print(f"{most} documents: {p.moved / total:.3%} moved")
