"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities: words of a lexicon (a fixed seed list, and words and word stems that mark
toxic documents among the training labels), how near lexicon words stand to second-person words, capitals,
punctuation, and words with signs or digits in them as in obfuscated insults. An isotonic regression turns the trees'
output into a probability. It is fitted to all training rows, each judged by a lexicon and trees that have not seen it,
and read as a line through the middles of its steps, so that texts keep their order.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, small_batches, stored, unused, with_arrow_columns
from .learning import held_out, training_labels

#: Insults to start from, and words of the second person.
SEEDS = frozenset("idiot idiots moron morons stupid loser losers scum trash clown pathetic worthless disgusting".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta vous votre tú ti usted ustedes vos".split())
WORDS = re.compile(r"[^\W\d_]+")
OBFUSCATED = re.compile(r"(?<!\S)[^\W\d_]+[@$!#*0-9]+[^\W\d_]+")
CAPITALS = re.compile(r"(?<!\w)[A-ZÄÖÜÀ-Ý]{2,}(?!\w)")
STEMS = (4, 5, 6)
NEAR = 4
FEATURES = ("log_words", "seed_hits", "seed_density", "hits", "density", "weight", "weight_density", "kinds", "near_you", "you_density", "capitals", "marks", "signs", "obfuscated", "newlines")


def terms(words: list[str]) -> set[str]:
    """Words, and stems of longer words with a star."""
    out = set(words)
    for k in STEMS:
        out.update([w[:k] + "*" for w in out if len(w) > k and w[-1] != "*"])
    return out


def term_counts(texts: DataFrame) -> DataFrame:
    """term, toxic, clean: in how many labelled texts of either kind each term is; summed in the batches first."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = Counter(), Counter()
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                counts[label >= 0.5].update(terms(WORDS.findall((text or "").lower())))
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (counts[1], counts[0]))], names=["term", "toxic", "clean"])

    return texts.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(texts: DataFrame, most: int = 400) -> dict[str, float]:
    """Weights (log odds) of at most `most` terms that stand out in toxic training texts."""
    n = {r["label"] >= 0.5: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    if not toxic or not clean:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(clean + 1.0))
    found = term_counts(texts).where(F.col("toxic") >= max(4, math.ceil(toxic / 200))).withColumn("odds", odds).where("odds > 2.5")
    return {r["term"]: r["odds"] for r in found.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(most).collect()}


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    text = text or ""
    words = WORDS.findall(text.lower())
    n, size = max(1, len(words)), max(1, len(text))
    seeds = hits = near = you = 0
    weight, kinds, last_you, last_hit = 0.0, set(), -99, -99
    stems = tuple({len(t) - 1 for t in lexicon if t[-1] == "*"})
    for i, w in enumerate(words):
        if w in SECOND_PERSON:
            you += 1
            last_you = i
            near += i - last_hit <= NEAR
            continue
        seed, odds = w in SEEDS, lexicon.get(w, 0.0)
        for k in stems:
            if len(w) > k:
                odds = max(odds, lexicon.get(w[:k] + "*", 0.0))
        if seed or odds:
            seeds += seed
            hits += 1
            weight += odds
            kinds.add(w)
            last_hit = i
            near += i - last_you <= NEAR
    marks = sum(text.count(c) for c in "!?")
    signs = sum(text.count(c) for c in "#$%&*@|")
    return [math.log1p(len(words)), seeds, seeds / n, hits, hits / n, weight, weight / n, len(kinds), near / n, you / n, len(CAPITALS.findall(text)) / n, marks / size, signs / size, len(OBFUSCATED.findall(text)) / n, text.count("\n") / size]


def with_features(docs: DataFrame, lexicon: dict[str, float], out: str = "features") -> DataFrame:
    """docs with the features of each whole text; null text counts as empty. A column named like out is replaced."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {out: pa.array([features(t, lexicon) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))}

    return with_arrow_columns(docs, run, {out: "array<double>"})


@dataclass(frozen=True)
class Forest:
    """A lexicon and the boosted trees over its features."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel

    def output(self, docs: DataFrame, out: str) -> DataFrame:
        """docs, every column of it, with the trees' probability of label 1 as column out, which is none of docs."""
        x, p, raw, kind, dense = unused(docs, "_x", "_p", "_raw", "_class", "_features")
        trees = self.trees.copy().setFeaturesCol(x).setProbabilityCol(p).setRawPredictionCol(raw).setPredictionCol(kind)
        rows = with_features(docs, self.lexicon, dense).withColumn(x, array_to_vector(dense))
        return trees.transform(rows).select(*columns_of(docs), F.element_at(vector_to_array(p), 2).alias(out))


def grow(texts: DataFrame, rounds: int, depth: int, seed: int) -> Forest:
    """The lexicon and trees of texts (text, label), which have both labels."""
    lexicon = learn_lexicon(texts)
    rows = stored(with_features(texts.select("text", "label"), lexicon).select("label", array_to_vector("features").alias("x")), "toxic-fit").cache()
    trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.3, minInstancesPerNode=5, seed=seed).fit(rows)
    rows.unpersist()
    return Forest(lexicon, trees)


def knots(boundaries: list[float], predictions: list[float]) -> list[tuple[float, float]]:
    """The corners of a rising line from (0, 0) to (1, 1) through the middles of an isotonic regression's steps."""
    steps: list[list[float]] = []
    for x, y in zip(boundaries, predictions):
        if steps and steps[-1][2] == y:
            steps[-1][1] = x
        else:
            steps.append([x, x, y])
    middles = [((a + b) / 2, y) for a, b, y in steps]
    return [(0.0, 0.0), *((x, y) for x, y in middles if 0 < x < 1), (1.0, 1.0)]


#: How much of a score is the trees' own output, which keeps the order of texts whose calibrated values are equal.
ORDER = 0.02


def along(corners: list[tuple[float, float]], p: Column) -> Column:
    """The height of the line at p."""
    xs, ys = (F.array(*(F.lit(float(c[i])) for c in corners)) for i in (0, 1))
    k = F.least(F.size(F.filter(xs, lambda x: x <= p)), F.lit(len(corners) - 1))
    at = lambda v, i: F.element_at(v, i)
    x0, x1, y0, y1 = at(xs, k), at(xs, k + 1), at(ys, k), at(ys, k + 1)
    return y0 + (y1 - y0) * (p - x0) / (x1 - x0)


def scored(docs: DataFrame, labels: DataFrame, out: str, fit_rows: int = 20_000, rounds: int = 20, depth: int = 3, seed: int = 1, folds: int = 3) -> DataFrame:
    """docs, every column and row of it, with the score as column out, which is none of docs; higher: label 1 is likelier.

    Labels are read only for rows whose crc32(doc_id as text) mod 3 is not 1, and about `fit_rows` of those at most
    are used for fitting; every text is scored whole. All of them teach the lexicon and the trees; for the calibration
    each is judged by trees of the other folds. A fold whose other folds lack a label is left out of that, and if all
    are, the calibration is that of the trees' own rows. Null and empty texts are scored by their zero features. Each row
    is scored by its own text, whether ids repeat or are missing; rows of a null doc_id are never learned from. Without
    labels of both kinds nothing can be learned and every score is 0. An empty table gives none. Very long texts are read
    whole. Extra columns pass through, whatever their names.
    """
    known = stored(training_labels(labels, "toxic", 3, 1, fit_rows), "toxic-labels")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(folds))
    texts = stored(docs.select("doc_id", "text").join(known, "doc_id").withColumn("fold", fold), "toxic-training")
    seen = {(r["fold"], r["label"] >= 0.5) for r in texts.select("fold", "label").distinct().collect()}  # two a fold at most
    if len({kind for _, kind in seen}) < 2:
        return docs.withColumn(out, F.lit(0.0))
    forest, held = grow(texts, rounds, depth, seed), []
    for k in sorted({f for f, _ in seen}):
        if len({kind for f, kind in seen if f != k}) == 2:
            held.append(grow(texts.where(F.col("fold") != k), rounds, depth, seed).output(texts.where(F.col("fold") == k).select("text", "label"), "p"))
    judged = reduce(DataFrame.unionByName, held) if held else forest.output(texts.select("text", "label"), "p")
    rising = IsotonicRegression(featuresCol="p", labelCol="label").fit(stored(judged.select("label", "p"), "toxic-judged"))
    corners = knots(rising.boundaries.tolist(), rising.predictions.tolist())
    (p,) = unused(docs, "_p")
    found = forest.output(docs, p)
    value = (1 - ORDER) * along(corners, F.col(p)) + ORDER * F.col(p)
    return found.select(*columns_of(docs), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias(out))


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, rounds: int = 20, depth: int = 3, seed: int = 1) -> DataFrame:
    """doc_id, score of every row of docs, as scored() gives them. Extra columns are not used."""
    return scored(docs.select("doc_id", "text"), labels, "score", fit_rows, rounds, depth, seed)["doc_id", "score"]


def query(docs: DataFrame, labels: DataFrame, reject: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null doc_id is not held out. Otherwise as scored()."""
    found = score(docs, labels)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= reject).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, reject: float = 0.7) -> DataFrame:
    """documents whose score is below reject, with the columns unchanged.

    Each row is judged by its own text: rows without doc_id go like others, and of rows that share one only toxic ones.
    """
    (out,) = unused(docs, "_score")
    return scored(docs, labels, out).where(F.col(out) < reject).select(columns_of(docs))
