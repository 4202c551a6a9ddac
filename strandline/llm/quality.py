"""Text quality by a sparse rule ensemble.

Statistics of a text are Spark column expressions. Shallow trees are fitted to labelled rows; each of their paths
is a conjunctive rule over the statistics. A lasso logistic regression weighs the rules and leaves most at zero;
the rest are compiled into one Spark column expression, which scores every row without any Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_text
from .learning import held_out, training_labels


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def statistics(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc_id and the statistics of each whole text; null counts as empty, whose shares are all zero."""
    text = whole_text("text")
    words, lines = F.split(F.lower(text), r"\s+"), F.split(text, "\n")
    # Counted once per row: the arrays are columns of their own, so that later expressions don't split again.
    arrays = docs.select("doc_id", text.alias("t"), words.alias("w"), lines.alias("l"))
    n, nw, nl = F.length("t"), F.size("w"), F.size("l")
    count = lambda pattern: F.regexp_count("t", F.lit(pattern))
    stats = {
        "log_chars": F.log1p(n.cast("double")),
        "chars_a_word": ratio(n, nw),
        "distinct_words": ratio(F.size(F.array_distinct("w")), nw),
        "distinct_lines": ratio(F.size(F.array_distinct("l")), nl),
        "chars_a_line": F.log1p(ratio(n, nl)),
        "signs": ratio(count(r"[#$%&*@\\^~<>{}\[\]]"), n),
        "bars": ratio(count(r"\|"), nw),
        "shouts": ratio(count("!"), nw),
        "capitals": ratio(count(r"\p{Lu}"), n),
        "digits": ratio(count("[0-9]"), n),
        "stops": ratio(count(r"[.,;:?]"), nw),
        "doubled": ratio(F.regexp_count("t", F.lit(r"(?i)(?<!\S)(\S+)\s+\1(?!\S)")), nw),
    }
    return arrays.select("doc_id", *(v.alias(k) for k, v in stats.items())), list(stats)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, 1 for at most or -1 for above, threshold)."""

    terms: tuple[tuple[int, int, float], ...]

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for i, side, cut in self.terms:
            out = out & (F.col(names[i]) <= cut if side > 0 else F.col(names[i]) > cut)
        return out


def paths(tree: str) -> set[Rule]:
    """The rules of a tree as Spark ML prints it: one for each path from the root to a node below it."""
    out, stack = set(), []
    for line in tree.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, (int(m[3]), 1 if m[4] == "<=" else -1, float(m[5]))))
        tightest: dict[tuple[int, int], float] = {}
        for _, (i, side, cut) in stack:
            k = (i, side)
            tightest[k] = cut if k not in tightest else min(tightest[k], cut) if side > 0 else max(tightest[k], cut)
        out.add(Rule(tuple(sorted((i, side, cut) for (i, side), cut in tightest.items()))))
    return out


def fit_rules(rows: DataFrame, names: list[str], lasso: float = 0.002, seed: int = 1) -> tuple[float, list[tuple[float, Rule]]]:
    """The intercept and the weighted rules that the lasso keeps; rows has label and the statistics."""
    x = rows.select("label", array_to_vector(F.array(*names)).alias("x")).cache()
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=12, maxDepth=3, minInstancesPerNode=5, seed=seed).fit(x)
    boosted = GBTClassifier(featuresCol="x", labelCol="label", maxIter=8, maxDepth=3, stepSize=0.3, minInstancesPerNode=5, seed=seed).fit(x)
    x.unpersist()
    rules = sorted(set().union(*(paths(t.toDebugString) for m in (forest, boosted) for t in m.trees)), key=lambda r: r.terms)
    if not rules:
        return math.nan, []
    fired = rows.select("label", array_to_vector(F.array(*(r.column(names).cast("double") for r in rules))).alias("r")).cache()
    model = LogisticRegression(featuresCol="r", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(fired)
    fired.unpersist()
    return model.intercept, [(float(w), r) for w, r in zip(model.coefficients.toArray(), rules) if w]


def compiled(intercept: float, rules: list[tuple[float, Rule]], names: list[str]) -> Column:
    """The probability of label 1 as one column expression."""
    total = F.lit(intercept)
    for w, rule in rules:
        total = total + F.when(rule.column(names), w).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, seed: int = 1) -> DataFrame:
    """doc_id, score of every row of docs; higher: label 1 is likelier.

    Labels are read only for rows whose crc32(doc_id as text) mod 5 is not 0, and about `fit_rows` of those at most
    are used for fitting; every text is scored whole. Null and empty texts are scored by their zero statistics.
    Repeated rows and ids get a row each; a null doc_id is scored but never learned from. With labels of one kind
    only, every score is that label; without any it is 0.5. Extra columns are not used.
    """
    stats, names = statistics(docs)
    stats = stored(stats, "quality-statistics")
    known = training_labels(labels, "quality", 5, 0, fit_rows)
    rows = stored(stats.join(known, "doc_id"), "quality-training")
    kinds = [r["label"] for r in rows.select("label").distinct().collect()]  # two at most
    if len(kinds) < 2:
        return stats.select("doc_id", F.lit(kinds[0] if kinds else 0.5).alias("score"))
    intercept, rules = fit_rules(rows, names, seed=seed)
    if not rules:
        return stats.select("doc_id", F.lit(rows.agg(F.avg("label")).first()[0]).alias("score"))
    return stats.select("doc_id", compiled(intercept, rules, names).alias("score"))


def query(docs: DataFrame, labels: DataFrame, keep: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null doc_id is not held out. Otherwise as score()."""
    found = score(docs, labels)
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= keep).cast("int").alias("predicted"))
