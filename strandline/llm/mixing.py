"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A token budget flows down a tree domain > language > source in proportion to weights. No node gets more than its
subtree holds over `max_epochs` passes; what a node cannot use goes to its siblings in proportion to their weights,
and only what all siblings together cannot use was never theirs: an ancestor is capped by the sum below it, so that
part is shared out one level higher. Each leaf then takes whole seeded epochs (each with an order of its own) and
the token-prefix of the last one; the document on the boundary is kept whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import WORD, columns_of, stored, whole_text

#: Hexadecimal digits of a document's place that name its slice of a leaf: 16 ** 3 slices, each summed on its own.
SLICE = 3


def domain_of(source: Column) -> Column:
    """The domain of a source by its number: web below 10, reference below 15, forum from 15 on, other without one."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1).try_cast("int")
    return F.when(n < 10, "web").when(n < 15, "reference").when(n.isNotNull(), "forum").otherwise("other")


def weight(key: Column, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(key == name, w).otherwise(out)
    return out.cast("double")


def waterfill(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """budget of each node: the parent's (`given`) in proportion to `w`, but at most `cap`, the excess to siblings.

    Siblings in the order of cap / w: a node is full if its cap is within the level that the rest could share.
    """
    order = W.partitionBy(*parent).orderBy(F.expr("cap / w"), key)
    level = (F.col("given") - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    out = nodes.withColumn("level", level).withColumn("full", F.expr("cap / w") <= F.col("level"))
    top = F.max(F.when(~F.col("full"), F.col("level"))).over(W.partitionBy(*parent))
    return out.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(F.lit(0.0), top) * F.col("w"))).drop("level", "full")


def budgets(leaves: DataFrame, share: float, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """leaves (domain, lang, source, tokens) with budget, the tokens that each gives."""
    cap = F.sum(F.col("tokens") * max_epochs).cast("double").alias("cap")
    sources = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    domains = leaves.groupBy("domain").agg(cap, F.sum("tokens").alias("own"))
    domains = domains.withColumn("given", F.floor(F.sum("own").over(W.partitionBy(F.lit(0))) * F.lit(share)).cast("double"))
    domains = waterfill(domains.withColumn("w", weight(F.col("domain"), weights.get("domain", {}), 5)).withColumn("all", F.lit(0)), ["all"], "domain")
    langs = leaves.groupBy("domain", "lang").agg(cap).join(domains.select("domain", F.col("budget").alias("given")), "domain")
    langs = waterfill(langs.withColumn("w", weight(F.col("lang"), weights.get("lang", {}), 5)), ["domain"], "lang")
    sources = sources.join(langs.select("domain", "lang", F.col("budget").alias("given")), ["domain", "lang"])
    sources = waterfill(sources.withColumn("w", weight(F.col("source"), weights.get("source", {}), 1)), ["domain", "lang"], "source")
    return sources.select("domain", "lang", "source", "tokens", F.round("budget").cast("long").alias("budget"))


WEIGHTS = {"domain": {"web": 50, "reference": 30, "forum": 20}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}}


def mix(docs: DataFrame, share: float = 0.6, max_epochs: int = 2, seed: int = 7, weights: dict[str, dict[str, int]] = WEIGHTS, digest: str | None = None) -> DataFrame:
    """A row for each document and epoch taken: doc_id, epoch (from 1), domain, lang, source, tokens.

    share: the budget as a share of all tokens (words). Null text counts no tokens; such documents, and empty ones,
    are taken with the prefix they stand in. A null lang or source is the leaf part "unknown". Rows with equal
    doc_id are ordered by their tokens; those without one get their place by their text. An empty table gives none.
    Extra columns are not used. Leaves are cut into up to 4096 slices by seeded place; only small per-slice sums are
    ordered for a whole leaf, so that a leaf with a third of all rows is shared. digest: the name of one more column, a
    hash of the text.
    """
    more = [F.xxhash64(whole_text()).alias(digest)] if digest else []
    rows = docs.select(
        "doc_id", domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("source", F.lit("unknown")).alias("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("tokens"),
        F.when(F.col("doc_id").isNull(), F.md5(whole_text().cast("binary"))).alias("_own"), *more,
    )
    rows = stored(rows, "mix-tokens")
    leaf = ["domain", "lang", "source"]
    plan = budgets(rows.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")), share, max_epochs, weights)
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), "_own"))))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(max_epochs)))).withColumn("place", place)
    rows = rows.withColumn("slice", F.substring("place", 1, SLICE))
    part = [*leaf, "epoch", "slice"]
    slices = rows.groupBy(*part).agg(F.sum("tokens").alias("in_slice")).join(plan.select(*leaf, F.col("tokens").alias("in_leaf"), "budget"), leaf)
    before = F.sum("in_slice").over(W.partitionBy(*leaf, "epoch").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    rest = F.col("budget") - (F.col("epoch") - 1) * F.col("in_leaf") - F.coalesce(before, F.lit(0))
    slices = slices.withColumn("rest", rest).where("rest > 0").select(*part, "in_slice", "rest")
    rows = rows.join(slices, part)
    inside = rows.where("rest >= in_slice")
    edge = rows.where("rest < in_slice")
    so_far = F.sum("tokens").over(W.partitionBy(*part).orderBy("place", "doc_id", "tokens").rowsBetween(W.unboundedPreceding, -1))
    edge = edge.withColumn("so_far", F.coalesce(so_far, F.lit(0))).where("so_far < rest")
    out = ["doc_id", F.col("epoch").cast("long").alias("epoch"), *leaf, "tokens", *([digest] if digest else [])]
    return inside.select(*out).unionByName(edge.select(*out))


def mix_documents(docs: DataFrame, share: float = 0.8, seed: int = 7, weights: dict[str, dict[str, int]] = WEIGHTS) -> DataFrame:
    """documents that one seeded epoch takes under the target weights, with their columns unchanged.

    A row is taken by its doc_id and its text, so rows that share an id or have none are told apart; of rows equal in
    both, either all or none are taken.
    """
    taken = mix(docs, share, 1, seed, weights, "_digest").select(F.col("doc_id").alias("_taken"), "_digest").distinct()
    same = docs["doc_id"].eqNullSafe(taken["_taken"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == taken["_digest"])
    return docs.join(taken, same, "left_semi").select(columns_of(docs))


def sql(share: float = 0.6, max_epochs: int = 2, seed: int = 7, weights: dict[str, dict[str, int]] = WEIGHTS) -> str:
    """mix() over the table documents, for DuckDB."""

    def case(key: str, default: int) -> str:
        known = " ".join(f"WHEN {key} = '{k}' THEN {w}" for k, w in weights.get(key, {}).items())
        return f"CAST(CASE {known} ELSE {default} END AS DOUBLE)" if known else f"CAST({default} AS DOUBLE)"

    def fill(name: str, nodes: str, parent: str, key: str) -> str:
        by = f"PARTITION BY {parent}"
        return f"""{name}_l AS (SELECT *, (given - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({by} ORDER BY cap / w, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM ({nodes})),
{name} AS (SELECT *, CASE WHEN cap / w <= lvl THEN cap ELSE greatest(0.0, max(CASE WHEN cap / w > lvl THEN lvl END) OVER ({by})) * w END AS budget FROM {name}_l)"""

    return f"""WITH rows0 AS (
  SELECT doc_id, TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS INTEGER) AS n, coalesce(lang, 'unknown') AS lang,
    coalesce(source, 'unknown') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS tokens, CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END AS own FROM documents),
rows1 AS (SELECT doc_id, CASE WHEN n < 10 THEN 'web' WHEN n < 15 THEN 'reference' WHEN n IS NOT NULL THEN 'forum' ELSE 'other' END AS domain, lang, source, tokens, own FROM rows0),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM rows1 GROUP BY ALL),
{fill('domains', f"SELECT domain, 0 AS top, CAST(sum(tokens) * {max_epochs} AS DOUBLE) AS cap, {case('domain', 5)} AS w, CAST(floor((SELECT sum(tokens) FROM leaves) * CAST({share} AS DOUBLE)) AS DOUBLE) AS given FROM leaves GROUP BY domain", 'top', 'domain')},
{fill('langs', f"SELECT domain, lang, cap, {case('lang', 5)} AS w, budget AS given FROM (SELECT domain, lang, CAST(sum(tokens) * {max_epochs} AS DOUBLE) AS cap FROM leaves GROUP BY ALL) JOIN (SELECT domain, budget FROM domains) USING (domain)", 'domain', 'lang')},
{fill('sources', f"SELECT domain, lang, source, tokens, CAST(tokens * {max_epochs} AS DOUBLE) AS cap, {case('source', 1)} AS w, budget AS given FROM leaves JOIN (SELECT domain, lang, budget FROM langs) USING (domain, lang)", 'domain, lang', 'source')},
epochs AS (SELECT r.*, e.epoch, CAST(round(s.budget) AS BIGINT) - (e.epoch - 1) * s.tokens AS rest, md5('{seed}:' || e.epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null' || own)) AS place
  FROM rows1 r JOIN sources s USING (domain, lang, source), (SELECT unnest(range(1, {max_epochs + 1})) AS epoch) e),
run AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY place, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far,
  sum(tokens) OVER (PARTITION BY domain, lang, source, epoch, substr(place, 1, {SLICE})) AS in_slice,
  coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY substr(place, 1, {SLICE}) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS slice_before FROM epochs)
SELECT doc_id, CAST(epoch AS BIGINT) AS epoch, domain, lang, source, tokens FROM run
WHERE rest > slice_before AND (rest - slice_before >= in_slice OR so_far < rest)"""
