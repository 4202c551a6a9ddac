"""How far each source's words are from those of its language and of the language's other sources, exactly, in whole numbers.

Terms whose counts are equal weigh the same, so a group's terms are put into cells by (count in the group, count in the
language). The measure is evaluated once for each cell, cells of equal value are merged and ranked by the number of
terms ahead of them, and only the terms of cells within the wanted ranks are looked up and ordered.

Between two sources, terms that neither holds weigh alike, and terms that only one holds weigh by its count alone: these
parts come from the sources' cells. Terms that both hold add what they differ by from that.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Letters of ASCII and every byte of other characters, in UTF-8 of which only A-Z are lower-cased.
TERM = re.compile(b"[a-z\x80-\xff]+")
SCALE = 1_000_000_000


def term_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """lang, source, term, n, d: occurrences of each term in a group, and how many of its documents have it.

    Each task sums up to `most` entries before it hands them on. Null lang, source and text are empty strings.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in found.items():
                terms = pa.array([t.decode() for t in n], pa.string())
                cols = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), terms, pa.array(n.values(), pa.int64()), pa.array([d[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "d"])
            found.clear()

        for b in batches:
            for text, *group in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "source"))):
                terms = TERM.findall((text or "").encode().lower())
                n, d = found[tuple(g or "" for g in group)]
                held -= len(n)
                n.update(terms)
                d.update(set(terms))
                held += len(n)
                if held > most:
                    yield from flush()
                    held = 0
        yield from flush()

    rows = docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, d long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)); the product may outgrow 64 bits. Null without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    product = F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1)
    return F.when(terms > 0, F.call_function("div", product, wide(total + terms)) + 1)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so 64 bits do."""
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """lang, term, total, by: terms of at least `least` documents of a language, with their counts by source."""
    rows = term_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("d"), F.collect_list(F.struct("source", F.col("n").alias("c"))).alias("by"))
    return stored(rows.where(F.col("d") >= least).drop("d"), "divergence-terms")


def groups_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, n, v, total, none: a row for each group of docs: its occurrences of kept terms, how many terms its
    language keeps, their occurrences there, and the share of a term that the group doesn't have."""
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("total"))
    own = terms.select("lang", F.explode("by").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.c").alias("n"))
    named = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    found = named.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("n"), zero("v"), zero("total"))
    return stored(found.withColumn("none", share(F.lit(0), F.col("n"), F.col("v"))), "divergence-groups")


def top_terms(held: DataFrame, most: int) -> DataFrame:
    """lang, source, item, value, rank of the first `most` terms of each group. held: lang, source, term, p, q, c, total."""
    above = held.where("p > q")
    value = gap(F.col("p"), F.col("q")).alias("value")
    cells = above.groupBy("lang", "source", "c", "total").agg(F.count("*").alias("m"), F.first("p").alias("p"), F.first("q").alias("q"))
    merged = cells.groupBy("lang", "source", value).agg(F.sum("m").alias("m"))
    # each value has a term at least, so values beyond the first `most` are out of reach
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"))
    best = merged.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    best = best.withColumn("ahead", F.sum("m").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("m")).where(F.col("ahead") < most)
    best = stored(best.select("lang", "source", "value", "ahead"), "divergence-values")
    found = above.select("lang", "source", F.col("term").alias("item"), value).join(best, ["lang", "source", "value"])
    within = F.row_number().over(W.partitionBy("lang", "source", "value").orderBy("item"))
    found = found.withColumn("within", within).where(F.col("within") <= most)
    return found.withColumn("rank", (F.col("ahead") + F.col("within")).cast("int")).where(F.col("rank") <= most).select("lang", "source", "item", "value", "rank")


def source_pairs(terms: DataFrame, held: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: every other source of a group's language by its distance."""
    x, y = (groups.select("lang", F.col("source").alias(s), F.col("none").alias(f"{s}_none"), "v") for s in ("source", "item"))
    base = x.join(y.drop("v"), "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("v") * gap(F.col("source_none"), F.col("item_none")), F.lit(0)).alias("value"))
    # terms that one of the two holds, by its cells
    cells = held.groupBy("lang", "source", "c").agg(F.count("*").alias("m"), F.first("p").alias("p"), F.first("none").alias("none"))
    cells = cells.join(groups.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none")), "lang").where("source <> other")
    p, none, other = F.col("p"), F.col("none"), F.col("other_none")
    ways = F.array(
        F.struct(F.col("source").alias("source"), F.col("other").alias("item"), (F.col("m") * (gap(p, other) - gap(none, other))).alias("value")),
        F.struct(F.col("other").alias("source"), F.col("source").alias("item"), (F.col("m") * (gap(other, p) - gap(other, none))).alias("value")),
    )
    one = cells.select("lang", F.explode(ways).alias("w")).select("lang", "w.*")
    # terms that both hold: no more rows than sources twice over for a term, summed in the task
    both = terms.where(F.size("by") > 1).select("lang", "by", F.explode("by").alias("a")).select("lang", "a", F.explode(F.filter("by", lambda b: b["source"] > F.col("a")["source"])).alias("b"))

    def more(u: str, w: str) -> Column:
        pu, pw, nu, nw = F.col(f"{u}.p"), F.col(f"{w}.p"), F.col(f"{u}.none"), F.col(f"{w}.none")
        return F.sum(gap(pu, pw) - gap(pu, nw) - gap(nu, pw) + gap(nu, nw))

    both = both.groupBy("lang", F.col("a.source").alias("a"), F.col("b.source").alias("b")).agg(more("a", "b").alias("ab"), more("b", "a").alias("ba"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value")))
    both = both.select("lang", F.explode(ways).alias("w")).select("lang", "w.*")
    found = base.unionByName(one).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return found.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: distances of every group from the other sources of its language (part pair)
    and the terms that set it most apart from its language (part term, `most` of them).

    Null lang, source and text are empty strings; repeated rows and ids count as documents each. A group without kept
    terms has shares of zero counts; a language without kept terms gives distances of 0. An empty table gives no row.
    Extra columns are not used. Very long texts are read whole, terms of any length too.
    """
    terms = kept_terms(docs, least)
    groups = groups_of(docs, terms)
    rows = terms.select("lang", "term", "total", F.explode("by").alias("x")).select("lang", "term", "total", "x.source", "x.c")
    rows = rows.join(groups.withColumnRenamed("total", "lang_n"), ["lang", "source"])
    p, q = share(F.col("c"), F.col("n"), F.col("v")), share(F.col("total"), F.col("lang_n"), F.col("v"))
    held = rows.select("lang", "source", "term", "c", "total", "none", p.alias("p"), q.alias("q"))
    by = held.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "none")).alias("by"))
    pairs = source_pairs(by, held, groups).withColumn("part", F.lit("pair"))
    found = pairs.unionByName(top_terms(held, most).withColumn("part", F.lit("term")))
    return found.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


def sql(least: int = 3, most: int = 200) -> str:
    """DuckDB SQL for audit(), term by term in 128-bit numbers, without cells."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
    WITH docs AS (
        SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
    ), found AS (
        SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{upper}', '{upper.lower()}') AS term FROM docs
    ), kept AS (
        SELECT lang, term, count(*)::HUGEINT AS total FROM found GROUP BY ALL HAVING count(DISTINCT id) >= {least}
    ), langs AS (
        SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang
    ), groups AS (
        SELECT DISTINCT lang, source FROM docs
    ), counts AS (
        SELECT lang, source, term, count(*)::HUGEINT AS c FROM found JOIN kept USING (lang, term) GROUP BY ALL
    ), sizes AS (
        SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL
    ), shares AS (
        SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c, 1 + ({SCALE}::HUGEINT * (coalesce(c.c, 0) + 1)) // (s.n + l.v) AS p, 1 + ({SCALE}::HUGEINT * (k.total + 1)) // (l.n + l.v) AS q
        FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
    ), sums AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    ), every AS (
        FROM pairs UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE c > 0 AND p > q
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM every
    )
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {most}
    """
