"""Removal of repeated passages by prefix-partitioned suffix trees.

A passage is a window of `window` consecutive words, so only suffixes that agree on `window` words matter. Suffixes are
split into groups by prefixes of variable length, and each group that fits into memory becomes a suffix tree:

* The suffixes filed first are those that start at the least run of `gram` words (by hash, of equal ones the first) of
  some window, and that run is their shortest prefix. Every window has one such suffix, equal windows have equal ones
  at the same place, and neighbouring windows mostly share theirs, so what is filed under a prefix is a segment: the
  words of all neighbouring windows with that suffix. A text is sent about `window / gram` times in part, where filing
  every suffix by itself would send it `window` times. Prefixes that occur once in the corpus are dropped before that.
* A prefix with more than `memory` distinct segments is too long a list for one group. The suffixes that start at each
  of its windows are then filed by their own first words, by prefixes of `lengths` words, each longer than the one
  before, until a group fits; suffixes alone with their prefix are dropped on the way. A prefix of `window` words needs
  no tree: it is a deep node itself.

A group's tree is kept as its suffix array with the lengths of the common prefixes of neighbours: the intervals of that
array are the tree's internal nodes, their common length is the node's depth. The deepest internal node above a suffix
tells how long it repeats; where that is `window` words or more and the suffix one word before doesn't repeat one word
further in the same way, a maximal repeat begins. Every occurrence of it is written out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, stored, whole_text, with_arrow_columns

ODD = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 20


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64, and of its inverse."""
    base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(BLOCK, x, np.uint64))]) for x in (np.uint64(base), np.uint64(inverse)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: sums of bytes times powers, for all words of a block at once."""
    up, down = powers()
    out, at = [], 0
    while at < len(words):
        end, size = at, 0
        while end < len(words) and (size + len(words[end]) < BLOCK or end == at):
            size += len(words[end])
            end += 1
        if size >= BLOCK:  # one word longer than a block
            out.append(np.frombuffer(hashlib.sha256(words[at]).digest()[:8], "<u8"))
        else:
            data = np.frombuffer(b"".join(words[at:end]), np.uint8)
            ends = np.cumsum(np.fromiter(map(len, words[at:end]), np.int64, end - at))
            starts = np.concatenate([[0], ends[:-1]])
            sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)])])
            out.append(mixed((sums[ends] - sums[starts]) * up[starts]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def runs(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each chosen run of a text: its hash, and the first and last window that choose it."""
    n = len(words) - window + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = word_hashes(words)
    g = np.zeros(len(words) - gram + 1, np.uint64)
    for j in range(gram):
        g = g * ODD + h[j : j + len(g)]
    g = mixed(g)
    wide, span = window - gram + 1, 1
    best = np.arange(len(g))
    while span < wide:
        step = min(span, wide - span)
        left, right = best[:-step], best[step:]
        best = np.where(g[left] <= g[right], left, right)
        span += step
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return g[best[first]], first, last


def distinct_texts(docs: DataFrame) -> DataFrame:
    """id, key, copies, text of each distinct text; null counts as empty."""
    texts = docs.select(whole_text().alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))
    return texts.groupBy("key").agg(F.count("*").alias("copies"), F.first("text").alias("text")).withColumn("id", F.monotonically_increasing_id())


def run_hashes(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """id, at, run: every chosen run of every text, numbered within the text."""
    small_batches(texts.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ats, found = [], [], []
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                g = runs(text.encode().split(), window, gram)[0]
                ids.append(np.full(len(g), i))
                ats.append(np.arange(len(g), dtype=np.int32))
                found.append(g.view(np.int64))
            cat = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
            yield pa.RecordBatch.from_arrays([cat(ids, pa.int64()), cat(ats, pa.int32()), cat(found, pa.int64())], names=["id", "at", "run"])

    return texts.select("id", "text").mapInArrow(each, "id long, at int, run long")


def segments(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """id, start, run, words of the part of a text whose windows choose a run; texts has ats, the runs that repeat."""
    small_batches(texts.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text, ats in zip(*(b.column(c).to_pylist() for c in ("id", "text", "ats"))):
                words = text.encode().split()
                g, first, last = runs(words, window, gram)
                g = g.view(np.int64)
                rows += [(i, int(first[a]), int(g[a]), b" ".join(words[first[a] : last[a] + window])) for a in ats]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], names=["id", "start", "run", "words"])

    return texts.mapInArrow(each, "id long, start int, run long, words binary")


class SuffixTree:
    """The generalised suffix tree of some parts (lists of words): suffix array, common lengths of neighbours."""

    def __init__(self, parts: list[list[bytes]], depth: int):
        """Suffixes are told apart by their first words up to at least `depth`; each part ends with a sign of its own."""
        ids: dict[bytes, int] = {}
        sizes = np.array([len(p) + 1 for p in parts])
        self.starts = np.cumsum(sizes) - sizes
        self.n = n = int(sizes.sum())
        self.part = np.repeat(np.arange(len(parts)), sizes)
        level = np.empty(n, np.int64)
        ends = np.zeros(n, bool)
        ends[self.starts + sizes - 1] = True
        level[~ends] = np.fromiter((ids.setdefault(w, len(ids)) for p in parts for w in p), np.int64, n - len(parts))
        level[ends] = len(ids) + np.arange(len(parts))
        names, span = [(1, level)], 1
        while span < depth:  # names of 2, 4, ... words from two names of half the words
            after = np.zeros(n, np.int64)
            after[:-span] = level[span:] + 1
            level = np.unique(level * (int(after.max()) + 1) + after, return_inverse=True)[1]
            span *= 2
            names.append((span, level))
        self.order = np.argsort(level, kind="stable")
        one, two = self.order[:-1].copy(), self.order[1:].copy()
        common = np.zeros(n + 1, np.int64)  # of a suffix in order and the one before it
        for span, level in reversed(names):  # longest names first, each once, as a length is a sum of powers of two
            inside = (one < n) & (two < n)
            same = inside & (level[np.minimum(one, n - 1)] == level[np.minimum(two, n - 1)])
            common[1:n][same] += span
            one[same] += span
            two[same] += span
        self.common = common

    def repeats(self, least: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, start, words) of every occurrence of a maximal repeat of `least` words or more.

        A part with a count of two or more stands for several equal ones, so it repeats as a whole.
        """
        deep = np.zeros(self.n + 1, np.int64)  # one more place, for the suffix before the first
        deep[self.order] = np.maximum(self.common[:-1], self.common[1:])
        whole = np.flatnonzero(counts > 1)
        sizes = np.append(self.starts[1:], self.n) - self.starts - 1
        deep[self.starts[whole]] = sizes[whole]
        at = np.flatnonzero((deep[:-1] >= least) & (deep[np.arange(self.n) - 1] <= deep[:-1]))
        return self.part[at], at - self.starts[self.part[at]], deep[at]


def subtrees(groups: DataFrame, key: str, window: int, most_words: int = 200_000) -> DataFrame:
    """class, from, words: occurrences of maximal repeats in groups of equal `key`, within segments from `shift` on.

    Neighbouring groups are taken into one tree up to most_words; a group is never parted.
    """
    small_batches(groups.sparkSession, 2000)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            part, start, n = (np.empty(0, np.int64),) * 3
            if rows:
                counts = np.array([r[3] for r in rows])
                part, start, n = SuffixTree([r[2].split(b" ") for r in rows], window).repeats(window, counts)
                start = start + np.array([r[4] for r in rows])[part]
            return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i in part.tolist()], pa.binary()), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["class", "from", "words"])

        rows, size = [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in (key, "class", "words", "n", "shift"))):
                if size > most_words and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += row[2].count(b" ") + 1
        yield flush(rows)

    ordered = groups.select(key, "class", "words", "n", "shift").repartition(key).sortWithinPartitions(key)
    return ordered.mapInArrow(each, "class binary, from int, words int")


def by_own_prefix(suffixes: DataFrame, classes: DataFrame, length: int, window: int, first: bool) -> DataFrame:
    """prefix, class, shift, n: suffixes filed under their own first `length` words; `first`: those of all windows."""
    small_batches(classes.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            at = [None] * b.num_rows if first else b.column("shifts").to_pylist()
            for c, data, n, shifts in zip(*(b.column(c).to_pylist() for c in ("class", "words", "n")), at):
                words = data.split(b" ")
                for o in range(len(words) - window + 1) if shifts is None else shifts:
                    rows.append((hashlib.blake2b(b" ".join(words[o : o + length]), digest_size=16).digest(), c, o, n))
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], names=["prefix", "class", "shift", "n"])

    rows = classes.select("class", "words", "n")
    if not first:
        rows = rows.join(suffixes.groupBy("class").agg(F.collect_list("shift").alias("shifts")), "class")
    return rows.mapInArrow(each, "prefix binary, class binary, shift int, n long")


def lengthened(classes: DataFrame, window: int, memory: int, lengths: tuple[int, ...]) -> DataFrame | None:
    """class, from, words as subtrees() gives them, for groups that need longer prefixes; None without any."""
    out, suffixes = None, None
    for length in lengths:
        found = by_own_prefix(suffixes, classes, length, window, suffixes is None)
        found = stored(found, f"passage-prefix-{length}")
        size = found.groupBy("prefix").agg(F.count("*").alias("k"), F.sum("n").alias("n")).where("n > 1")
        if length == window:
            twice = found.join(size.select("prefix"), "prefix", "left_semi")
            part = twice.select("class", F.col("shift").alias("from"), F.lit(window).alias("words"))
        else:
            fits = found.join(size.where(F.col("k") <= memory).select("prefix"), "prefix", "left_semi")
            tails = F.concat_ws(" ", F.slice(F.split(F.col("text"), " ", -1), F.col("shift") + 1, F.lit(window)))
            fits = fits.join(classes.select("class", F.col("words").cast("string").alias("text")), "class").select("prefix", "class", "shift", "n", tails.cast("binary").alias("words"))
            part = subtrees(fits, "prefix", window)
            suffixes = stored(found.join(size.where(F.col("k") > memory).select("prefix"), "prefix", "left_semi"), f"passage-longer-{length}")
        part = stored(part, f"passage-repeats-{length}")
        discard(found)
        out = part if out is None else out.unionByName(part)
        if length == window or suffixes.isEmpty():
            return out
    raise ValueError("the last length must be the window")


def repeated_passages(texts: DataFrame, window: int = 35, gram: int = 8, memory: int = 2000, lengths: tuple[int, ...] | None = None) -> DataFrame:
    """id, starts, sizes: for each text of `texts` (id, text, copies) where its maximal repeats start, and their words.

    A repeat has `window` words or more, and it is cut where a segment ends. Copies of a whole text are not looked for
    here; `texts` has each text once, and copies says how often it stands. A text without repeats has no row.
    """
    lengths = lengths or tuple(n for n in (2 * gram, 3 * gram) if n < window) + (window,)
    chosen = stored(run_hashes(texts, window, gram), "passage-runs")
    # a table of its own, so that the join below has a shuffle on both sides and AQE may split a very frequent run
    several = stored(chosen.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run"), "passage-several")
    ats = chosen.join(several, "run", "left_semi").groupBy("id").agg(F.collect_list("at").alias("ats"))
    parts = segments(texts.select("id", "text").join(ats, "id"), window, gram)
    parts = stored(parts.withColumn("class", F.unhex(F.md5(F.concat(F.col("words"), F.lit(" ").cast("binary"), F.col("run").cast("string").cast("binary"))))), "passage-parts")
    discard(chosen, several)
    classes = stored(parts.groupBy("class", "run").agg(F.first("words").alias("words"), F.count("*").alias("n")).withColumn("shift", F.lit(0)), "passage-classes")
    sizes = classes.groupBy("run").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    frequent = stored(sizes.where(F.col("k") > memory).select("run"), "passage-frequent")
    found = stored(subtrees(classes.join(frequent, "run", "left_anti"), "run", window), "passage-repeats")
    if not frequent.isEmpty():
        found = found.unionByName(lengthened(classes.join(frequent, "run", "left_semi"), window, memory, lengths))
    spans = parts.select("id", "start", "class").join(found, "class").select("id", F.struct((F.col("from") + F.col("start")).alias("at"), F.col("words").alias("n")).alias("span"))
    spans = spans.groupBy("id").agg(F.collect_list("span").alias("spans"))
    return spans.select("id", F.col("spans.at").alias("starts"), F.col("spans.n").alias("sizes"))


def deduplicated(docs: DataFrame, window: int = 35, gram: int = 8, memory: int = 2000, text_out: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, if asked for) of every row of docs.

    A word goes if a window that covers it has a copy that starts anywhere else; windows are judged on the input. Kept
    words are joined by one space. Null and empty texts have no words. Each repeated row counts as one more place, so
    copies of a text of `window` words or more lose everything. Null doc_ids are kept. An empty table gives none.
    Extra columns are not used.
    """
    if gram > window:
        raise ValueError("a run must fit into a window")
    texts = stored(distinct_texts(docs), "passage-texts")
    spans = stored(repeated_passages(texts, window, gram, memory), "passage-windows")
    kept_column = {"kept": "string"} if text_out else {}

    def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        for text, copies, at, size in zip(*(batch.column(c).to_pylist() for c in ("text", "copies", "starts", "sizes"))):
            words = text.encode().split()
            gone = np.zeros(len(words) + 1, np.int32)
            if copies > 1 and len(words) >= window:
                gone[:] = 1
            elif at:
                np.add.at(gone, at, 1)
                np.add.at(gone, np.array(at) + np.array(size), -1)
                gone = np.cumsum(gone)
            kept = b" ".join(w for w, g in zip(words, gone.tolist()) if g <= 0) if gone.any() else b" ".join(words)
            for k, v in zip(out, (len(words), int((gone[: len(words)] > 0).sum()), hashlib.sha256(kept).hexdigest(), kept.decode())):
                out[k].append(v)
        kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
        return {k: pa.array(out[k], kinds[k]) for k in ("n_words", "n_removed", "kept_sha256", *kept_column)}

    judged = with_arrow_columns(texts.join(spans, "id", "left"), each, {"n_words": "long", "n_removed": "long", "kept_sha256": "string"} | kept_column)
    judged = judged.select("key", "n_words", "n_removed", "kept_sha256", *kept_column)
    keys = docs.select("doc_id", F.unhex(F.sha2(whole_text(), 256)).alias("key"))
    return keys.join(judged, "key").drop("key")
