"""Spelling variants of a vocabulary, joined by a variable-length gram index.

A dictionary of frequent grams decides how far a gram is extended: from each place of a word, its gram is the shortest
run of at least `least` characters that isn't frequent, up to `longest`; grams inside an earlier one are left out. So
the lists of the index stay short where short grams are rare, and common beginnings get longer grams.

Whether a gram that ends before character e is in the decomposition depends on characters e-longest to e-1 alone: a match
that started earlier and held it would have to reach its end. One edit therefore affects only grams with the edit in
that span, and of two grams whose ends lie `longest` apart an edit leaves one as it is, with its distance from the word's
start or from its end. Each word looks up the cheapest such pair of lists; what it finds there is verified.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, stored

#: Runs of letters in Latin-1 bytes, of which only A-Z are lower-cased; any other character counts as a separator.
RUN = re.compile(b"[a-z\xc0-\xff]+")
START, END = "\x02", "\x03"


def utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def variants(texts: DataFrame, one_in: int = 97, most: int = 300_000) -> DataFrame:
    """word, n: how often each run of letters occurs in texts (doc_id, text), a seeded share of them misspelt.

    Counts are summed inside a task, for at most `most` words at a time, and then over all tasks.
    """
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(w.decode("latin-1"), n) for w, n in found.items() if n and w]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                runs = RUN.findall((text or "").encode("latin-1", "replace").lower())
                seed = zlib.crc32(b"" if doc is None else b"%d" % doc)
                seed = zlib.crc32(b":", seed)
                found.update(runs)
                struck = [w for w in set(runs) if not zlib.crc32(utf8(w), seed) % one_in]
                if struck:
                    here = Counter(runs)
                    for w in struck:  # the same run of a document is always misspelt alike
                        at = zlib.crc32(utf8(w), seed) % len(w)
                        found[w] -= here[w]
                        found[w[:at] + w[at + 1 :]] += here[w]
                if len(found) > most:
                    yield flush()
        yield flush()

    return texts.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Grams:
    """Decomposes words by a dictionary: the number of words' places for each frequent gram.

    Words stand between `longest` - 2 marks on either side, so that a word of 5 letters has grams far enough apart.
    Only grams whose start is within `reach` characters of an end of the marked word take part, which bounds
    what a very long word costs.
    """

    def __init__(self, frequent: dict[str, int], least: int, longest: int, reach: int = 24):
        self.frequent, self.least, self.longest, self.reach = frequent, least, longest, max(reach, 2 * longest)
        self.marks = longest - 2

    def marked(self, word: str) -> str:
        return START * self.marks + word + END * self.marks

    def match(self, s: str, at: int) -> int:
        """Where the gram that starts at `at` ends."""
        end, stop = at + self.least, min(len(s), at + self.longest)
        while end < stop and s[at:end] in self.frequent:
            end += 1
        return end

    def decompose(self, s: str) -> list[tuple[int, int]]:
        """(start, end) of the grams of a marked word."""
        m, grams = len(s), []
        head, tail = min(m, self.reach), max(0, m - self.reach)
        far, at = 0, 0
        while at <= m - self.least:
            if head <= at < tail - self.longest:  # the middle of a very long word; what follows settles before the tail
                at, far = tail - self.longest, 0
            end = self.match(s, at)
            if end > far:
                far = end
                if at < head or at >= tail:
                    grams.append((at, end))
            at += 1
        return grams

    def cost(self, gram: str) -> int:
        return self.frequent.get(gram, 0)

    def lookups(self, s: str, grams: list[tuple[int, int]]) -> tuple[tuple[int, int], tuple[int, int]] | None:
        """The cheapest two grams with ends `longest` apart, the first near the start; None for words of under 5 letters.

        The first stays as it is, at its distance from the start, under every edit at or behind its end; the second
        under all others, at its distance from the end.
        """
        best, left, seen = None, None, 0
        firsts = [(e, self.cost(s[a:e]), a) for a, e in grams if a < self.reach]
        for a, e in grams:
            if a < len(s) - self.reach:
                continue
            while seen < len(firsts) and firsts[seen][0] <= e - self.longest:
                if left is None or firsts[seen][1] <= left[1]:
                    left = firsts[seen]
                seen += 1
            if left is not None:
                cost = left[1] + self.cost(s[a:e])
                if best is None or cost < best[0]:
                    best = cost, (left[2], left[0]), (a, e)
        return best and best[1:]


def frequent_grams(words: DataFrame, least: int, longest: int, most: int) -> dict[str, int]:
    """Grams of marked words that are too frequent to stay as they are: more than a `most`th of all places, and over 32.

    At most `most` of them for each length, whatever the vocabulary: they go to the driver and to all tasks.
    """
    marks = longest - 2
    s = F.concat(F.lit(START * marks), F.col("word"), F.lit(END * marks))
    at = F.explode(F.sequence(F.lit(1), F.length("s") - least + 1)).alias("at")
    places = words.select(s.alias("s")).select("s", at)
    total = words.agg(F.sum(F.length("word") + 2 * marks)).first()[0] or 0
    limit = max(32, -(-total // most))
    gram = F.explode(F.array(*[F.when(F.col("at") + n - 1 <= F.length("s"), F.substring("s", F.col("at"), F.lit(n))) for n in range(least, longest + 1)])).alias("gram")
    found = places.select(gram).where("gram is not null").groupBy("gram").count().where(F.col("count") > limit)
    return {r["gram"]: r["count"] for r in found.collect()}


@functools.cache
def bit_of() -> list[int]:
    return [1 << (c * 37 % 63) for c in range(256)]


def letters(word: str) -> int:
    """Letters of a word as bits: one edit changes two at most."""
    bits, out = bit_of(), 0
    for c in set(word):
        out |= bits[ord(c) & 255]
    return out


def near_pairs(words: DataFrame, least: int = 3, longest: int = 6, most: int = 50_000) -> DataFrame:
    """a, n_a, b, n_b: every two of words (word, n; distinct, 5 letters or more) that one edit parts, each pair once.

    The shorter word looks the longer one up, of two equally long words each the other. A pair belongs to the first
    lookup if the words agree up to that gram's end, else to the second, so no pair comes twice.
    """
    spark = words.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_grams(words, least, longest, most))
    small_batches(spark, 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(frequent.value, least, longest)
        for b in batches:
            cols: list[list] = [[], [], [], [], [], [], [], []]
            for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
                s = grams.marked(word)
                m, bits, found = len(s), letters(word), grams.decompose(s)
                rows = [(s[a:e], a, m - e, None, None) for a, e in found]
                (a, e), (c, d) = grams.lookups(s, found)
                agree = max(0, e - grams.marks)
                rows += [(s[a:e], a, m - e + k, True, agree) for k in (0, 1)]
                rows += [(s[c:d], c + k, m - d, False, agree) for k in (0, 1)]
                for gram, before, after, first, upto in rows:
                    for col, v in zip(cols, (gram, before, after, first, upto, word, n, bits)):
                        col.append(v)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["gram", "before", "after", "first", "upto", "word", "n", "bits"])

    kind = "gram string, before int, after int, first boolean, upto int, word string, n long, bits long"
    rows = words.select("word", "n").mapInArrow(run, kind)
    rows = stored(rows.withColumn("key", F.xxhash64("gram", "before", "after")).drop("gram", "before", "after"), "spelling-grams")
    held = rows.where("first is null").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    asked = rows.where("first is not null").select("key", "first", "upto", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    longer = F.length("b") - F.length("a")
    fits = (longer == 1) | ((longer == 0) & (F.col("a") < F.col("b")))
    close = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= 2
    begins = F.expr("substring(a, 1, upto) = substring(b, 1, upto)") == F.col("first")
    found = asked.join(held, "key").where(fits & close & begins & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "n_a", "b", "n_b")


def forms(words: DataFrame, pairs: DataFrame, times: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n of every word: its near word of largest n, if that is `times` the word's n or more."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("k")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("k")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("k")).alias("k"), "near")).alias("best"))
    known = -F.col("best.k") >= times * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(known, F.col("best.near")).alias("form"), F.when(known, -F.col("best.k")).alias("form_n"),
    )


def roots(links: DataFrame) -> DataFrame:
    """word, root for every row of links (word, form): the last word that forms lead to.

    Each round doubles the steps taken. A form occurs twice as often as its word, so chains are short and end.
    """
    now = stored(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = after.where("moved").limit(1).count()
        discard(now)
        now = after.select("word", "root")
        now._strandline_path = after._strandline_path
        if not moved:
            return now


def vocabulary(docs: DataFrame, shortest: int = 5, times: int = 3) -> DataFrame:
    return variants(docs).where((F.length("word") >= shortest) & (F.col("n") >= times))


def query(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least 5 letters that occurs 3 times or more.

    A null text has no words; a row without doc_id is seeded with an empty id. Repeated rows count each. An empty table
    gives no word. Extra columns are not used. Very long texts are read whole; very long words take part by the
    grams near their ends, which decide as much, and are compared whole.
    """
    words = stored(vocabulary(docs), "spelling-words")
    found = stored(forms(words, near_pairs(words)), "spelling-forms")
    root = roots(found.where("form is not null"))
    return found.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql(one_in: int = 97, shortest: int = 5, times: int = 3) -> str:
    """DuckDB SQL for query(): crc32 by a table of 256 remainders, near words by what is left when a letter is struck."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
    WITH RECURSIVE crc AS (
        SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS rest
    ), runs AS (
        SELECT doc_id, translate(run, '{upper}', '{upper.lower()}') AS run, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL
    ), coded AS (
        SELECT run, n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
            lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END)) AS bytes FROM runs
    ), hashed AS (
        SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes::BIGINT[]), lambda c, b: xor(c >> 8, rest[(xor(c, b) & 255) + 1]))) AS h FROM coded, crc
    ), words AS (
        SELECT word, sum(n)::BIGINT AS n FROM (
            SELECT CASE WHEN h % {one_in} = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed)
        WHERE length(word) >= {shortest} GROUP BY word HAVING sum(n) >= {times}
    ), struck AS (
        SELECT word, n, place, substring(word, 1, place - 1) || substring(word, place + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words)
    ), pairs AS (
        SELECT a.word, b.word AS near, b.n AS k FROM struck a JOIN struck b USING (rest, place) WHERE a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM struck a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM struck a JOIN words b ON a.rest = b.word
    ), best AS (
        SELECT word, count(*) AS n_near, arg_min(near, (-k, near)) AS near, max(k) AS k FROM pairs GROUP BY word
    ), formed AS (
        SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN k >= 2 * n THEN near END AS form, CASE WHEN k >= 2 * n THEN k END AS form_n FROM words LEFT JOIN best USING (word)
    ), walk AS (
        SELECT word, word AS root FROM formed
        UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NOT NULL
    ), ends AS (
        SELECT walk.word, walk.root FROM walk JOIN formed ON walk.root = formed.word WHERE formed.form IS NULL
    )
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
    """
