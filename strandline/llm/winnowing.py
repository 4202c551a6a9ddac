"""Document fingerprints by winnowing, in DataFrame functions only.

A text's words are hashed; every run of `gram` words has the polynomial hash that rolling from run to run gives (array
functions keep no state between elements, so each is summed up in place), and from each window of `window` such hashes the smallest is chosen, of equal ones the rightmost. Chosen hashes keep their positions (the first word
of their run), so any passage of window + gram - 1 words that two texts share is sure to give both a common hash.
"""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from .common import whole_text

#: The hash is a polynomial over word hashes in base BASE, modulo a prime below 2 ** 31, so that products fit a long.
PRIME, BASE = 2147483647, 1000003
#: A place within 2 ** PLACE_BITS stands below the hash while the smallest is sought, reversed so that the right one wins.
PLACE_BITS = 32


def words(text: Column) -> Column:
    """Lower-case words; white space of any of the six ASCII kinds parts them."""
    return F.filter(F.split(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")


def with_fingerprints(df: DataFrame, texts: dict[str, str], gram: int = 5, window: int = 8) -> DataFrame:
    """df with an array of (hash, position) for each text column; texts maps an output name to a text column.

    Each step is a column of its own that the next uses more than once, so Spark keeps it and doesn't inline it
    into the loops over its elements. A text of fewer words than a run is one run; a null or wordless text has an
    empty array. Repeated texts have equal fingerprints. A column named like an output is replaced.
    """
    powers = [pow(BASE, gram - 1 - j, PRIME) for j in range(gram)]
    for out, text in texts.items():
        df = df.withColumn("_w", words(whole_text(text)))
        df = df.withColumn("_h", F.transform("_w", lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME))))

        def run(x: Column, i: Column) -> Column:
            total = (x * powers[0]) % PRIME
            for j in range(1, gram):
                total = total + (F.coalesce(F.get("_h", i + j), F.lit(0)) * powers[j]) % PRIME
            return (total % PRIME) * (1 << PLACE_BITS) + ((1 << PLACE_BITS) - 1 - i)

        runs = F.greatest(F.size("_h") - (gram - 1), F.least(F.size("_h"), F.lit(1)))
        df = df.withColumn("_g", F.slice(F.transform("_h", run), F.lit(1), runs))
        # Minima of windows by doubling: of 2, 4, ... elements, then two overlapping ones make up the window.
        span = 1
        while span * 2 <= window:
            df = df.withColumn("_m", halves("_g" if span == 1 else "_m", span))
            span *= 2
        if span < window:
            df = df.withColumn("_m", halves("_m", window - span))
        ends = F.greatest(F.size("_g") - (window - 1), F.least(F.size("_g"), F.lit(1)))
        chosen = F.array_distinct(F.slice(F.col("_m") if window > 1 else F.col("_g"), F.lit(1), ends))
        df = df.withColumn(out, F.transform(chosen, lambda v: F.struct(F.shiftright(v, PLACE_BITS).alias("hash"), ((1 << PLACE_BITS) - 1 - v.bitwiseAND((1 << PLACE_BITS) - 1)).alias("position"))))
    return df.drop("_w", "_h", "_g", "_m")


def halves(name: str, step: int) -> Column:
    return F.transform(F.col(name), lambda x, i: F.least(x, F.coalesce(F.get(F.col(name), i + step), x)))


def shown(fingerprint: Column) -> Column:
    """position:hash in hexadecimal, in the order of the text."""
    return F.array_join(F.transform(fingerprint, lambda f: F.concat(F.hex(f["position"]), F.lit(":"), F.hex(f["hash"]))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints; 1 for two empty ones."""
    x, y = F.transform(a, lambda f: f["hash"]), F.transform(b, lambda f: f["hash"])
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(union, F.lit(1)))


def longs(values: list[int]) -> Column:
    """An array literal that stays short in a plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_bucket(key: str, bounds: list[int]) -> Column:
    """How many bounds are at or below the key: found in two steps over about the square root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda found: F.size(F.filter(found, lambda b: b <= F.col(key)))
    row = below(longs(bounds[::step]))
    inside = below(F.slice(longs(bounds), F.greatest(row - 1, F.lit(0)) * step + 1, F.lit(step)))
    return F.when(row == 0, 0).otherwise((row - 1) * step + inside)


def with_next(docs: DataFrame, rows_a_bucket: int = 400, most: int = 65_536) -> tuple[DataFrame, WindowSpec]:
    """Rows (doc_id, text, next_text, _guest, ...) and the window that they stand in; next_text is the text of the next
    document in descending doc_id order, the first after the last. Rows with _guest are none of docs.

    Documents are dealt into ranges of doc_id with about equal numbers of rows; the first document of the range
    below is sent along as a guest, so each range is complete by itself and the texts are shuffled once. Rows with equal
    doc_id stand in descending order of a hash of their text; rows without doc_id come last. A doc_id, or none, that over
    a thousandth of the rows bear is parted by ranges of that hash, so only equal rows must stay together. Null texts
    become empty. An empty table gives none.
    """
    none = F.lit(-(1 << 63))
    docs = docs.select("doc_id", whole_text().alias("text"), F.coalesce(F.col("doc_id"), none).alias("_id")).withColumn("_hash", F.xxhash64("text"))
    ids = docs.select("_id", "_hash")
    n = ids.count()
    parts = min(most, max(1, n // rows_a_bucket))
    cuts = ids.approxQuantile("_id", [i / parts for i in range(1, parts)], 1 / (8 * parts)) if parts > 1 else []
    hot = {r["_id"]: r["count"] for r in ids.groupBy("_id").count().where(F.col("count") > max(8 * rows_a_bucket, n // 1000)).collect()}  # under 1000
    bounds = sorted({int(c) for c in cuts} | {b for h in hot for b in (h, h + 1)})
    shares = [1] * (len(bounds) + 1)
    for h, rows in hot.items():
        shares[bisect.bisect_right(bounds, h)] = min(4096, -(-rows // rows_a_bucket))
    firsts = list(itertools.accumulate(shares, initial=0))
    inside = F.floor((F.col("_hash").cast("double") / 2.0**64 + 0.5) * F.get(longs(shares), F.col("_range"))).cast("int")
    inside = F.least(inside, F.get(longs(shares), F.col("_range")).cast("int") - 1)

    def bucketed(df: DataFrame) -> DataFrame:
        df = df.withColumn("_range", (range_bucket("_id", bounds) if bounds else F.lit(0)).cast("int"))
        return df.withColumn("_bucket", (F.get(longs(firsts), F.col("_range")) + inside).cast("int")).drop("_range")

    tops = bucketed(ids).groupBy("_bucket").agg(F.max(F.struct("_id", "_hash")).alias("top")).orderBy("_bucket").collect()  # at most one row a bucket
    docs = bucketed(docs)
    guests = docs.where(F.lit(False)).withColumn("_guest", F.lit(True))
    if tops:
        # The first document of a range also ends the range above, and that of the highest the lowest.
        used = [r["_bucket"] for r in tops]
        top = dict(zip(used, (r["top"] for r in tops)))
        above = dict(zip(used, [*used[1:], used[0]]))
        every = range(used[-1] + 1)
        at = lambda values: F.get(longs(values), F.col("_bucket"))
        first = docs.where((at([top[b][0] if b in top else -1 for b in every]) == F.col("_id")) & (at([top[b][1] if b in top else 0 for b in every]) == F.col("_hash")))
        first = first.groupBy("_bucket", "_id", "_hash").agg(F.min("text").alias("text"))
        guests = first.select(F.lit(None).cast("long").alias("doc_id"), "text", "_id", "_hash", at([above.get(b, -1) for b in every]).cast("int").alias("_bucket"), F.lit(True).alias("_guest"))
    order = W.partitionBy("_bucket").orderBy("_guest", F.desc("_id"), F.desc("_hash"), "text")
    both = docs.withColumn("_guest", F.lit(False)).unionByName(guests)
    return both.withColumn("next_text", F.lead("text").over(order)), order


def query(docs: DataFrame, gram: int = 5, window: int = 8) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is the start of the next document.

    A text is fingerprinted once for itself; the next document's fingerprint is taken over from its row. Null texts count
    as empty, and two empty fingerprints are alike (1). Each row gets a row; null and repeated doc_ids are ordered as
    with_next() says, and a single row is its own next. An empty table gives none. Extra columns are not used.
    """
    rows, order = with_next(docs)
    rows = with_fingerprints(rows, {"own": "text"}, gram, window)
    rows = rows.withColumn("following", F.lead("own").over(order)).where("not _guest")
    edited = F.concat(F.expr("substring(text, 1, length(text) - int(length(text) div 2))"), F.expr("substring(next_text, 1, int(length(text) div 2))"))
    rows = with_fingerprints(rows.withColumn("edited", edited), {"other": "edited"}, gram, window)
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("own")).alias("fingerprint"), shown(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
