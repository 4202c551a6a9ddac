"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints at Hamming distance `radius` or less are linked, and linked documents form a component. Distinct
fingerprints only are searched; copies share one. An index holds some thousands of fingerprints, sorted by Gray rank.
Groups of neighbours in that order, groups of groups and so on up to one root make a tree; a node keeps the bits that
all below it share, less those that the nodes above it hold already. The index is joined with itself from the root
down: the differences of two groups in the bits that both share add up level by level, and a pair of groups is pruned
as soon as the sum exceeds the radius. Only what is left of the leaves is compared one by one.

For many fingerprints there are many such indexes. By the pigeonhole principle two linked fingerprints agree on one
of radius + 1 disjoint sets of bits, so a fingerprint goes into one index for each set, by its value there; the sets
are as small as they can be for indexes of about `size` fingerprints. An index that turns out larger than `most` is
dealt out again by further bits in the same way, which loses no link. Links leave an index as a spanning forest, never
as all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import likeness
from .common import columns_of, stored, unused, with_arrow_columns
from .graph import components

BITS = 64
#: Fingerprints of a leaf, and nodes below a node.
LEAF, FANOUT = 16, 8


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit b is set if it is in over half the XXH64 values (seed 42) of the shingles; without words it is zero."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    values = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = values[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """docs with the fingerprint of each whole text as a signed 64-bit integer; null and wordless texts have zero."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        values = np.array([fingerprint(t, shingle) for t in batch.column(text).to_pylist()], np.uint64)
        return {out: pa.array(values.view(np.int64))}

    return with_arrow_columns(docs, run, {out: "long"})


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the Gray code, where neighbours differ in one bit."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """A tree over Gray-sorted fingerprints. Levels stand from the leaves up to the root; `pairs` and `pruned` count
    pairs of leaves that a search could have visited, and those that it didn't."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(gray_rank(values), kind="stable")
        self.values = values[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # shared bits' mask and values of each node
        one = both = self.values
        step = LEAF
        while not self.levels or len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(one), step)
            one, both, step = np.bitwise_or.reduceat(one, at), np.bitwise_and.reduceat(both, at), FANOUT
            self.levels.append((~(one ^ both), both))
        self.pairs = self.pruned = 0

    def leaf_pairs(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (a <= b) of leaves that are not pruned."""
        a = b = far = np.zeros(1, np.int64)
        done = np.zeros(1, np.uint64)  # bits that the differences so far cover
        grid = np.arange(FANOUT)
        for depth in range(len(self.levels) - 1, -1, -1):
            mask, bits = self.levels[depth]
            if depth < len(self.levels) - 1:
                a, b = (a[:, None, None] * FANOUT + grid[:, None] + 0 * grid).reshape(-1), (b[:, None, None] * FANOUT + grid + 0 * grid[:, None]).reshape(-1)
                far, done = np.repeat(far, FANOUT**2), np.repeat(done, FANOUT**2)
                ok = (a <= b) & (b < len(mask))
                a, b, far, done = a[ok], b[ok], far[ok], done[ok]
            shared = mask[a] & mask[b]
            far = far + np.bitwise_count((bits[a] ^ bits[b]) & shared & ~done)
            ok = far <= radius
            a, b, far, done = a[ok], b[ok], far[ok], (done | shared)[ok]
        n = len(self.levels[0][0])
        self.pairs, self.pruned = n * (n + 1) // 2, n * (n + 1) // 2 - len(a)
        return a, b

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (in the order given) of linked pairs, by blocks of pairs of leaves; each pair once."""
        left, right = self.leaf_pairs(radius)
        n, inside = len(self.values), np.arange(LEAF)
        padded = np.concatenate([self.values, np.zeros(-n % LEAF, np.uint64)]).reshape(-1, LEAF)
        for at in range(0, len(left), 4096):
            i, j = left[at : at + 4096], right[at : at + 4096]
            p, x, y = np.nonzero(np.bitwise_count(padded[i][:, :, None] ^ padded[j][:, None, :]) <= radius)
            a, b = i[p] * LEAF + inside[x], j[p] * LEAF + inside[y]
            ok = (a < b) & (b < n)
            yield self.order[a[ok]], self.order[b[ok]]


def forest(values: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of one index, the place of a member that stands for its linked group."""
    parent = np.arange(len(values))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in GrayIndex(values).links(radius):
        # most pairs of a block already stand together: drop them before the loop
        while len(a):
            for _ in range(3):
                parent[:] = parent[parent]
            apart = parent[a] != parent[b]
            a, b = a[apart], b[apart]
            for i, j in zip(a[:4096].tolist(), b[:4096].tolist()):
                x, y = root(i), root(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            a, b = a[4096:], b[4096:]
    while (parent != parent[parent]).any():
        parent = parent[parent]
    return parent


def disjoint(bits: list[int], radius: int, width: int) -> list[int]:
    """Masks of radius + 1 disjoint sets of `width` of the bits, or of all of them shared out if they are fewer.

    Two values with at most radius differing bits agree on one of the masks, however few bits these have. Without any
    bits to tell values apart by, one empty mask is enough.
    """
    width = min(width, len(bits) // (radius + 1))
    if width < 1:
        return [0]
    return [sum(1 << b for b in bits[i * width : (i + 1) * width]) for i in range(radius + 1)]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def link_indexes(filed: DataFrame, radius: int, rows_a_task: int = 1 << 16) -> DataFrame:
    """The spanning forest (a, b) of representatives over each index, a group of equal (mask, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for s, e in zip(starts.tolist(), np.append(starts[1:], len(key)).tolist()):
                to = forest(fp[s:e], radius)
                other = np.flatnonzero(to != np.arange(e - s))
                a.append(rep[s:e][to[other]])
                b.append(rep[s:e][other])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("mask", "key")], axis=1)
            held.append((key, batch.column("fp").to_numpy().view(np.uint64), batch.column("rep").to_numpy()))
            if (held[0][0][0] == key[-1]).all():
                continue  # one index so far
            key, fp, rep = (np.concatenate(x) for x in zip(*held))
            last = np.flatnonzero((key != key[-1]).any(axis=1))[-1] + 1
            yield flush(key[:last], fp[:last], rep[:last])
            held = [(key[last:], fp[last:], rep[last:])]
        if held:
            yield flush(*(np.concatenate(x) for x in zip(*held)))

    tasks = max(1, filed.count() // rows_a_task)
    return filed.repartition(tasks, "mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(run, "a long, b long")


def links(reps: DataFrame, radius: int = 2, size: int = 4096, most: int = 16_384) -> DataFrame:
    """Links (a, b) of representatives that connect all fingerprints within radius; reps has distinct fp and its rep.

    An index larger than `most` is dealt out by `deeper` further bits a set until none is left or all bits are used;
    what then still stands together differs in no bit of any set and is searched as it is.
    """
    width = max(0, math.ceil(math.log2(max(1, reps.count()) / size)))
    dealt = [(0, signed(m)) for m in disjoint(list(range(BITS)), radius, width)]
    filed, out, deeper = reps.select("fp", "rep", F.lit(0).cast("long").alias("mask")), None, 6
    while True:
        longer = F.array()
        for m in {m for m, _ in dealt}:  # radius + 1 masks for each earlier one
            longer = F.when(F.col("mask") == m, F.array(*(F.lit(x).cast("long") for k, x in dealt if k == m))).otherwise(longer)
        filed = filed.select("fp", "rep", F.explode(longer).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        filed = filed if out is None else filed.dropDuplicates(["mask", "fp"])  # by two ways
        large = filed.groupBy("mask", "key").count().where(F.col("count") > most).select("mask", "key")
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]  # at most those in `dealt`
        dealt = []
        for m in masks:
            free = [b for b in range(BITS) if not (m >> b) & 1]
            dealt += [(m, signed((m % (1 << BITS)) | extra)) for extra in disjoint(free, radius, deeper)] if len(free) > radius else []
        if not dealt:
            done = link_indexes(filed, radius)
            return done if out is None else out.unionByName(done)
        large = large.where(F.col("mask").isin([m for m, _ in dealt]))
        done = link_indexes(filed.join(large, ["mask", "key"], "left_anti"), radius)
        out = done if out is None else out.unionByName(done)
        filed = filed.join(large, ["mask", "key"], "left_semi").select("fp", "rep", "mask")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links lead to, itself included.

    Null and wordless texts have fingerprint zero and link like others. Repeated rows keep a row each. A row with a
    null doc_id gets its fingerprint's component, null where no row of that fingerprint has an id. An empty table
    gives none. Extra columns are not used.
    """
    base = stored(with_fingerprint(docs.select("doc_id", "text"), out="fp", shingle=shingle).drop("text"), "simhash")
    reps = stored(base.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    found = components(stored(links(reps, radius), "simhash-links"))
    of = reps.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return base.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_nodes(rows: DataFrame, radius: int) -> DataFrame:
    """Pairs (a < b) of nodes by which the index connects all fingerprints within radius; rows has fp and node.

    Nodes of one fingerprint go with the smallest of them, which stands for it in the index.
    """
    of = stored(rows.select("fp", "node").distinct(), "simhash-nodes")
    reps = stored(of.groupBy("fp").agg(F.min("node").alias("rep")), "simhash-reps")
    same = of.join(reps, "fp").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    pairs = links(reps, radius).unionByName(same).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stored(pairs.distinct(), "simhash-links")


def with_set_and_fingerprint(docs: DataFrame, node: str, fp: str) -> DataFrame:
    """docs with the number of each text's set of 5-word shingles and its fingerprint."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = batch.column("text").to_pylist()
        values = np.array([fingerprint(t) for t in texts], np.uint64)
        return {node: pa.array([likeness.node_of(likeness.shingles(t)) for t in texts], pa.int64()), fp: pa.array(values.view(np.int64))}

    return with_arrow_columns(docs, run, {node: "long", fp: "long"})


def keep_one(docs: DataFrame, radius: int = 2, least: float | None = None) -> DataFrame:
    """documents with one row of each component: that with the smallest doc_id, of equal ids the one with the smallest
    node and then the first one stored.

    A node is a fingerprint, and fingerprints within radius are linked. With `least`, a node is a set of 5-word shingles,
    and sets with that Jaccard likeness or more are linked: the links that the index finds are confirmed on the sets, and
    a prefix filter finds all others, as most pairs at 0.8 lie further apart than any radius at which an index prunes.
    Rows without doc_id belong to components like others and stand last in them. Null and wordless texts share one node.
    Rows are told apart by a number stored with them.
    """
    row, node, fp = unused(docs, "_row", "_node", "_fp")
    base = docs.withColumn(row, F.monotonically_increasing_id())
    base = stored(with_fingerprint(base, out=node) if least is None else with_set_and_fingerprint(base, node, fp), "keep-one")
    rows = base.select(F.col(row).alias("row"), F.col(node).alias("node"), "doc_id", "text")
    if least is None:
        reps = stored(rows.groupBy(F.col("node").alias("fp")).agg(F.min("row").alias("rep")), "simhash-reps")
        found = components(stored(links(reps, radius), "simhash-links"))
        found = reps.join(found.select(F.col("node").alias("rep"), "component"), "rep").select(F.col("fp").alias("node"), "component")
    else:
        near = near_nodes(base.select(F.col(fp).alias("fp"), F.col(node).alias("node")), radius)
        found = likeness.alike(rows.drop("doc_id"), least, near=near)
    # a component is named by one of its nodes, or by a row where a fingerprint stands for it; the flag keeps these apart
    of = rows.drop("text").join(found, "node", "left")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node", "row"))
    one = of.groupBy(F.col("component").isNull(), F.coalesce("component", "node")).agg(first.alias("first")).select(F.col("first.row").alias(row))
    return base.join(one, row, "left_semi").select(columns_of(docs))
