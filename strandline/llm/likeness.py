"""Links between texts whose sets of word shingles have a Jaccard likeness of `least` or more, none of them lost.

Shingles are put in one order for all texts, common ones last. Of a set of n, two alike ones share one of the first
n - ceil(least * n) + 1 at least (prefix filter), so each set is filed under these only, and sets of one file whose
sizes allow the likeness are candidates. Every candidate is confirmed on the whole sets. In a file with more than
`SMALL` sets, which near copies of one text make, each set is first compared with a few pivots, among them the one with
the fewest shingles of its own, which is the text that the others were made from or nearest to it. Then only pairs that
the links so far leave in different components are compared, and of these only pairs that can be alike: two sets that
share a rare shingle meet in its small file, since the first shingle in order that they share is in both prefixes, so
those that meet under a common one only have common shingles to share, and the smaller number of these bounds what
they have in common. Near copies with many changes of their own are thus not compared with each other at all.

Pairs that an index over fingerprints has found may be given: they are confirmed before all others, and candidates that
these links have joined already are not compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, with_arrow_columns
from .graph import components

#: Sets of a file up to which all its pairs are candidates at once, and pivots of a larger one.
SMALL, PIVOTS = 32, 4
#: Texts with a shingle beyond which it counts as common, and texts a file bucket.
COMMON, BUCKET_ROWS = 12, 2048
#: Bytes of a shingle hash that are compared when a pair is confirmed.
KEPT = 5
#: Words of 64 bits in the bitmap of a set.
BITMAP = 8
#: Words whose hashes a worker remembers, and at most how many; workers go on from stage to stage.
WORDS: dict[bytes, int] = {}
REMEMBERED = 250_000


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k words; a text of fewer words is one run, a wordless one none."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(WORDS) > REMEMBERED:
        WORDS.clear()
    for w in words:
        if w not in WORDS:
            WORDS[w] = xxhash.xxh64_intdigest(w, 42)
    v = np.array([WORDS[w] for w in words], np.uint64)
    if len(v) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 7)], np.uint64)
    h = v[: len(v) - k + 1].copy()
    for j in range(1, k):
        h = ((h * np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(29))) + v[j : j + len(h)]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return np.unique(h ^ (h >> np.uint64(33)))


def node_of(values: np.ndarray) -> int:
    """The number that stands for a set of shingles, as a signed 64-bit digest; equal sets have one."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())).view(np.int64))


def bitmap(values: np.ndarray) -> bytes:
    """Which of the bits that a shingle's hash can name are named in a set."""
    bits = np.zeros(64 * BITMAP, bool)
    bits[values % np.uint64(64 * BITMAP)] = True
    return np.packbits(bits).tobytes()


def with_node(docs: DataFrame, out: str = "node", k: int = 5) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {out: pa.array([node_of(shingles(t, k)) for t in batch.column("text").to_pylist()], pa.int64())}

    return with_arrow_columns(docs, run, {out: "long"})


def needed(n, least: float):
    """The least whole number at or above least * n; a hair below it counts as reached."""
    return np.ceil(least * n - 1e-9)


def dealt(texts: DataFrame, bits: int, k: int, rows: Callable[[list[np.ndarray]], tuple[np.ndarray, ...]], kinds: tuple[type, ...]) -> DataFrame:
    """bucket and a blob for each array that rows makes from the sets of some texts, dealt by the first one's top bits."""
    small_batches(texts.sparkSession)
    names = [f"c{i}" for i in range(len(kinds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(sets: list[np.ndarray]) -> pa.RecordBatch:
            made = rows(sets)
            order = np.argsort(made[0], kind="stable")
            made = [x[order].astype(t) for x, t in zip(made, kinds)]
            key = (made[0] >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.searchsorted(key, np.arange((1 << bits) + 1))
            used = np.flatnonzero(cuts[1:] > cuts[:-1])
            blobs = [pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in used.tolist()], pa.binary()) for x in made]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *blobs], names=["bucket", *names])

        held, size = [], 0
        for b in batches:
            for t in b.column("text").to_pylist():
                held.append(shingles(t, k))
                size += len(held[-1])
                if size > 1_000_000:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return texts.select("text").mapInArrow(run, "bucket long, " + ", ".join(f"{n} binary" for n in names))


def common(texts: DataFrame, bits: int, most: int, k: int) -> np.ndarray:
    """Sorted hashes of the shingles that more than `most` texts have.

    Each task counts first, so that a shingle of every text is a row for each batch of texts and not for each text.
    """

    def rows(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate(sets), return_counts=True)

    def count(t: pa.Table) -> pa.Table:
        h, n = (np.concatenate([np.frombuffer(x, kind) for x in t[c].to_pylist()]) for c, kind in (("c0", np.uint64), ("c1", np.int32)))
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return pa.table({"h": pa.array(h[first][np.add.reduceat(n, first) > most].view(np.int64))})

    found = dealt(texts, bits, k, rows, (np.uint64, np.int32)).groupBy("bucket").applyInArrow(count, "h long").toArrow()
    return np.sort(found["h"].to_numpy().view(np.uint64))


def possible(n: np.ndarray, c: np.ndarray, other_n: np.ndarray, other_c: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of n and other_n shingles can be alike if they share none but some of their c and other_c common ones."""
    return np.minimum(c, other_c) >= needed(n + other_n, least / (1 + least))


def file_pairs(h: np.ndarray, node: np.ndarray, n: np.ndarray, c: np.ndarray, least: float) -> pa.Table:
    """Of files (equal h) all candidate pairs (a < b); of large ones pairs with pivots, and their rows (a, h, n > 0, c).

    c is the number of a set's common shingles where the file is one of a common shingle, and n where it is not.
    """
    order = np.lexsort((node, n, h))
    h, node, n, c = h[order], node[order], n[order], c[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])
    h, node, n, c = h[new], node[new], n[new], c[new]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(np.append(starts, len(h)))
    large = np.repeat(sizes > SMALL, sizes)
    a, b = [], []
    sh, sn, sd = h[~large], n[~large], node[~large]
    for d in range(1, SMALL):
        same = sh[d:] == sh[:-d]
        if not same.any():
            break
        at = np.flatnonzero(same & (sn[:-d] >= needed(sn[d:], least)))
        a.append(sd[at])
        b.append(sd[at + d])
    for s, m in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        salt = np.uint64(0x9E3779B97F4A7C15 * (2 * int(h[s] % np.uint64(PIVOTS)) + 1) % (1 << 64))
        while m:  # by ranges of sizes
            w = int(np.searchsorted(needed(n[s : s + m], least), n[s], "right"))
            mixed = node[s : s + w].view(np.uint64) * salt
            central = np.lexsort((mixed, (n - c)[s : s + w]))[0] if h[s] % np.uint64(2) else np.argmin(mixed)
            pivot = s + int(central)
            other = np.delete(np.arange(s, s + w), pivot - s)
            other = other[possible(n[pivot], c[pivot], n[other], c[other], least)]
            a.append(np.full(len(other), node[pivot]))
            b.append(node[other])
            s, m = s + w, m - w
    x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
    rest = np.zeros(len(pairs), np.int64)
    return pa.table({
        "a": np.concatenate([pairs[:, 0], node[large]]), "b": np.concatenate([pairs[:, 1], node[large]]),
        "h": np.concatenate([rest, h[large].view(np.int64)]), "n": np.concatenate([rest, n[large]]).astype(np.int64), "c": np.concatenate([rest, c[large]]).astype(np.int64),
    })


def candidates(texts: DataFrame, heavy: np.ndarray, bits: int, least: float, k: int) -> DataFrame:
    """(a, b, 0, 0, 0): pairs of nodes to compare, and (node, node, h, n, c) for the rows of large files."""
    shared = texts.sparkSession.sparkContext.broadcast(heavy)

    def rows(sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        last, seen, parts = shared.value, set(), []
        for s in sets:
            node = node_of(s)
            if not len(s) or node in seen:
                continue
            seen.add(node)
            n, rare, own = len(s), s, len(s)
            if len(last):
                at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                is_common = last[at] == s
                rare = np.concatenate([s[~is_common], s[is_common]])
                own = n - int(is_common.sum())
            prefix = rare[: n - int(needed(n, least)) + 1]
            c = np.full(len(prefix), n - own)
            c[:own] = n
            parts.append((prefix, np.full(len(prefix), node), np.full(len(prefix), n), c))
        if not parts:
            return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*parts))

    kinds = (np.uint64, np.int64, np.int32, np.int32)

    def pairs(t: pa.Table) -> pa.Table:
        h, node, n, c = (np.concatenate([np.frombuffer(x, kind) for x in t[f"c{i}"].to_pylist()]) for i, kind in enumerate(kinds))
        return file_pairs(h, node, n.astype(np.int64), c.astype(np.int64), least)

    return dealt(texts, bits, k, rows, kinds).groupBy("bucket").applyInArrow(pairs, "a long, b long, h long, n long, c long")


def sets_of(pairs: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """node, set, bits of every node in the pairs (a, b); base has row, node, text."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = base.groupBy("node").agg(F.min("row").alias("row")).join(wanted, "node", "left_semi").select("row")

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [shingles(t, k) for t in batch.column("text").to_pylist()]
        sets = (s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEPT :] for s in found)
        return {"set": pa.array([s.tobytes() for s in sets], pa.binary()), "bits": pa.array([bitmap(s) for s in found], pa.binary())}

    sets = with_arrow_columns(base.join(one, "row", "left_semi").select("node", "text"), run, {"set": "binary", "bits": "binary"})
    return stored(sets.select("node", "set", "bits"), "likeness-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are alike."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")

    def values(data: bytes) -> np.ndarray:
        out = np.zeros((len(data) // KEPT, 8), np.uint8)
        out[:, 8 - KEPT :] = np.frombuffer(data, np.uint8).reshape(-1, KEPT)
        return out.view("<u8").ravel()

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column("x").to_pylist(), t.column("y").to_pylist()):
                p, q = values(x), values(y)
                c = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(c >= needed(len(p) + len(q) - c, least))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], names=["a", "b"])

    return stored(both.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long"), "likeness-links")


def joined_apart(pairs: DataFrame, group: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes do not stand in one component."""
    for c in ("a", "b"):
        pairs = pairs.join(group.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left")
    return pairs.where("of_a is null or of_b is null or of_a <> of_b").select("a", "b")


def left_apart(rows: DataFrame, group: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs of sets of one large file that stand in different components and can be alike, by their numbers of shingles
    and their bitmaps; a set that has no bitmap yet is bounded by numbers alone."""
    labelled = rows.join(group.select(F.col("node").alias("a"), "component"), "a", "left").join(sets.select(F.col("node").alias("a"), "bits"), "a", "left")
    labelled = labelled.select("h", "a", "n", "c", F.coalesce("component", "a").alias("of"), "bits")
    unknown = bytes(8 * BITMAP)

    def run(t: pa.Table) -> pa.Table:
        n = t["n"].to_numpy()
        order = np.argsort(n, kind="stable")
        n, c, node, of = n[order], t["c"].to_numpy()[order], t["a"].to_numpy()[order], t["of"].to_numpy()[order]
        has = np.frombuffer(b"".join(x or unknown for x in t["bits"].to_pylist()), "<u8").reshape(-1, BITMAP)[order]
        known = has.any(axis=1)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if (of != of[0]).any():
            for i, end in enumerate(np.searchsorted(needed(n, least), n, "right").tolist()):
                j = np.arange(i + 1, end)
                j = j[(of[j] != of[i]) & possible(n[i], c[i], n[j], c[j], least)]
                lacks = lambda x, y: np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
                most = np.minimum(n[i] - lacks(has[i], has[j]), n[j] - lacks(has[j], has[i]))
                other = node[j[(most >= needed(n[i] + n[j], least / (1 + least))) | ~known[i] | ~known[j]]]
                a.append(np.minimum(node[i], other))
                b.append(np.maximum(node[i], other))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return labelled.groupBy("h").applyInArrow(run, "a long, b long").distinct()


def alike(base: DataFrame, least: float = 0.8, k: int = 5, broadcast: int = 40_000_000, near: DataFrame | None = None) -> DataFrame:
    """node, component of every node that is linked with another one; base, a stored table, has row, node and text.

    near, a stored table, has the pairs (a, b) of nodes that an index found, whether alike or not. Common shingles are
    sent to every task, `broadcast` of them at most (8 bytes each), whatever the table's size.
    """
    n = base.count()
    bits = max(5, math.ceil(math.log2(max(1, n / BUCKET_ROWS))))
    # a text of c characters has c / 2 shingles at most, so no more than `broadcast` shingles are in more texts than this
    size = base.agg(F.sum(F.length("text"))).first()[0] or 0
    heavy = common(base, bits, max(COMMON, n // 50_000, -(-size // (2 * broadcast))), k)
    found = stored(candidates(base, heavy, bits, least, k), "likeness-candidates")
    first = found.where("n = 0").select("a", "b").distinct()
    sets = sets_of(first if near is None else first.unionByName(near), base, k)
    if near is None:
        links = confirmed(first, sets, least)
    else:
        links = confirmed(near, sets, least)
        links = links.unionByName(confirmed(joined_apart(first, components(links)), sets, least))
    group, rows = components(links), found.where("n > 0")
    if rows.isEmpty():
        return group
    more = stored(left_apart(rows, group, sets, least).join(first, ["a", "b"], "left_anti"), "likeness-apart")
    again = confirmed(more, sets_of(more, base, k), least)
    return group if again.isEmpty() else components(links.unionByName(again))
