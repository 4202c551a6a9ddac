"""Token ids in files: frequency-ranked, byte-aligned variable-length numbers with their control bytes apart.

An id is stored as its rank by frequency, 0 for the most frequent, in 1 to 4 little-endian bytes. A control byte holds
the lengths, less 1, of four numbers in two bits each, the first in the lowest. A folder holds

* `vocabulary`: one line, the ids by rank as little-endian unsigned 32-bit numbers in hexadecimal;
* `ids`: a file for each range of documents, files in ascending order by name, each a row of blocks that end in SEPARATOR.

A block holds whole documents, each with its ids and zeros behind them to a multiple of four. It starts with HEAD (mask,
shard, ids before it in its shard, documents, ids, bytes of data); then come the documents' ids (signed 64 bits), a byte
for each that is 1 if it has none, their numbers of ids (unsigned 32 bits), the control bytes, and the data. All bytes but the first are xored with the mask, which is the
first that keeps SEPARATOR out of the block; it is 0 but for a chance. Blocks need nothing but the vocabulary to be read,
so Spark reads files of any size by parts.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh_path, small_batches, stored
from .packing import PLAIN, byte_letters

HEAD = struct.Struct("<BIQIII")
SEPARATOR = b"\x1e<ids>\n"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: How byte-level vocabularies part a text before they merge bytes, for the characters in PLAIN.
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")

#: For each control byte: the lengths of its four numbers, where each starts, and all their bytes.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
STARTS = np.cumsum(LENGTHS, axis=1) - LENGTHS
TOTALS = LENGTHS.sum(axis=1)
#: For each code: which of a number's four bytes are stored.
BYTES = np.arange(4) <= np.arange(4)[:, None]


def encode(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data) of unsigned 32-bit numbers, zeros behind them to a multiple of four."""
    n = len(numbers)
    whole = np.zeros(-(-n // 4) * 4, "<u4")
    whole[:n] = numbers
    codes = ((whole > 0xFF).astype(np.uint8) + (whole > 0xFFFF) + (whole > 0xFFFFFF)).reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.tobytes(), whole.view(np.uint8)[BYTES[codes.reshape(-1)].reshape(-1)].tobytes()


def encode_each(many: list[np.ndarray]) -> list[bytes]:
    """Control bytes and data behind them for each of several arrays, as encode() gives them, made all at once."""
    sizes = np.array([len(x) for x in many], np.int64)
    groups = -(-sizes // 4)
    last = np.cumsum(groups)
    whole = np.zeros(4 * int(groups.sum()), "<u4")
    if len(whole):
        whole[np.arange(sizes.sum()) + np.repeat(4 * (last - groups) - (np.cumsum(sizes) - sizes), sizes)] = np.concatenate(many)
    control, data = encode(whole)
    at = np.concatenate([[0], np.cumsum(TOTALS[np.frombuffer(control, np.uint8)])])
    cuts = zip((last - groups).tolist(), last.tolist(), at[last - groups].tolist(), at[last].tolist())
    return [control[a:b] + data[c:d] for a, b, c, d in cuts]


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n unsigned 32-bit numbers of encode(), by looking up each control byte's lengths and starts."""
    codes, held = np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8)
    totals = TOTALS[codes]
    at = ((np.cumsum(totals) - totals)[:, None] + STARTS[codes]).reshape(-1)[:n]
    lengths = LENGTHS[codes].reshape(-1)[:n]
    out = held[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if len(more):
            out[more] |= held[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class ByteIds:
    """Token ids of texts by a byte-level tokenizers file, for a batch of texts at once.

    Texts of plain Latin characters are laid one behind the other, each followed by a zero byte, and parted as PARTS
    does, by numpy over all bytes. Equal parts are found by a hash, checked by a second one; each distinct part goes once
    through the tokenizer's own merges and is remembered, `most` of them at most. Any other text, and one that holds an
    added token, goes through the tokenizer whole, as loaded.
    """

    def __init__(self, path: str, end: int = 2, most: int = 2_000_000, longest: int = 1 << 20):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f).get("added_tokens") or []]
        self.width = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.model, self.end, self.most, self.longest = self.whole.model, end, most, longest
        shown = byte_letters()
        self.shown = np.array([shown[b] for b in range(256)], "<u4")
        self.forget()
        probe = "It's  a T\u00e9st, don't\tPANIC!!   x1-22\u00df \u00ff\n\n'Re ''ll #%a.b@c (\u00e9)\u00c0\u00d6  "
        self.parted = np.array_equal(self.laid_out([probe])[0], [*self.long(probe), end])

    def forget(self) -> None:
        """Remembered parts: sorted hashes and each one's number, and by number second hashes and where the ids are among `ids`."""
        self.keys, self.numbers, self.checks = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.uint64)
        self.at, self.sizes, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.width)

    def long(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.width)

    def learn(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        """Remember new parts data[first:last], which have these hashes; keys are sorted."""
        lengths = last - first
        stop = np.cumsum(lengths)
        start = stop - lengths
        held = data[np.arange(stop[-1]) + np.repeat(first - start, lengths)]
        ends = np.cumsum(1 + (held >= 128))  # in UTF-8, each byte shown as a letter
        wide, letters = held >= 128, np.empty(ends[-1], "<u4")
        letters[ends - 1] = self.shown[np.where(wide, 0x80 | held & 0x3F, held)]
        letters[ends[wide] - 2] = self.shown[0xC0 | held[wide] >> 6]
        seen, cuts, tokenize = letters.tobytes().decode("utf-32-le"), [0, *ends[stop - 1].tolist()], self.model.tokenize
        made = [[t.id for t in tokenize(seen[a:b])] for a, b in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(held[start] == 0).tolist():  # the zero byte behind a text is the end id
            made[i] = [self.end]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        at = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(made), self.width, int(sizes.sum()))])
        place = np.searchsorted(self.keys, keys)
        numbers = np.arange(len(self.checks), len(self.checks) + len(keys), dtype=np.int32)
        self.keys, self.numbers = np.insert(self.keys, place, keys), np.insert(self.numbers, place, numbers)
        self.checks, self.at, self.sizes = (np.concatenate(x) for x in ((self.checks, checks), (self.at, at), (self.sizes, sizes)))

    def laid_out(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of plain texts, end ids included, and where each text's ids end."""
        data = np.frombuffer(b"".join(t.encode("latin-1") + b"\0" for t in texts), np.uint8)
        first = np.flatnonzero(part_starts(data))
        last = np.append(first[1:], len(data))
        place = (np.arange(len(data)) - np.repeat(first, last - first)) & (len(POWERS[0]) - 1)
        one, two = (np.add.reduceat(values[data] * powers[place], first) for values, powers in zip(VALUES, POWERS))
        keys, sample, which = np.unique(one, return_index=True, return_inverse=True)
        checks = two[sample]
        if not np.array_equal(checks[which], two):
            return self.one_by_one(texts)
        if len(self.keys) > self.most:
            self.forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            self.learn(data, first[sample[new]], last[sample[new]], keys[new], checks[new])
            at = np.searchsorted(self.keys, keys)
        number = self.numbers[at]
        if not np.array_equal(self.checks[number], checks):
            return self.one_by_one(texts)
        sizes = self.sizes[number][which]
        ends = np.cumsum(sizes)
        out = self.ids[np.repeat(self.at[number][which] - (ends - sizes), sizes) + np.arange(ends[-1])]
        return out, ends[data[first] == 0]

    def one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """laid_out() where two parts of one hash differ."""
        found = [np.append(self.long(t), np.array([self.end], self.width)) for t in texts]
        return np.concatenate(found), np.cumsum([len(x) for x in found])

    def pieces(self, text: str) -> list[str]:
        """A long text in pieces that are parted alike: a part begins at each space behind another character."""
        out, at = [], 0
        while len(text) - at > self.longest:
            found = re.compile(r"(?<=\S) ").search(text, at + self.longest)
            if not found:
                break
            out.append(text[at : found.start()])
            at = found.start()
        return [*out, text[at:]]

    def plain(self, text: str) -> bool:
        try:
            return self.parted and not text.encode("latin-1").translate(None, PLAIN) and not any(a in text for a in self.added)
        except UnicodeEncodeError:
            return False

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, the end id behind them; null counts as empty."""
        out: list[np.ndarray | None] = [None] * len(texts)
        held, size = [], 0

        def flush() -> None:
            ids, ends = self.laid_out([p for _, p in held])
            parts = np.split(ids, ends[:-1])
            for (i, _), x in zip(held, parts):  # a piece that isn't the last of its text has an end id too many
                out[i] = x if out[i] is None else np.concatenate([out[i][:-1], x])
            held.clear()

        for i, text in enumerate(texts):
            text = text or ""
            if not self.plain(text):
                out[i] = np.append(self.long(text), np.array([self.end], self.width))
                continue
            for piece in self.pieces(text):
                held.append((i, piece))
                size += len(piece)
                if size >= self.longest:
                    flush()
                    size = 0
        if held:
            flush()
        return out


#: Kinds of bytes for PARTS: the zero behind a text, letters, digits, white space, and others.
KINDS = np.full(256, 4, np.uint8)
KINDS[0] = 0
KINDS[[c for c in range(256) if re.fullmatch(f"[{LETTERS}]", chr(c))]] = 1
KINDS[48:58] = 2
KINDS[[*range(9, 14), 32]] = 3
#: Seeded values of bytes and powers of odd bases for two hashes, the powers by place modulo 4096.
VALUES = tuple(np.random.default_rng(s).integers(0, 1 << 64, 256, np.uint64) for s in (1, 2))
POWERS = tuple(np.multiply.accumulate(np.full(4096, b, np.uint64)) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def part_starts(data: np.ndarray) -> np.ndarray:
    """Where a part begins in Latin-1 texts that are each followed by a zero byte."""
    kind = KINDS[data]
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[0], before[1:], after[-1], after[:-1] = 0, kind[:-1], 0, kind[1:]
    spaced = np.zeros(len(data), bool)
    spaced[1:] = data[:-1] == 32
    other = (kind != 3) & (kind != 0)
    # a run of one kind, to which a space before it belongs; the last white space before another kind begins a part
    out = (kind != before) & ~(other & spaced) | (kind == 3) & (after != 3) & (after != 0) | (kind == 0)
    marks = np.flatnonzero((data == 39) & out & (after == 1))
    a, b = data[marks + 1], data[np.minimum(marks + 2, len(data) - 1)]
    is_in = lambda x, letters: np.isin(x, np.frombuffer(letters, np.uint8))
    one = is_in(a, b"stmd")
    two = ~one & (is_in(a, b"rv") & (b == 101) | (a == 108) & (b == 108))
    out[marks[one | two] + 1] = False
    out[marks[one] + 2] = True
    out[marks[two] + 3] = True
    return out


@functools.cache
def ids_of(path: str, end: int = 2) -> ByteIds:
    return ByteIds(path, end)


def tokens(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """doc_id, ids, digest: each document's token ids and the end id, in the tokenizer's width, little-endian; tally: null, but
    in one more row for each task, which has no ids, how often each id occurs in the task (unsigned 64 bits)."""
    small_batches(docs.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, names = ids_of(tokenizer, end), np.zeros(1, np.uint64), ["doc_id", "ids", "tally"]
        for b in batches:
            made = ids(b.column("text").to_pylist())
            more = np.bincount(np.concatenate(made)).astype(np.uint64) if made else counts[:0]
            if len(more) > len(counts):
                counts, more = more, counts
            counts[: len(more)] += more
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.tobytes() for x in made], pa.binary()), pa.nulls(len(made), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, tally binary")
    return rows.withColumn("digest", F.xxhash64("ids"))


def ranking(found: DataFrame) -> np.ndarray:
    """The ids that occur, the most frequent first, of equal ones the smaller; no more than the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("tally"):
                counts = np.frombuffer(x.as_buffer(), np.uint64)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at].astype(np.int64))], names=["id", "n"])

    rows = found.where("tally is not null").select("tally").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = (rows.column(c).to_numpy() for c in ("id", "n"))
    return ids[np.lexsort((ids, -n))].astype("<u4")


def block(shard: int, before: int, docs: list[tuple[int | None, int, bytes]], separator: bytes = SEPARATOR) -> bytes:
    """The bytes of a block of (doc_id, number of ids, control bytes and data)."""
    names = np.array([d or 0 for d, _, _ in docs], "<i8").tobytes() + bytes(d is None for d, _, _ in docs) + np.array([n for _, n, _ in docs], "<u4").tobytes()
    control, data = b"".join(x[: -(-n // 4)] for _, n, x in docs), b"".join(x[-(-n // 4) :] for _, n, x in docs)
    plain = HEAD.pack(0, shard, before, len(docs), sum(n for _, n, _ in docs), len(data)) + names + control + data
    for mask in range(256):
        out = bytes([mask]) + ((np.frombuffer(plain, np.uint8) ^ np.uint8(mask)).tobytes()[1:] if mask else plain[1:])
        if separator not in out:
            return out
    raise ValueError("no mask keeps the separator out of a block")


def documents_in(data: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(shard, ids before it in the shard, doc_id, ranks) of the documents in a block."""
    if data[0]:
        data = (np.frombuffer(data, np.uint8) ^ np.uint8(data[0])).tobytes()
    _, shard, before, docs, total, size = HEAD.unpack_from(data)
    names = np.frombuffer(data, "<i8", docs, HEAD.size)
    none = np.frombuffer(data, np.uint8, docs, HEAD.size + 8 * docs)
    counts = np.frombuffer(data, "<u4", docs, HEAD.size + 9 * docs).astype(np.int64)
    groups, at = -(-counts // 4), HEAD.size + 13 * docs
    stop = at + int(groups.sum())
    if len(data) != stop + size or counts.sum() != total:
        raise ValueError(f"a block of shard {shard} has {len(data)} bytes, not {stop + size}")
    numbers = decode(data[at:stop], data[stop:], 4 * int(groups.sum()))
    first = 4 * (np.cumsum(groups) - groups)
    for d, missing, n, at in zip(names.tolist(), none.tolist(), counts.tolist(), first.tolist()):
        yield shard, before, None if missing else d, numbers[at : at + n]
        before += n


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 2, ids_a_block: int = 65_536, ids_a_shard: int = 4_000_000, most_shards: int = 65_536) -> None:
    """Write the token ids of docs (doc_id, text) into the folder path, in ascending doc_id order.

    Rows without doc_id come first, rows of one doc_id in the order of a digest of their ids; only equal rows must lie
    in one range. A null or empty text has the end id only. A long document makes a block of its own.
    """
    spark = docs.sparkSession
    width = ids_of(tokenizer, end).width
    found = stored(tokens(docs, tokenizer, end), "token-ids")
    total = found.agg(F.sum(F.length("ids"))).first()[0] or 0
    shards = int(min(most_shards, max(1, -(-total // (width.itemsize * ids_a_shard)))))
    order = ranking(found)
    spark.createDataFrame([(order.tobytes().hex(),)], "ids string").coalesce(1).write.text(f"{path}/vocabulary")
    ranks = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    ranks[order] = np.arange(len(order))
    rank_of = spark.sparkContext.broadcast(ranks)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before, held, n = TaskContext.get().partitionId(), 0, [], 0
        out = lambda x: pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], names=["block"])
        for b in batches:
            ids = [np.frombuffer(x.as_buffer(), width) for x in b.column("ids")]
            for row in zip(b.column("doc_id").to_pylist(), map(len, ids), encode_each([rank_of.value[x] for x in ids])):
                held.append(row)
                n += row[1]
                if n >= ids_a_block:
                    yield out(block(shard, before, held))
                    before, held, n = before + n, [], 0
        if held:
            yield out(block(shard, before, held))

    keys = [F.asc_nulls_first("doc_id"), F.asc("digest")]
    # ranges are sampled from what is dealt, so it has no Python before it: ids are coded when they are in order
    rows = found.where("tally is null").select("doc_id", "ids", "digest").repartitionByRange(shards, *keys).sortWithinPartitions(*keys).select("doc_id", "ids")
    lines = rows.mapInArrow(run, "block binary").select(F.col("block").cast("string"))  # the writer takes a string's bytes as they are
    lines.write.option("lineSep", SEPARATOR.decode()).option("compression", "none").text(f"{path}/ids")
    discard(found)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, shard, before, ids: every document of the files in a folder, its ids as little-endian unsigned 32 bits."""
    small_batches(spark, 100)
    row = spark.read.text(f"{path}/vocabulary").first()
    order = spark.sparkContext.broadcast(np.frombuffer(bytes.fromhex(row[0]), "<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("block"):
                rows = [(doc, shard, before, order.value[numbers].tobytes()) for shard, before, doc, numbers in documents_in(data.as_py())]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "shard", "before", "ids"])

    blocks = spark.read.option("lineSep", SEPARATOR.decode()).text(f"{path}/ids").select(F.col("value").cast("binary").alias("block"))
    return blocks.mapInArrow(run, "doc_id long, shard int, before long, ids binary")


def query(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that its ids were written to.

    Null and repeated doc_ids, null, empty and very long texts as write() says. An empty table gives no row. Extra columns are not used.
    """
    path = fresh_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, end)
    found = read(docs.sparkSession, path)
    # crc32 of the JVM is unsigned
    found = stored(found.select("doc_id", "shard", "before", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "token-rows")
    sizes = {r["shard"]: r["n"] for r in found.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}  # a row a shard
    first, at = [], 0
    for shard in sorted(sizes):
        first.append((shard, at))
        at += sizes[shard]
    first = docs.sparkSession.createDataFrame(first, "shard int, first long")
    return found.join(F.broadcast(first), "shard").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
