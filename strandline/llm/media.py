"""Media columns in a store of content-defined chunks.

A payload is kept as an 8-bit mono WAV. A rolling gear hash over the samples cuts it where the content says so, so
equal passages in different media give equal chunks. A Spark aggregation keeps one copy of each chunk, owned by one
medium; a recipe lists a medium's chunks in order. Reading joins recipes and chunks, puts each medium together
and verifies every chunk and the whole by digest.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, whole_text, with_arrow_columns
from .zstd_dictionary import as_dict, sample, train

HEADER = 44
UNIT = 64
#: Chunk sizes in bytes: no cut below LEAST, one at MOST, and about AVERAGE (a power of two) beyond LEAST in between.
LEAST, AVERAGE, MOST = 1024, 8192, 65536


@functools.cache
def gear_table() -> np.ndarray:
    """256 words from a rule: the first eight bytes of each byte's SHA-256."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") for b in range(256)], np.uint64)


def key(data: bytes) -> bytes:
    """The digest by which chunks and media are known: the first 128 bits of SHA-256."""
    return hashlib.sha256(data).digest()[:16]


def padded(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def wav_header(n: int, rate: int = 8000) -> bytes:
    """The head of an 8-bit mono PCM file of n samples; sizes beyond 32 bits are kept modulo them."""
    cut = (1 << 32) - 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", (n + HEADER - 8) & cut, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n & cut)


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks of data.

    The gear hash of a place is the sum of the last 64 bytes' table words, each shifted left once for every byte since;
    it is built here by doubling: sums over 1, 2, 4, ... 64 bytes.
    """
    n, block = len(data), 1 << 20
    candidates = []
    for at in range(0, n, block):
        lead = min(at, 63)
        h = gear_table()[np.frombuffer(data, np.uint8, min(block, n - at) + lead, at - lead)]
        for span in (1, 2, 4, 8, 16, 32):
            h[span:] += h[:-span] << np.uint64(span)
        hit = np.flatnonzero((h[lead:] >> np.uint64(40)) & np.uint64(AVERAGE - 1) == 0)
        candidates.append(hit + at + 1)
    ends, last = [], 0
    for c in np.concatenate(candidates).tolist() + [n]:
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST or c == n and c > last:
            last = c
            ends.append(c)
    return ends


def chunks(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def catalog(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (digest of the WAV) and the ordered chunk digests of each whole text."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out = {"n_bytes": [], "media": [], "digests": []}
        for text in batch.column("text").to_pylist():
            payload = padded(text)
            out["n_bytes"].append(len((text or "").encode()))
            out["media"].append(key(wav_header(len(payload)) + payload))
            out["digests"].append([key(c) for c in chunks(payload)])
        return {k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.binary(), pa.list_(pa.binary())))}

    kinds = {"n_bytes": "long", "media": "binary", "digests": "array<binary>"}
    return with_arrow_columns(docs.select("doc_id", "text"), run, kinds).drop("text")


def chunk_store(docs: DataFrame, level: int = 15) -> tuple[DataFrame, bytes]:
    """digest, media, seq, refs, z of every distinct chunk, and the compression dictionary.

    media and seq name the owner, the smallest medium that has the chunk; refs counts the rows that do. Copies meet
    within a task before anything is shuffled, so a chunk that very many documents share is no large group.
    """
    raw = train(sorted({bytes(r["b"]) for r in sample(docs.select(whole_text().cast("binary").alias("b")), F.col("b"))}))
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=level, dict_data=as_dict(raw), write_dict_id=False)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                payload = padded(text)
                media = key(wav_header(len(payload)) + payload)
                rows += [(key(c), media, i, pack.compress(c)) for i, c in enumerate(chunks(payload))]
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], names=["digest", "media", "seq", "z"])

    found = docs.select("text").mapInArrow(run, "digest binary, media binary, seq int, z binary")
    owner = found.groupBy("digest").agg(F.min(F.struct("media", "seq", "z")).alias("o"), F.count("*").alias("refs"))
    return owner.select("digest", "o.media", "o.seq", "refs", "o.z"), raw


def read(store: DataFrame, raw: bytes, recipes: DataFrame) -> DataFrame:
    """media, data of every medium in recipes (media, digests), each chunk and then the whole verified by digest.

    The head of a WAV follows from the size of its samples and is put in front of the chunks. A chunk goes straight to
    its owner; only references to other media's chunks are joined with the chunks that have several references.
    """
    recipes = recipes.dropDuplicates(["media"])
    places = recipes.select("media", F.posexplode("digests").alias("seq", "digest"))
    shared = store.where("refs > 1").select("digest", F.col("media").alias("_m"), F.col("seq").alias("_s"), "z")
    others = places.join(shared, "digest").where("not (media = _m and seq = _s)").select("media", "seq", "digest", "z")
    parts = store.select("media", "seq", "digest", "z").unionByName(others)
    small_batches(store.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=as_dict(raw))

        def one(media: bytes, got: list[bytes]) -> bytes:
            data = b"".join([wav_header(sum(map(len, got))), *got])
            if key(data) != media:
                raise ValueError(f"medium {media.hex()} can't be put together")
            return data

        def batch(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["media", "data"])

        media, got, done, size = None, [], [], 0
        for b in batches:
            for m, d, z in zip(*(b.column(c).to_pylist() for c in ("media", "digest", "z"))):
                if m != media:
                    if media is not None:
                        done.append((media, one(media, got)))
                        size += len(done[-1][1])
                        if size > 4 << 20:
                            yield batch(done)
                            done, size = [], 0
                    media, got = m, []
                got.append(unpack.decompress(z))
                if key(got[-1]) != d:
                    raise ValueError(f"chunk {d.hex()} isn't what its digest says")
        if media is not None:
            done.append((media, one(media, got)))
        yield batch(done)

    return parts.repartition("media").sortWithinPartitions("media", "seq").mapInArrow(run, "media binary, data binary")


def features(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and how often they cross the middle."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    values = np.arange(256)
    mean = float((p * values).sum())
    spread = float(np.sqrt((p * (values - mean) ** 2).sum()))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    above = x >= 128
    return f"mean={mean:.6f};std={spread:.6f};entropy={entropy:.6f};crossings={int((above[1:] != above[:-1]).sum())}"


def query(docs: DataFrame) -> DataFrame:
    """Store every text of docs, read the media back, and describe each document by its medium.

    A null text is an empty payload of 64 zero bytes. Copies share one medium; each row of docs gets a row. Null and
    repeated doc_ids are kept as they are. An empty table gives none. Extra columns are not used.
    """
    recipes = stored(catalog(docs), "media-catalog")
    found, raw = chunk_store(docs)
    store = stored(found, "media-chunks")

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out = {"payload_bytes": [], "payload_sha256": [], "tail_crc32": [], "media_bytes": [], "media_sha256": [], "feature": []}
        for data in batch.column("data").to_pylist():
            payload = data[HEADER:]
            for c, v in zip(out.values(), (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), features(payload))):
                c.append(v)
        return {k: pa.array(v, pa.int64() if k in ("payload_bytes", "tail_crc32", "media_bytes") else pa.string()) for k, v in out.items()}

    kinds = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    described = with_arrow_columns(read(store, raw, recipes.select("media", "digests")), run, kinds).drop("data")
    out = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    # a medium that didn't come back is an error, not a missing row
    described = described.withColumn("_back", F.lit(True))
    rows = recipes.select("doc_id", "n_bytes", "media").join(described, "media", "left")
    lost = F.raise_error(F.concat(F.lit("no chunks of medium "), F.hex("media"))).cast("long")
    return rows.select("doc_id", F.when(F.col("_back"), F.col("n_bytes")).otherwise(lost).alias("n_bytes"), *out)
