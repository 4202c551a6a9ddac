"""Sum-of-squares online packing of token sequences.

A document's full windows are cut off first; what remains of it goes, whole, into the fill level that keeps the sum
of squared level counts smallest. The counts of partially filled windows by level stand in one array, so a choice
reads two slices of it. When a partition ends, or before it does if its open windows outgrow their memory, the windows
still open are filled up by cutting: their pieces, largest windows first, flow into full windows, and what is left over
at the very end goes out in windows whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches

#: Characters for which splitting by white space and lower-casing is the same in Python as in the tokenizer.
PLAIN = bytes(range(9, 14)) + bytes(range(32, 127)) + bytes(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
PRETOKEN = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\\s0-9a-zß-öø-ÿ]+")


def byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes themselves, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: b if b in shown else next(hidden) for b in range(256)}


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes, by a tokenizers file, with words remembered.

    A text of plain Latin characters is split at white space; each distinct chunk is encoded once by the tokenizer's
    own BPE model and then looked up. Any other text, and one that holds an added token such as an end marker, goes
    through the tokenizer whole, as loaded: a marker in a text is one id. `most` bounds what is kept.
    """

    def __init__(self, path: str, end: int = 2, most: int = 300_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"].lower() for t in json.load(f).get("added_tokens") or []]
        self.model, self.letters, self.most = self.whole.model, byte_letters(), most
        self.end, self.known = np.array([end], "<u4").tobytes(), {}
        self.split = self.splits_alike()

    def splits_alike(self) -> bool:
        """Whether the short way gives what the tokenizer gives; else every text takes the long way."""
        probe = "It's  a Tést, don't\tPANIC!! x1-22ß ÿ\n'Re ''ll #%a.b@c (é)ÀÖ ¿".replace("¿", "")
        return b"".join(self.chunk(c) for c in probe.lower().split()) == self.long(probe)

    def long(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, word: str) -> bytes:
        seen = word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(seen)], "<u4").tobytes()

    def chunk(self, chunk: str) -> bytes:
        parts = PRETOKEN.findall(chunk)
        if len(parts) == 1:
            out = self.piece(chunk)
        else:
            found = []
            for p in parts:
                if (ids := self.known.get(p)) is None:
                    ids = self.piece(p)
                    if len(p) < 40:
                        self.known[p] = ids
                found.append(ids)
            out = b"".join(found)
        if len(chunk) < 40:
            self.known[chunk] = out
        return out

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return self.end
        try:
            plain = self.split and not text.encode("latin-1").translate(None, PLAIN)
        except UnicodeEncodeError:
            plain = False
        lower = text.lower() if plain else ""
        if not plain or any(a in lower for a in self.added):
            return self.long(text) + self.end
        if len(self.known) > self.most:
            self.known.clear()
        get, chunk = self.known.get, self.chunk
        return b"".join([get(c) or chunk(c) for c in lower.split()]) + self.end


#: About what a piece takes up in Python besides its token ids, in bytes.
PIECE = 256


class Packer:
    """Packs documents of one partition. Piece: (document, start, length, crc32, document's tokens, window, offset)."""

    def __init__(self, size: int, first: int):
        self.size, self.next, self.out = size, first, []
        self.counts = np.zeros(size + 1, np.int64)  # of open windows by fill level; level 0 and size stay 0
        self.open: list[list[list]] = [[] for _ in range(size)]  # by level: windows as lists of pieces
        self.held = 0  # bytes of the pieces in open windows
        self.moved = 0  # ids that left the window they were placed in when open windows were filled up

    def emit(self, pieces: Iterable[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, at))
            at += len(ids) // 4
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        total, step = len(ids) // 4, self.size * 4
        full = total // self.size
        for i in range(full):
            self.emit([(doc, i * self.size, ids[i * step : (i + 1) * step], total)])
        n = total - full * self.size
        if n:
            self.place((doc, full * self.size, ids[full * step :], total), n)

    def place(self, piece: tuple, n: int) -> None:
        size, counts = self.size, self.counts
        # Change of the sum of squares for level h: 2 (after - before) + 2 from an open window, 2 after + 1 from a new one;
        # a window that becomes full leaves the sum.
        here, then = counts[: size - n + 1], counts[n : size + 1]
        cost = 2 * (then - here) + 2
        cost[size - n] -= 2 * counts[size] + 1
        cost[here == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * then[0] + 1 if n < size else 0
        best = len(cost) - 1 - int(np.argmin(cost[::-1]))  # of equal levels the fullest
        window = []
        if best:
            window = self.open[best].pop()
            counts[best] -= 1
        window.append(piece)
        self.held += n * 4 + PIECE
        if best + n == size:
            self.emit(window)
            self.held -= size * 4 + len(window) * PIECE
        else:
            self.open[best + n].append(window)
            counts[best + n] += 1

    def finish(self) -> list[tuple]:
        """Windows still open become full ones by cutting; the last pieces go out in powers of two.

        What stands in a window stays there. Only the emptiest windows are taken apart, to fill up the others.
        """
        left = [w for level in reversed(self.open) for w in level]
        rest: list[tuple] = []
        # The emptiest windows are taken apart to fill up the fullest.
        lo, hi = 0, len(left)
        loose: list[tuple] = []
        while lo < hi:
            window, room = left[lo], self.size - sum(len(p[2]) for p in left[lo]) // 4
            lo += 1
            while room and (loose or lo < hi):
                if not loose:
                    hi -= 1
                    loose = left[hi]
                doc, start, ids, total = loose.pop()
                if len(ids) // 4 > room:
                    loose.append((doc, start + room, ids[room * 4 :], total))
                    ids = ids[: room * 4]
                window.append((doc, start, ids, total))
                room -= len(ids) // 4
                self.moved += len(ids) // 4
            if room:
                rest = window
            else:
                self.emit(window)
        rest = rest + loose if rest else loose
        self.moved += sum(len(p[2]) for p in rest) // 4
        while (n := sum(len(p[2]) for p in rest) // 4):
            take, window, after = 1 << (min(n, self.size).bit_length() - 1), [], []
            for doc, start, ids, total in rest:
                cut = min(take, len(ids) // 4)
                if cut:
                    window.append((doc, start, ids[: cut * 4], total))
                if cut < len(ids) // 4:
                    after.append((doc, start + cut, ids[cut * 4 :], total))
                take -= cut
            self.emit(window)
            rest = after
        self.counts[:] = 0
        self.open, self.held = [[] for _ in range(self.size)], 0
        out, self.out = self.out, []
        return out


@functools.cache
def ids_of(path: str, end: int) -> Ids:
    return Ids(path, end)


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end: int = 2, most: int = 64 << 20) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    One pass, no shuffle: each partition is packed where it is read, and the token ids never leave the worker. Windows
    stay open to the partition's end, or until they hold more than `most` bytes (as many documents of equal length make
    them do, if no two fit together); then all are filled up by cutting. sequence_id joins the partition's number and a
    count, so it is unique. The rows of a partition must come in the same order when a lost task runs again, as they do
    from a table.

    A null text counts as empty: one piece that holds only the end id. Rows with a null or repeated doc_id are packed
    like others. An empty table gives no piece. Extra columns are not used. Very long texts are cut into full windows.
    """
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer = ids_of(tokenizer, end), Packer(size, TaskContext.get().partitionId() << 40)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows) if rows else [()] * len(COLUMNS)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(COLUMNS))

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                packer.add(doc, ids(text))
                if packer.held > most:
                    yield batch(packer.finish())
            if len(packer.out) > 10_000:
                rows, packer.out = packer.out, []
                yield batch(rows)
        yield batch(packer.finish())

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} long" for c in COLUMNS))
