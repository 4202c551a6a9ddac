"""Dictionary-compressed WARC archives (.warc.zst).

Each record is a Zstandard frame of its own, compressed with one dictionary that was built from archived records; an
archive file starts with that dictionary in a skippable frame. Spark's text writer makes the files, so they may lie in
any file system Spark knows: a frame is a line of raw bytes, and lines end with an empty skippable frame, which every
Zstandard reader passes over. The same line end lets Spark read a large archive by parts, frame by frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, hadoop_path, small_batches, stored
from .zstd_dictionary import as_dict, sample, train

#: Fixed values of the formats: magic of the dictionary's skippable frame, the profile of a revisit, a name space for ids.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: An empty skippable frame: a magic that no dictionary bears, and the size zero.
END = b"P*M\x18\0\0\0\0"


def dictionary_frame(raw: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw


def dictionary_of(frame: bytes) -> bytes:
    magic, size = struct.unpack("<II", frame[:8])
    if magic != DICTIONARY_MAGIC or size != len(frame) - 8:
        raise ValueError("an archive must start with its dictionary")
    return frame[8:]


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit has the HTTP head but no payload, and names the response it refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = "".join(c for c in url or "urn:unknown" if c > " ")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages (page_id, url, payload) with refers_to: of equal payloads of `least` bytes or more, the largest page_id.

    Only digests and ids are grouped, minima and maxima first within tasks, so a payload with very many copies is
    no large group; the payloads themselves are shuffled once, by page_id.
    """
    keys = pages.select("page_id", F.sha1("payload").alias("_sha1"), F.length("payload").alias("_n"))
    big = keys.where(F.col("_n") >= least).where("page_id is not null")
    largest = big.groupBy("_sha1", "_n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_rows")).where("_rows > 1")
    again = big.join(largest, ["_sha1", "_n"]).where("page_id < refers_to").select("page_id", "_sha1", "refers_to").distinct()
    return pages.withColumn("_sha1", F.sha1("payload")).join(again, ["page_id", "_sha1"], "left").select("page_id", "url", "payload", "refers_to")


def dictionary(pages: DataFrame, date: str, rows: int = 1000, largest: int = 32_768, size: int = 65_536) -> bytes:
    """A dictionary from whole records, heads included, of a bounded sample of pages (page_id, url, payload)."""
    found = sample(pages.select("page_id", "url", "payload"), F.col("payload"), rows, largest)
    return train([record(r["page_id"], r["url"], bytes(r["payload"]), None, date) for r in found], size)


def write(pages: DataFrame, path: str, least: int = 1000, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the archives of pages (page_id, url, html) into the folder path: a partition makes one file.

    A null html is an empty payload, a null url is urn:unknown. A null page_id stays null and is always a response, as
    no record could refer to it. Rows repeated with the largest page_id are all responses. An empty table gives
    archives without records. Extra columns are not used.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    raw = dictionary(pages, date)
    small_batches(pages.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = as_dict(raw)
        pack, plain = (zstandard.ZstdCompressor(level=n, dict_data=known, write_content_size=True, write_checksum=True) for n in (level, level + 1))
        frames = lambda x: pa.RecordBatch.from_arrays([pa.array(x, pa.binary())], names=["frame"])
        yield frames([dictionary_frame(raw)])
        for b in batches:
            rows = []
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                data = record(*row, date)
                frame = pack.compress(data)
                rows.append(frame if END not in frame else plain.compress(data))  # a line end by chance
            yield frames(rows)

    # the writer takes a string's bytes as they are
    lines = with_revisits(pages, least).mapInArrow(run, "frame binary").select(F.col("frame").cast("string"))
    lines.write.option("lineSep", END.decode()).option("compression", "none").text(path)


def publish(spark: SparkSession, path: str) -> None:
    """Give the archives in a folder that write() made their usual names; the bytes stay where they are."""
    fs, folder = hadoop_path(spark, path)
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, f"{name[:-4]}.warc.zst"))


def frames_in(data: bytes) -> Iterator[bytes]:
    """The frames of an archive's bytes, empty skippable ones left out."""
    at = 0
    while at < len(data):
        if data[at + 1 : at + 4] == END[1:4] and data[at] >> 4 == END[0] >> 4:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        else:  # a header, blocks with sizes of three bytes, a checksum of four
            head = zstandard.get_frame_parameters(data[at : at + 32])
            end, last = at + zstandard.frame_header_size(data[at : at + 32]), False
            while not last:
                block = int.from_bytes(data[end : end + 3], "little")
                last, kind, size = block & 1, block >> 1 & 3, block >> 3
                end += 3 + (1 if kind == 1 else size)
            end += 4 * head.has_checksum
        if end - at > 8:
            yield data[at:end]
        at = end


def frames_of(spark: SparkSession, path: str) -> DataFrame:
    """frame: the frames of all archives in a folder, the dictionaries among them.

    A folder as write() leaves it is read by parts, however large an archive is. Spark would take files with the
    published name for texts and decompress them without a dictionary, so these are read whole, each in a task.
    """
    fs, folder = hadoop_path(spark, path)
    if not any(f.getPath().getName().endswith(".warc.zst") for f in fs.listStatus(folder)):
        return spark.read.option("lineSep", END.decode()).text(path).select(F.col("value").cast("binary").alias("frame"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                for frame in frames_in(data.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], names=["frame"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content").mapInArrow(run, "frame binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest of every record, digests checked on the way.

    The size and digest of a response are taken from the payload that was read; those of a revisit come from the
    response that it refers to, whose digest must be the one the revisit names. Archives written together share one
    dictionary; different ones are told apart by their ids, and only one copy of each comes to the driver.
    """
    small_batches(spark, 500)
    frames = frames_of(spark, path)
    leading = F.expr(f"hex(substring(frame, 1, 4)) = '{struct.pack('<I', DICTIONARY_MAGIC).hex().upper()}'")
    dictionaries = [dictionary_of(bytes(r["d"])) for r in frames.where(leading).groupBy(F.xxhash64("frame")).agg(F.first("frame").alias("d")).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {d.dict_id() if d else 0: zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor() for d in map(as_dict, dictionaries)}
        for b in batches:
            out = [[], [], [], [], []]
            for frame in b.column("frame").to_pylist():
                fields, payload = parse(known[zstandard.get_frame_parameters(frame).dict_id].decompress(frame))
                named = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                response = fields["warc-type"] == "response"
                if response and hashlib.sha1(payload).hexdigest() != named:
                    raise ValueError(f"page {fields['x-page-id']}: its payload differs from its digest")
                refers = fields.get("x-refers-to-page-id")
                for c, v in zip(out, (int(fields["x-page-id"]) if fields["x-page-id"] else None, fields["warc-type"], int(refers) if refers else None, len(payload) if response else None, named)):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    kind = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"
    found = stored(frames.where(~leading).select("frame").mapInArrow(run, kind), "warc-read")
    sizes = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("_n")).distinct()
    revisits = found.where("record_type = 'revisit'").drop("payload_bytes").join(sizes, ["refers_to", "payload_digest"], "left").withColumnRenamed("_n", "payload_bytes")
    return found.where("record_type = 'response'").unionByName(revisits)


def query(pages: DataFrame) -> DataFrame:
    """Write a record for every row of pages into archives, read these back, and return a row for each record.

    Null and repeated page_ids, null html and empty tables are taken as write() does. Extra columns are not used.
    """
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
