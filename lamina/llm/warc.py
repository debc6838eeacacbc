"""Dictionary-compressed WARC archives.

Each partition becomes archives of at most ARCHIVE_BYTES and ARCHIVE_ROWS: a Zstandard
dictionary is built from the records that the archive starts with (SAMPLE_BYTES of them,
SAMPLE_RECORD of each at most, so from eight records at least if it has them), embedded
in a leading skippable frame (magic 0x184D2A5D), and every record, the warcinfo first, is
compressed alone with it, so any record can be read by its offset. The dictionary is
trained; where the records are too few or too short for that, it is the beginning of what
they hold. Spark's own writer commits the files, on any file system that Spark knows and
with its task-attempt protocol: the text format writes the frames' bytes as they are, and
the separator between rows is an empty skippable frame, so that each file is a valid
Zstandard stream. It rolls over to the next file after ARCHIVE_ROWS rows; an archive that
is full before by its bytes is filled up with empty rows. Its files end in .txt.

Records with equal payloads: the one with the smallest page_id is a response, the
others are revisits of it. Only (digest, smallest id) of groups of two or more is
joined to the pages; it is combined before the shuffle and broadcast when its
counted rows allow it, so a hot payload lands in no single task.

Defined results: null html is an empty payload; a null page_id is kept, ranks after
all others and is written without an id; rows that repeat both the smallest page_id
and its payload are all responses; a null url is left out of the record; an empty
table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, ship_package, sized

DICT_BYTES = 1 << 16
SAMPLE_BYTES = 1 << 22
SAMPLE_RECORD = SAMPLE_BYTES // 8
SEGMENT = 1024
ARCHIVE_BYTES, ARCHIVE_ROWS = 1 << 26, 1 << 14
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # archives don't depend on when they are written
#: An empty skippable frame, as the text writer's line separator: all its bytes are ASCII.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
DICT_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def record_id(page_id: int | None) -> str:
    x = f"{(0 if page_id is None else page_id) & (1 << 64) - 1:016x}"
    known = "0" if page_id is None else "1"
    return f"<urn:uuid:0000000{known}-0000-4000-{x[:4]}-{x[4:]}>"


def page_of(record: str) -> int | None:
    h = record.strip("<>").removeprefix("urn:uuid:").replace("-", "")
    x = int(h[16:], 16)
    return None if h[7] == "0" else x - (1 << 64) if x >> 63 else x


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + record_id(page_id).encode(),
        f"WARC-Date: {DATE}".encode(),
        f"WARC-Payload-Digest: {digest}".encode(),
        f"X-Payload-Length: {len(payload)}".encode(),
    ]
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode())
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        head += [f"WARC-Profile: {PROFILE}".encode(), b"WARC-Refers-To: " + record_id(refers_to).encode()]
        block += b"\r\n"
    else:
        block += f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    head += [b"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record() -> bytes:
    """The record that an archive starts with."""
    block = b"format: WARC File Format 1.1\r\n"
    head = [b"WARC/1.1", b"WARC-Type: warcinfo", b"WARC-Record-ID: <urn:uuid:00000002-0000-4000-0000-000000000000>", f"WARC-Date: {DATE}".encode(), b"Content-Type: application/warc-fields", f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple | None:
    """A record's row of RECORDS, None for the warcinfo; checks a response's payload
    against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    kind = fields[b"WARC-Type"].decode()
    if kind == "warcinfo":
        return None
    digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    block = rest[: int(fields[b"Content-Length"])]
    payload = None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {fields[b'WARC-Record-ID'].decode()} differs from its digest")
    url, refers = fields.get(b"WARC-Target-URI"), fields.get(b"WARC-Refers-To")
    return page_of(fields[b"WARC-Record-ID"].decode()), url.decode() if url is not None else None, int(fields[b"X-Payload-Length"]), digest, kind, page_of(refers.decode()) if refers else None, payload


def build_dictionary(records: list[bytes]) -> zstd.ZstdCompressionDict | None:
    """A dictionary of at most an eighth of the records' bytes; none of under 64 bytes."""
    cut = [r[:SAMPLE_RECORD] for r in records]
    size = min(DICT_BYTES, sum(map(len, cut)) // 8)
    if size < 8:
        return None
    if len(cut) >= 8 and size >= SEGMENT:
        try:
            return zstd.train_dictionary(size, cut, k=SEGMENT, d=8)
        except zstd.ZstdError:
            pass  # records with nothing in common
    return zstd.ZstdCompressionDict(b"".join(cut)[:size], dict_type=zstd.DICT_TYPE_RAWCONTENT)


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive: the dictionary's, if there is one, then one a record."""
    first, size = [], 0
    for r in records:
        first.append(r)
        size += min(len(r), SAMPLE_RECORD)
        if size >= SAMPLE_BYTES:
            break
    trained = build_dictionary(first)
    if trained:
        packed = zstd.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
        yield struct.pack("<II", DICT_MAGIC, len(packed)) + packed
    compressor = zstd.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True) if trained else zstd.ZstdCompressor(level=LEVEL, write_checksum=True)
    for r in first:
        yield compressor.compress(r)
    first.clear()
    for r in records:
        yield compressor.compress(r)


def archives(records: Iterator[bytes], most_bytes: int = ARCHIVE_BYTES, most_rows: int = ARCHIVE_ROWS) -> Iterator[bytes]:
    """The rows of consecutive archives, ``most_rows`` of each but the last."""
    held = next(records, None)
    while held is not None:
        given = size = rows = 0

        def part() -> Iterator[bytes]:
            nonlocal held, given
            yield info_record()
            while held is not None and given < most_rows - 2 and (size < most_bytes or not given):
                given += 1
                out, held = held, next(records, None)
                yield out

        for f in frames(part()):
            size += len(f)
            rows += 1
            yield f
        while held is not None and rows < most_rows:
            rows += 1
            yield b""


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, by its block headers."""
    top = bytes(data[at : at + 18])
    end = at + zstd.frame_header_size(top)
    last = False
    while not last:
        h = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = bool(h & 1), h >> 1 & 3, h >> 3
        end += 3 + (1 if kind == 1 else size)
    return end + (4 if zstd.get_frame_parameters(top).has_checksum else 0)


def records(content: bytes) -> Iterator[bytes]:
    """The records of one archive."""
    data, at, reader = memoryview(content), 0, zstd.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic >> 4 == 0x184D2A5:
            if magic == DICT_MAGIC and at == 0:
                dictionary = zstd.ZstdDecompressor().decompress(data[8 : 8 + size])
                reader = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(dictionary))
            at += 8 + size
        elif magic == 0xFD2FB528:
            end = frame_end(data, at)
            yield reader.decompress(data[at:end])
            at = end
        else:
            # the text writer ends a file with a separator; anything else is damage
            raise ValueError(f"no frame at byte {at}")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, most_bytes: int = ARCHIVE_BYTES, most_rows: int = ARCHIVE_ROWS) -> None:
    """Write pages (page_id, url, html) as archives under path. Payloads of under
    min_bytes bytes are never revisits."""
    ship_package(pages.sparkSession)
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"), F.sha1(body).alias("sha1"))
    groups = p.where(F.octet_length("body") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.where("n > 1 and first_id is not null").select("sha1", "first_id"), "payloads")
    rows = p.join(sized(groups), "sha1", "left").withColumn("revisit", F.expr("first_id is not null and not (page_id <=> first_id)"))
    rows = rows.select("page_id", "url", "body", "sha1", "first_id", "revisit")

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def every() -> Iterator[bytes]:
            for part in parts:
                for page_id, url, html, sha1, first, revisit in part.astype(object).itertuples(index=False):
                    none = lambda x: None if pd.isna(x) else int(x)
                    yield record(none(page_id), url if isinstance(url, str) else None, bytes(html), sha1, none(first), bool(revisit))

        out, size = [], 0
        for f in archives(every(), most_bytes, most_rows):
            out.append(f)
            size += len(f)
            if size > 1 << 22:
                yield pd.DataFrame({"value": out})
                out, size = [], 0
        if out:
            yield pd.DataFrame({"value": out})

    ids = rows.withColumns({"page_id": F.col("page_id").cast("string"), "first_id": F.col("first_id").cast("string")})  # longs with nulls would become floats
    ids.mapInPandas(pack, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", most_rows).text(path)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of all archives under path, as RECORDS; without their payloads
    unless asked for. A file is read whole: its size is bounded when it is written."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                rows, size = [], 0
                for r in filter(None, map(parse, records(bytes(content)))):
                    rows.append(r if payload else (*r[:-1], None))
                    size += len(r[-1] or b"") if payload else 200
                    if size > 1 << 22:
                        yield frame(rows)
                        rows, size = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names, dtype=object)
        return out.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    out = files.mapInPandas(unpack, RECORDS)
    return out if payload else out.drop("payload")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha1(coalesce(html, '')) h from pages),
g as (select h, min(page_id) first_id, count(*) n from p group by h),
a as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' s)
select page_id, cast(payload_bytes as bigint) payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr(s, 1 + cast((cast('0x' || substr(h, 1 + 10 * (i // 8), 10) as bigint) >> (35 - 5 * (i % 8))) & 31 as integer), 1)), 'string_agg', '') payload_digest,
  case when page_id is not distinct from first_id or n = 1 then 'response' else 'revisit' end record_type,
  case when page_id is not distinct from first_id or n = 1 then null else first_id end refers_to
from p join g using (h), a
"""
