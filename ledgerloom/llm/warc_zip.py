"""WARC records in ZIP archives, read in place.

An archive is a ZIP file with stored (uncompressed) members: `archive/data.warc.gz`, a WARC file with a gzip
member for each record, and `indexes/index.cdxj`, a line for each record with its place in that file. Because
members are stored, a record's bytes lie at a known place of the archive: the reader parses the end record,
the ZIP64 records if there are any and the central directory, reads the index, and fetches ranges of records
without extracting anything.

Cases: null html is an empty payload; a null url gives the record's urn as target; rows without a page_id take
no part; of records with equal payloads (MIN_REVISIT bytes or more) those with the largest page_id are
responses and the others revisit it, so that rows that repeat that page_id are all responses; columns other
than page_id, url and html are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_REVISIT = 0
#: Bytes of neighbouring records that one range read fetches.
RANGE_BYTES = 1 << 20
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without the payload; its own gzip member."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    urn = f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{urn}>",
        "WARC-Target-URI": quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else urn,
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    block = http + payload
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        block = http
    head["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(data: bytes) -> dict:
    """Fields of one uncompressed record; a response's payload is held against its digest and length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload isn't what its digest says")
    number = lambda name: int(fields[name].rpartition(":")[2].rstrip(">")) if name in fields else None
    return {"page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": payload if fields["WARC-Type"] == "response" else None}


# The directory of a ZIP file


def _zip64(extra: bytes, size: int, packed: int, offset: int) -> tuple[int, int, int]:
    """The true sizes and offset: those that are all ones stand in the ZIP64 extra field, in this order."""
    while len(extra) >= 4:
        tag, n = struct.unpack_from("<HH", extra)
        if tag == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
            full = 0xFFFFFFFF
            return (next(values) if size == full else size), (next(values) if packed == full else packed), (next(values) if offset == full else offset)
        extra = extra[4 + n :]
    return size, packed, offset


def directory(file) -> dict[str, dict]:
    """Members by name, from the central directory; file has size(), seek() and read()."""
    total = file.size()
    tail_at = max(0, total - (1 << 16) - 22 - 20)
    file.seek(tail_at)
    tail = file.read(total - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a central directory: not a ZIP archive")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        file.seek(struct.unpack_from("<Q", tail, end - 12)[0])
        far = file.read(56)
        if far[:4] != b"PK\x06\x06":
            raise ValueError("a ZIP64 locator that leads nowhere")
        count, length, at = struct.unpack_from("<QQQ", far, 32)
    file.seek(at)
    data, found, p = file.read(length), {}, 0
    for _ in range(count):
        if data[p : p + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        method, crc, packed, size, n, extra, note, offset = struct.unpack_from("<10xH4xIIIHHH8xI", data, p)
        name = data[p + 46 : p + 46 + n].decode("utf-8", "replace")
        size, packed, offset = _zip64(data[p + 46 + n : p + 46 + n + extra], size, packed, offset)
        found[name] = {"method": method, "crc": crc, "packed": packed, "size": size, "header": offset}
        p += 46 + n + extra + note
    return found


def start_of(file, member: dict) -> int:
    """Where a stored member's bytes begin: behind its local header, whose name and extra field may differ in length."""
    if member["method"] != zipfile.ZIP_STORED:
        raise ValueError("only stored members can be read in place")
    file.seek(member["header"])
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("a broken local header")
    return member["header"] + 30 + sum(struct.unpack_from("<HH", head, 26))


# Spark


def _write_archive(uri: str, records: Iterator[tuple[int, bytes]]) -> int:
    """One archive, under its last name only when whole; returns its number of records."""
    system, path = pafs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    index, at = [], 0
    with system.open_output_stream(f"{path}.part") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(WARC, "w", force_zip64=True) as member:
            for page_id, data in records:
                member.write(data)
                index.append(json.dumps({"page_id": page_id, "offset": at, "length": len(data)}, separators=(",", ":")))
                at += len(data)
        z.writestr(INDEX, "\n".join(index))
    system.move(f"{path}.part", path)
    return len(index)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages as archives under folder, a URI that all executors share: a row (archive, records) for each.

    Every task writes an archive of its own name; the names that the finished tasks return are kept in a
    table, so that what a lost or repeated task left behind is never read. What a record refers to is found from page
    ids and digests alone; the html is then shuffled once, by page, so that many copies of a page are no hot key.
    """
    rows = pages.filter(F.col("page_id").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    narrow = rows.filter(F.octet_length("html") >= MIN_REVISIT).select("page_id", "digest")
    # written, so that both sides of the join are plain exchanges, which Spark may split where a digest is hot
    same = common.staged(narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).filter("refers_to > low").drop("low"))
    again = narrow.join(same, "digest").filter("page_id < refers_to").distinct()
    rows = rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = (x for x in batches if len(x))
        first = next(batches, None)
        if first is None:
            return

        def records() -> Iterator[tuple[int, bytes]]:
            for batch in itertools.chain([first], batches):
                yield from each(batch)

        def each(batch: pd.DataFrame) -> Iterator[tuple[int, bytes]]:
            for page_id, url, html, to in zip(batch.page_id, batch.url, batch.html, batch.refers_to, strict=True):
                yield int(page_id), record(int(page_id), url, html.encode(), None if pd.isna(to) else int(to))

        uri = f"{folder}/pages-{uuid.uuid4().hex}.zip"
        yield pd.DataFrame({"archive": [uri], "records": [_write_archive(uri, records())]})

    return common.staged(rows.mapInPandas(write, "archive string, records long"), f"{folder}/names")


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches of neighbouring records of about RANGE_BYTES, from each archive's directory and index."""
    for batch in batches:
        for uri in batch.archive:
            system, path = pafs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as file:
                members = directory(file)
                base = start_of(file, members[WARC])
                file.seek(start_of(file, members[INDEX]))
                index = file.read(members[INDEX]["size"])
            if zlib.crc32(index) != members[INDEX]["crc"]:
                raise ValueError(f"{uri}: a broken index")
            out, lengths, at = [], [], 0
            for line in index.splitlines():
                x = json.loads(line)
                if lengths and sum(lengths) + x["length"] > RANGE_BYTES:
                    out.append((uri, base + at, lengths))
                    lengths = []
                if not lengths:
                    at = x["offset"]
                lengths.append(x["length"])
            if lengths:
                out.append((uri, base + at, lengths))
            yield pd.DataFrame(out, columns=["archive", "at", "lengths"])


_FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for uri, at, lengths in zip(batch.archive, batch["at"], batch.lengths, strict=True):
            system, path = pafs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as file:
                file.seek(int(at))
                data = memoryview(file.read(int(sum(lengths))))
            out, p = [], 0
            for n in map(int, lengths):
                out.append(parse_record(gzip.decompress(data[p : p + n])))
                p += n
            yield pd.DataFrame(out).astype({"refers_to": "Int64"})


def read_records(archives: DataFrame) -> DataFrame:
    """Every record of the archives, the payload of responses included; stretches of records are dealt out evenly."""
    n = common.partitions(archives.sparkSession)
    return archives.select("archive").repartition(n).mapInPandas(_ranges, "archive string, at long, lengths array<long>").repartition(n).mapInPandas(_read, _FIELDS)


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(common.table(spark, sf_dir, "pages"), common.shared_dir(spark))
    return read_records(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of the 160 bits: each five hex digits are four of its digits.
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
     d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h FROM p),
     t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::INT) >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top > page_id THEN top END AS refers_to
FROM t
"""
