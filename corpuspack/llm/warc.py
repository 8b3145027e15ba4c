"""WARC archives compressed record by record with a dictionary of their own, written and read back.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built from records of
that archive; each record follows as a frame of its own, so that any of them can be read by its offset. The file is
complete by itself. Of pages with equal payloads, that with the smallest page_id is stored as a response; the others
are revisits that refer to it and store headers only.

Archives are dealt out by a hash of the page: an archive takes about ARCHIVE_BYTES of payload. Each is written under a
temporary name and then renamed, under a name that only depends on its number, so a task that runs again leaves the same file.

A null html counts as empty. Null url: no WARC-Target-URI. Rows that repeat a page_id: one of them is the response,
the others revisit it if their payloads are equal; a null page_id sorts before any other and reads back as null.
Payloads of any length are stored whole. Other columns aren't used. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from math import ceil

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.llm.common import batches_of, rows_of
from corpuspack.session import checkpoint_dir

#: Payload that an archive holds, about.
ARCHIVE_BYTES = 4 << 20
#: Bytes of a dictionary, and of the records it is built from at most.
DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 10, 1 << 20
LEVEL = 6

#: Fixed values of the format.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, which names the payload's length."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        # a line break would end the header
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of a sample of the records, or none where they are too few to learn from."""
    sample, size = [], 0
    step = max(1, len(records) // 512)
    for one in records[::step]:
        sample.append(one[: 16 << 10])
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    if len(sample) < 16:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], zstandard.DICT_TYPE_RAWCONTENT) if size >= 8 else None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    """The file's bytes: the dictionary in a skippable frame, then one frame per record."""
    made = build_dictionary(records)
    body = made.as_bytes() if made else b""
    writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=True)
    return struct.pack("<II", SKIPPABLE, len(body)) + body + b"".join(map(writer.compress, records))


def records_of(data: bytes) -> Iterator[bytes]:
    """Records of an archive, one frame at a time."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the start of the archive")
    body = data[8 : 8 + size]
    known = None
    if body:
        trained = body[:4] == struct.pack("<I", 0xEC30A437)
        known = zstandard.ZstdCompressionDict(body, zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    rest = memoryview(data)[8 + size :]
    reader = zstandard.ZstdDecompressor(dict_data=known)
    while len(rest):
        one = reader.decompressobj()
        out = one.decompress(rest)
        yield out
        rest = rest[len(rest) - len(one.unused_data) :]


def parsed(data: bytes) -> dict:
    """Headers of a record by lower-case name, and its payload: None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    headers = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}
    http, _, payload = rest[: int(headers["content-length"])].partition(b"\r\n\r\n")
    for line in http.decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        headers[f"http-{name.lower()}"] = value
    headers["payload"] = payload if headers["warc-type"] == "response" else None
    return headers


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``folder``; (path, records, bytes) of each.

    Which page of equal payloads is stored is found on narrow rows, by SHA-256. Pages move once, to the archive that
    their hash names; there they meet one row per distinct payload of that archive.
    """
    html = F.coalesce("html", F.lit(""))
    total = pages.agg(F.sum(F.octet_length(html) + 400)).first()[0] or 0
    n_archives = max(1, ceil(total / ARCHIVE_BYTES))
    at = F.pmod(F.xxhash64("page_id", "url", "digest"), F.lit(n_archives)).cast("int")
    dealt = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest")).withColumn("archive", at)
    marks = dealt.select("page_id", "url", "digest", "archive")
    best = F.min(F.struct("page_id", F.coalesce("url", F.lit("")).alias("at"))).alias("best")
    originals = marks.groupBy("digest").agg(best)
    asked = marks.select("archive", "digest").distinct().join(originals, "digest")
    asked = asked.select(
        F.col("archive").alias("home"),
        F.col("digest").alias("payload"),
        F.col("best.page_id").cast("string").alias("original"),
        F.col("best.at").alias("original_at"),
    )

    def work(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        # ids come as text: a null among numbers would make pandas round all of them
        given = lambda x: None if pd.isna(x) else x
        originals = {d: (given(o), u) for d, o, u in zip(known["payload"], known["original"], known["original_at"])}
        # sorted, so that the file is the same whenever the task runs
        part = part.sort_values(["page_id", "url", "digest"], kind="stable", na_position="first")
        stored: set[str] = set()
        records = []
        for page, url, body, digest in part[["page_id", "url", "html", "digest"]].itertuples(index=False):
            original, original_at = originals[digest]
            first = (given(page), url or "") == (original, original_at) and digest not in stored
            if first:
                stored.add(digest)
            records.append(record(given(page), url, body.encode(), original, not first))
        path = f"{folder}/archive-{int(part['archive'].iloc[0]):08d}.warc.zst"
        store, name = fs.FileSystem.from_uri(path)
        data = archive(records)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        draft = f"{name.rpartition('/')[0]}/_{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(data)
        store.move(draft, name)
        return pd.DataFrame({"path": [path], "records": [len(records)], "bytes": [len(data)]})

    named = dealt.withColumn("page_id", F.col("page_id").cast("string"))
    met = named.groupBy("archive").cogroup(asked.groupBy("home"))
    return met.applyInPandas(work, "path string, records bigint, bytes bigint")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of every record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "archive-*.warc.zst").load(folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for content in batch.column("content"):
                    for one in map(parsed, records_of(content.as_py())):
                        payload = one["payload"]
                        size, digest = int(one["http-content-length"]), one["warc-payload-digest"].removeprefix("sha1:")
                        if payload is not None:
                            # what was stored must be what the header says
                            if (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
                                raise ValueError(f"damaged record {one['warc-record-id']}")
                        refers = one.get("warc-refers-to")
                        yield (
                            _page(one["warc-record-id"]), size, digest, one["warc-type"],
                            _page(refers) if refers else None, one.get("warc-target-uri"), payload,
                        ), len(payload or b"") + 200

        schema = pa.schema(
            [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
             ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
        )
        yield from batches_of(rows(), schema)

    schema = (
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"
    )
    return files.select("content").mapInArrow(work, schema)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, then read all archives back."""
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    written = write_archives(pages, folder).agg(F.sum("records")).first()[0]
    if not written:
        return spark.createDataFrame(
            [],
            "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary",
        )
    return read_archives(spark, folder)
