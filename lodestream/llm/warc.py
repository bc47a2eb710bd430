"""WARC archives without repeated payloads: writing, reading and revisit resolution.

Payload digests of headers are grouped; of equal payloads one record keeps the
payload as a response and the others become revisit records that refer to it.
Archives are written by the JVM's text writer, a record a row, to any file
system that Spark can write to; they are read back as whole files and parsed by
Content-Length. Revisit records are then resolved by a join of headers on the
payload digest.
"""

from __future__ import annotations

import gzip
import hashlib
import math
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.scratch import hadoop, new_path, save
from lodestream.llm.words import lean

#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 100
#: Records of an archive, and bytes of payload that they may have together: files are read whole.
FILE_RECORDS, FILE_BYTES = 1000, 256 << 20
#: Copies of a payload from which on it is met by a broadcast, as a number and as a share of all pages.
HOT_PAGES, HOT_SHARE = 1000, 1e-3
#: Records that are handed on together.
PARSED_ROWS = 100
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "record_id string, record_type string, page_id long, uri string, digest string, refers_to_id string, payload_bytes long, payload_digest string"
SCHEMA = HEADERS + ", payload binary"


def _record_id(row: Column, salt: str) -> Column:
    h = F.sha2(F.concat(F.lit(salt + ":"), row.cast("string")), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h[0:8], h[8:4], F.concat(F.lit("4"), h[13:3]), F.concat(F.lit("8"), h[17:3]), h[20:12]), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line; none if the value is null. Control characters cannot end a line early."""
    clean = F.regexp_replace(value.cast("string"), r"[\x00-\x20\x7F]", "%20") if name == "WARC-Target-URI" else value.cast("string")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(END)), F.lit(""))


def classify(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, url, payload) with row, digest, size and the row that holds the payload.

    Of equal payloads of least_bytes or more, the record with the least page_id
    is the holder; null ids come last, and of rows with the same id any one is.
    """
    base = pages.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.sha2(F.col("payload"), 256)).withColumn("size", F.octet_length("payload").cast("long"))
    base = save(base, "warc-pages")
    same = base.where(F.col("size") >= least_bytes).groupBy(F.col("digest").alias("_of")).agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.min_by("row", "page_id"), F.min("row")).alias("_holder"))
    same = save(same.where("_n > 1"), "warc-digests")
    bound = max(HOT_PAGES, math.ceil(base.count() * HOT_SHARE))
    hot = F.broadcast(same.where(F.col("_n") >= bound).drop("_n"))  # at most 1 / HOT_SHARE rows
    match = F.col("digest") == F.col("_of")
    rest = base.join(hot, match, "left_anti").join(same.where(F.col("_n") < bound).drop("_n"), match, "left")
    held = rest.unionByName(base.join(hot, match))
    return held.withColumn("holder", F.when(F.col("size") >= least_bytes, F.coalesce("_holder", F.col("row"))).otherwise(F.col("row"))).drop("_of", "_holder")


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES, date: datetime | None = None) -> None:
    """Write a record for every page, with fresh headers, into packed archives; null html is an empty payload.

    A null page_id or url has no header. Equal payloads are stored once; repeated
    rows each have a record. Archives have at most so many records and bytes of
    payload, but for a single larger payload: pages fall into classes by size,
    each with its own number of records. Other columns are ignored; without pages
    there is no record and no folder.
    """
    rows = classify(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload")))
    stamp = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit, salt = F.col("row") != F.col("holder"), path
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1" + END),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _record_id(F.col("row"), salt)),
        _header("WARC-Date", F.lit(stamp)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(revisit, _record_id(F.col("holder"), salt))),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("X-Page-ID", F.col("page_id")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block)),
        F.lit(END),
    )
    # The writer ends every row with the two empty lines that end a record.
    held = F.when(revisit, 0).otherwise(F.col("size"))
    lines = rows.select(F.concat(head, block).alias("value"), held.alias("held"))
    most = (records, max(1, records // 30), 1)
    of_class = F.when(held <= file_bytes // most[0], 0).when(held <= file_bytes // most[1], 1).otherwise(2)
    for i in sorted(r[0] for r in rows.select(of_class).distinct().collect()):  # at most three
        part = lines.where(F.when(F.col("held") <= file_bytes // most[0], 0).when(F.col("held") <= file_bytes // most[1], 1).otherwise(2) == i).select("value")
        part.write.mode("append").option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", most[i]).text(path)


def parse(data: bytes) -> Iterator[tuple]:
    """The records of an archive, by Content-Length."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        stop = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:stop].decode().split(END)[1:])
        block = memoryview(data)[stop + 4 : stop + 4 + int(head["Content-Length"])]
        at = stop + 4 + len(block) + 4
        body = bytes(block)
        payload = body[body.index(b"\r\n\r\n") + 4 :]
        page = head.get("X-Page-ID")
        kind = head["WARC-Type"]
        own = kind != "revisit"
        yield (
            head["WARC-Record-ID"],
            kind,
            int(page) if page is not None else None,
            head.get("WARC-Target-URI"),
            head["WARC-Payload-Digest"].removeprefix("sha256:"),
            head.get("WARC-Refers-To"),
            len(payload) if own else None,
            hashlib.sha256(payload).hexdigest() if own else None,
            payload if own else None,
        )


def _parse_files(schema: str):
    """Archives, packed or not, as records; without the payload where the schema has none."""
    names = [f.split()[0] for f in schema.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(0)[i].as_py()
                data = gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data
                rows: list[tuple] = []
                for record in parse(data):
                    rows.append(record[: len(names)])
                    if len(rows) == PARSED_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record under path: its headers, the size and digest of its payload, and the payload unless it is not asked for.

    A file is one task's to read, with the memory of its bytes; a folder without
    archives has no record.
    """
    schema = SCHEMA if payloads else HEADERS
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lean(_parse_files(schema)), schema)


def resolve(records: DataFrame) -> DataFrame:
    """Headers of all records, revisits with the payload's facts from the response they refer to.

    A revisit is joined to its response on the payload digest and the record's
    id; one whose response is missing keeps nulls. A null page_id or uri stays
    null; repeated pages each have a row; columns beyond the headers are left out.
    Without records the result is empty.
    """
    heads = records.drop("payload")
    held = heads.where("record_type = 'response'").select(F.col("digest").alias("_d"), F.col("record_id").alias("_id"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_sha"))
    again = heads.where("record_type = 'revisit'").join(held, (F.col("digest") == F.col("_d")) & (F.col("refers_to_id") == F.col("_id")), "left")
    again = again.select("record_id", "record_type", "page_id", "uri", F.col("_bytes").alias("payload_bytes"), F.col("_sha").alias("payload_digest"), F.col("_page").alias("refers_to"))
    first = heads.where("record_type <> 'revisit'").select("record_id", "record_type", "page_id", "uri", "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(again)


def archive_round_trip(pages: DataFrame, **names: str) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back and resolve them.

    One row per page: record_id, record_type, page_id, uri, payload_bytes,
    payload_digest and refers_to. Null html is an empty payload, a null id or url
    stays null; repeated rows each have a record, of which one holds the payload;
    other columns of pages are ignored, whatever their names. Without pages the
    result is empty.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, **names)
    system_path, system = hadoop(pages.sparkSession, path)
    system.mkdirs(system_path)
    return resolve(save(read_archives(pages.sparkSession, path, payloads=False), "warc-heads"))
