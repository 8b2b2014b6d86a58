"""WARC archives without repeated payloads.

Headers (ids, urls, digests and lengths, no payloads) are shuffled by payload digest. Of
the records of a digest the one with the smallest page_id is the original; the others
become revisit records that refer to it. Payloads are shuffled once, by record and not
by digest, so a payload that a third of all pages share is no hot group, and what meets
its digest is dealt to many tasks. Each task writes archives of a bounded size, every
record gzipped by itself as the format asks; a table beside them names those that belong
to the result, so what a lost task left behind is never read. Archives are read record
by record.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import store_of
from .common import join_hot, qualified, stored

#: Smaller payloads are always written whole.
LEAST_BYTES = 100
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
EOL = "\r\n"
#: Bytes after which an archive is closed and the next one begun.
ARCHIVE_BYTES = 1 << 28
#: Bytes of payload that are handed on at once by a reader, about.
READ_BYTES = 1 << 24
#: The table of an archive folder that names its archives.
CONTENTS = "contents"


def _header_value(text: Column) -> Column:
    """A url with white space and control characters percent-encoded."""
    for char in ("\t", "\n", "\r", " "):
        text = F.replace(text, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", "%3F")


def _record_id(page_id: Column, url: Column, digest: Column, nth: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), digest, nth.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str, payload: Column, date: str, *more: tuple[str, Column]) -> Column:
    """Text of one record but for the two line ends after it. Fields that are null are left out."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL + EOL))
    block = F.concat(http, payload)
    fields = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", _header_value(F.col("url"))), ("X-Page-Id", F.col("page_id").cast("string")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), *more, ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields]  # null if the value is
    return F.concat(F.concat_ws(EOL, F.lit("WARC/1.0"), *lines), F.lit(EOL + EOL), block)


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) to archives in ``path``.

    A null html is an empty payload. Records with equal payloads of ``least_bytes`` or
    more: the first by page_id (nulls last), then url, is a response, the others are
    revisits of it; of identical rows one is. Smaller payloads are all responses. A
    payload of any length is one record. Other columns are ignored; an empty table gives
    no archives.
    """
    path = qualified(pages.sparkSession, path)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("digest"))
    rows = rows.withColumn("pk", F.xxhash64("page_id", "url", "digest"))
    headers = stored(rows.drop("payload"), "warc-headers")
    place = F.struct(F.isnull("page_id").alias("no_id"), F.col("page_id").alias("id"), F.isnull("url").alias("no_url"), F.col("url").alias("at"))
    originals = headers.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min(place).alias("o"), F.count(F.lit(1)).alias("copies"))
    originals = originals.select("digest", "copies", F.col("o.id").alias("o_id"), F.col("o.at").alias("o_url")).withColumn("o_pk", F.xxhash64("o_id", "o_url", "digest")).withColumn("o_record", _record_id(F.col("o_id"), F.col("o_url"), F.col("digest"), F.lit(1)))
    nth = F.row_number().over(Window.partitionBy("pk", "digest").orderBy(F.lit(0)))
    again = headers.withColumn("nth", nth).withColumn("record_id", _record_id(F.col("page_id"), F.col("url"), F.col("digest"), F.col("nth")))
    originals = stored(originals, "warc-originals")
    revisits = join_hot(again.where(F.col("bytes") >= least_bytes), originals, "digest", F.col("copies"), headers.count()).where((F.col("pk") != F.col("o_pk")) | (F.col("nth") > 1))
    revisit_text = _record("revisit", F.lit(""), date, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", F.col("o_record")), ("WARC-Refers-To-Target-URI", _header_value(F.col("o_url"))))
    large = rows.where(F.col("bytes") >= least_bytes).join(originals.select(F.col("o_pk").alias("pk"), "digest"), ["pk", "digest"], "left_semi").dropDuplicates(["pk", "digest"]).withColumn("record_id", _record_id(F.col("page_id"), F.col("url"), F.col("digest"), F.lit(1)))
    small = rows.where(F.col("bytes") < least_bytes).withColumn("nth", nth).withColumn("record_id", _record_id(F.col("page_id"), F.col("url"), F.col("digest"), F.col("nth")))
    response = _record("response", F.col("payload"), date)
    records = large.select(response.alias("value")).union(small.select(response)).union(revisits.select(revisit_text))
    _write(records, path)


def _write(records: DataFrame, path: str) -> None:
    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = store_of(path)
        store.create_dir(folder, recursive=True)
        name, out, written = None, None, 0
        for b in batches:
            for value in b.column("value"):
                if out is None:
                    name, written = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                member = gzip.compress((value.as_py() + EOL + EOL).encode("utf-8", "surrogatepass"), 6, mtime=0)
                out.write(member)
                written += len(member)
                if written >= ARCHIVE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"archive": [name], "bytes": pa.array([written], pa.int64())})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "bytes": pa.array([written], pa.int64())})

    records.mapInArrow(archives, "archive string, bytes long").write.parquet(f"{path}/{CONTENTS}")


def _parsed(archive: io.IOBase) -> Iterator[dict]:
    """Records of one archive, gzipped or not, read one by one by their Content-Length."""
    archive = io.BufferedReader(archive, 1 << 20)
    stream = gzip.GzipFile(fileobj=archive) if archive.peek(2)[:2] == b"\x1f\x8b" else archive
    with stream as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:60]!r}")
            fields = {}
            while (line := f.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields[name.strip().lower()] = value.strip()
            block = f.read(int(fields["content-length"]))
            http, _, payload = block.partition(b"\r\n\r\n")
            size = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
            page = fields.get("x-page-id")
            kind = fields.get("warc-type")
            yield {"record_id": fields.get("warc-record-id"), "record_type": kind, "page_id": int(page) if page else None, "target_uri": fields.get("warc-target-uri"), "refers_to_id": fields.get("warc-refers-to"), "header_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:"), "http_bytes": size, "payload": payload if kind == "response" else None}


RECORD = "record_id string, record_type string, page_id long, target_uri string, refers_to_id string, header_digest string, http_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for every record of the archives that ``write_archives`` wrote to ``path``.

    Columns: RECORD; payload is null for revisits. An archive is read by one task, in a
    stream, one record at a time.
    """
    path = qualified(spark, path)
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("refers_to_id", pa.string()), ("header_digest", pa.string()), ("http_bytes", pa.int64()), ("payload", pa.binary())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = store_of(path)
        for b in batches:
            for name in b.column("archive").to_pylist():
                out, held = [], 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as archive:
                    for r in _parsed(archive):
                        out.append(r)
                        held += len(r["payload"] or b"")
                        if len(out) == 500 or held > READ_BYTES:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    named = spark.read.schema("archive string, bytes long").parquet(f"{path}/{CONTENTS}")
    count = named.count()
    return named.select("archive").repartition(max(1, count), "archive").mapInArrow(records, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """record_id, page_id, record_type, payload_bytes, payload_digest and refers_to of every record.

    payload_bytes and payload_digest (SHA-256, hex) are of the full payload: a revisit
    has those of the response that it refers to, and refers_to is that response's
    page_id. A revisit without its response keeps what its own header says. No records
    give no rows.
    """
    slim = stored(records.select("record_id", "record_type", "page_id", "refers_to_id", "header_digest", "http_bytes", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest")), "warc-records")
    responses = slim.where("record_type = 'response'")
    found = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("r_bytes"), F.col("digest").alias("r_digest"))
    again = slim.where("record_type = 'revisit'").drop("bytes", "digest")
    often = again.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("copies"))
    revisits = join_hot(again, stored(found.join(often, "refers_to_id"), "warc-referred"), "refers_to_id", F.col("copies"), again.count(), "left")
    whole = responses.select("record_id", "page_id", "record_type", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"))
    return whole.union(revisits.select("record_id", "page_id", "record_type", F.coalesce("r_bytes", "http_bytes"), F.coalesce("r_digest", "header_digest"), "refers_to"))
