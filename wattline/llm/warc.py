"""WARC archives with revisit records in place of repeated payloads."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, create, file_system, new_folder, reliable, table

# Payloads under this many bytes are always written in full.
LEAST_BYTES = 100
FILE_BYTES = 256 << 20
# Fixed values of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
_WRITTEN = "path string, records long, size long"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def resolve(rows: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Adds refers_to, refers_row and refers_url to header rows (row, node, page_id, url, digest, payload_bytes): the original response
    of each later copy, else null.

    Headers alone are shuffled by digest. Of equal payloads the smallest page_id (null last; the first row of
    those that share it) is the original; a digest of a third of all pages is joined by node and digest."""
    large = rows.filter(F.col("payload_bytes") >= least_bytes)
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", "url"))
    originals = large.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "digest", F.col("first.page_id").alias("refers_to"), F.col("first.row").alias("refers_row"), F.col("first.url").alias("refers_url"))
    joined = attach(rows, originals, ["digest"])
    later = (F.col("payload_bytes") >= least_bytes) & (F.col("refers_row") != F.col("row"))
    return joined.select(*rows.columns, *[F.when(later, F.col(c)).alias(c) for c in ("refers_to", "refers_row", "refers_url")])


def _record_id(page_id, row) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{row}')}>"


def _one_line(value) -> str:
    return " ".join(str(value).split())


def record(row: dict) -> bytes:
    """One WARC record with fresh headers, as a gzip member of its own."""
    revisit = row["refers_row"] is not None
    block = HTTP_HEAD if revisit else HTTP_HEAD + row["payload"]
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_id(row["page_id"], row["row"]), "WARC-Date": DATE}
    if row["url"] is not None:
        head["WARC-Target-URI"] = _one_line(row["url"])
    if row["page_id"] is not None:
        head["X-Page-Id"] = row["page_id"]
    head |= {"WARC-Payload-Digest": f"sha256:{row['digest']}", "X-Payload-Length": row["payload_bytes"]}
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(row["refers_to"], row["refers_row"]), "WARC-Refers-To-Date": DATE}
        if row["refers_url"] is not None:
            head["WARC-Refers-To-Target-URI"] = _one_line(row["refers_url"])
        if row["refers_to"] is not None:
            head["X-Refers-To-Page-Id"] = row["refers_to"]
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def _writer(folder: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, stream, path, n, size = TaskContext.get(), 0, None, "", 0, 0

        def done():
            stream.close()
            return pa.RecordBatch.from_pylist([{"path": path, "records": n, "size": size}])

        for batch in batches:
            for k in range(batch.num_rows):
                if stream is None:
                    # a new name for each attempt: a repeated task leaves no mixed file
                    path = f"{folder}/pages-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.gz"
                    stream, n, size, number = create(path), 0, 0, number + 1
                data = record(batch.slice(k, 1).to_pylist()[0])
                stream.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    yield done()
                    stream = None
        if stream is not None:
            yield done()

    return write


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes every row as a WARC record in UTF-8 and returns the manifest (path, records, size) of the files that count.

    A null payload is empty; null identifiers and URLs have no header. A file of a lost or repeated attempt is
    not in the manifest. An empty table writes no file."""
    plain = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    held = reliable(plain.withColumn("row", F.monotonically_increasing_id()).withColumn("node", F.shiftright("row", 33))
                    .withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long")))
    later = resolve(held.drop("payload"), least_bytes).filter("refers_row is not null").select("row", "refers_to", "refers_row", "refers_url")
    whole = held.join(later, "row", "left").select("row", "page_id", "url", "digest", "payload_bytes", "refers_to", "refers_row", "refers_url",
                                                   F.when(F.col("refers_row").isNull(), F.col("payload")).alias("payload"))
    return reliable(whole.mapInArrow(_writer(folder, file_bytes), _WRITTEN))


def records(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of an open archive, one at a time."""
    lines = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    while True:
        line = lines.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := lines.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        block = lines.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("the archive ends within a record")
        yield head, block


def _entry(head: dict, block: bytes) -> dict:
    revisit = head["warc-type"] == "revisit"
    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
    number = lambda key: int(head[key]) if key in head else None
    digest = head["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
    if not revisit and f"sha256:{digest}" != head["warc-payload-digest"]:
        raise ValueError("a payload differs from its digest")
    return {"page_id": number("x-page-id"), "url": head.get("warc-target-uri"), "payload_bytes": number("x-payload-length") if revisit else len(payload),
            "payload_digest": digest, "record_type": head["warc-type"], "refers_to": number("x-refers-to-page-id"), "payload": payload}


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, name = file_system(path)
            rows, size = [], 0
            with store.open_input_stream(name) as stream:
                for head, block in records(stream):
                    rows.append(_entry(head, block))
                    size += len(block)
                    if size > 4 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the manifest's files: page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for a revisit)."""
    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(_reader, _READ)


def op6(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, case when payload_bytes >= {LEAST_BYTES} then min(page_id) over (partition by payload_digest) else page_id end as first_id from p)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to
from f
"""
