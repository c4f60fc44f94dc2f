"""WARC archives with revisits resolved.

write(): the captures' headers (id, URL, payload digest and length, never the payload) are grouped by digest; of equal
payloads of at least `least` bytes the one of the smallest page_id is kept as a response and the others become revisits
that refer to it. Each task then writes one archive of its captures with fresh headers, under a name of its own, and
moves it to its final name when it is whole, so a task that is run again leaves no half file and no second copy.
read(): parses the archives, resolves every revisit against its response, and returns what was stored.

Edge cases: a null html is an empty payload; payloads shorter than `least` are all responses; captures that share the
smallest page_id of a digest are all responses; a null page_id comes after all others (only if every copy lacks one does
such a capture stay a response); a null URL is written as an empty field; an empty table writes no archive.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, shared_dir

#: Payloads below this many bytes aren't worth a revisit record.
LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, records long, file_bytes long"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def decided(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes, refers_to (null: a response).

    Only digests and ids are shuffled to decide, pre-aggregated to one row a digest; a digest that a third of all pages
    share is one row on the small side of the join, and AQE splits its run on the large side.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    heads = pages.where(F.col("payload_bytes") >= least).select("payload_digest", "page_id")
    # Only digests that occur again matter: all others stay responses without a join partner.
    first = heads.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    pages = pages.join(first.select("payload_digest", "first_id"), "payload_digest", "left")
    return pages.select("page_id", "url", "html", "payload_digest", "payload_bytes", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def _record(page_id: int | None, url: str | None, html: str | None, digest: str, size: int, refers: int | None) -> bytes:
    name = "null" if page_id is None else str(page_id)
    kind = "response" if refers is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (html or "").encode() if refers is None else http
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    heads = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers is not None:
        heads[3:3] = [f"WARC-Refers-To: <urn:x-page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(heads).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _writer(folder: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pafs.FileSystem.from_uri(folder)
        final = f"{path}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        part, out, records, size = f"{path}/_writing-{uuid.uuid4().hex}", None, 0, 0
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(k)) for k in ("page_id", "url", "html", "payload_digest", "payload_bytes", "refers_to")]
            for i in range(batch.num_rows):
                # One gzip member a record, so that a reader can start at any of them.
                member = gzip.compress(_record(*(c[i].as_py() for c in cols)), level, mtime=0)
                out = out or files.open_output_stream(part)
                out.write(member)
                records, size = records + 1, size + len(member)
        if out:
            out.close()
            files.move(part, final)
            yield pa.RecordBatch.from_pydict({"file": [final], "records": [records], "file_bytes": [size]})

    return write


def write(pages: DataFrame, folder: str, least: int = LEAST_BYTES, level: int = 6) -> DataFrame:
    """Writes the archives into `folder` (a URI all executors reach) and returns their manifest, which is stored beside them."""
    files, path = pafs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    manifest = mapped(decided(pages, least), _writer(folder, level), MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record; raises ValueError on a broken one."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        heads: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode().partition(":")
            heads[key.strip().lower()] = value.strip()
        size = int(heads["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends early")
        yield heads, block


def _page(urn: str | None) -> int | None:
    tail = (urn or "").rpartition(":")[2].rstrip(">")
    return int(tail) if tail not in ("", "null") else None


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        for name in batch.column(0).to_pylist():
            files, path = pafs.FileSystem.from_uri(name if "://" in name else f"file://{name}")
            rows: list[tuple] = []
            held = 0
            with files.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) as stream:
                for heads, block in parse(stream):
                    payload = block.partition(b"\r\n\r\n")[2] if heads["warc-type"] == "response" else None
                    digest = heads["warc-payload-digest"].removeprefix("sha256:")
                    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{name}: the payload of {heads['warc-record-id']} doesn't match its digest")
                    size = len(payload) if payload is not None else int(heads["x-payload-length"])
                    rows.append((_page(heads["warc-record-id"]), heads["warc-target-uri"], heads["warc-type"], digest, size, _page(heads.get("warc-refers-to")), payload))
                    held += len(payload or b"") + 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives that the manifest in `folder` names; responses' payloads are checked against their digests."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return mapped(manifest.select("file").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file"), _reader, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """Records with each revisit's digest and length held against its response's; a revisit without one fails the job."""
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"), F.col("payload_bytes").alias("r_bytes")).dropDuplicates()
    revisits = records.where("record_type = 'revisit'").drop("payload")
    # Spark takes the archives for as small as their manifest, and would broadcast them
    joined = revisits.join(responses.hint("merge"), (F.col("refers_to") == F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")), "left")
    whole = joined.select("page_id", "url", "record_type", "payload_digest", F.coalesce("r_bytes", F.raise_error(F.lit("a revisit refers to no response"))).cast("long").alias("payload_bytes"), "refers_to")
    return records.where("record_type = 'response'").drop("payload").select(*whole.columns).unionByName(whole)


def archive_folder(spark: SparkSession) -> str:
    base = shared_dir(spark)
    return f"{base if '://' in base else 'file://' + base.removeprefix('file:')}/warc-{uuid.uuid4().hex}"
