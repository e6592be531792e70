"""WARC archives: records written with an index beside them, read again by coalesced byte ranges.

Writing: one archive of gzip members per task in the shared folder, each record a member, so that any record can be read
alone. The index has a row per record (archive, offset, length, url, digest, page id) and is written as Parquet once the
archives are complete: it names the archives of the attempts that succeeded, so files of lost or repeated attempts are
never read. Reading: the index rows asked for are sorted by archive and offset, ranges that lie within `gap` bytes of each
other become one read of at most `span` bytes, and tasks are dealt by span, not by archive.

Equal payloads of `min_revisit` bytes or more are stored once: the row with the largest page_id is a response, the others
are revisit records that name it. The digests are grouped without payloads (map-side aggregation: one row a digest and
task), so a payload that a third of all pages share is no large group.

Archives go through pyarrow's filesystems (file, hdfs, s3, gs), as the shared folder must be open to executors.

Defined results: a null payload is empty; a very long one is a record like others; a null url is an empty target; a null page_id is never the largest (if no row of
a group has an id, all are responses); rows that repeat both id and payload are alike: all are what the id is. Extra
columns are not written. An empty table makes no archive and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import bound_batches, materialize, new_folder
from panelspark.operators.spread import BROADCAST_ROWS, sized_join

MIN_REVISIT = 1000
GAP, SPAN = 64 << 10, 8 << 20
#: Archive bytes that a reading task is dealt: index rows are too small for Spark to tell the work from their size.
TASK_BYTES = 32 << 20
INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_DATE = "1970-01-01T00:00:00Z"  # records carry no time of their own


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record, its block being the payload (response) or nothing (revisit)."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {len(payload)}"]
    block = payload if kind == "response" else b""
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def parse(raw: bytes) -> dict:
    """What record() was given, read from its bytes; the payload of a revisit is null. The digest of a payload that is there
    is computed from it and must be the recorded one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    size = int(fields["Content-Length"])
    if first != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not one whole WARC record")
    response = fields["WARC-Type"] == "response"
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    payload = rest[:size] if response else None
    if response and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} has another digest")
    return {"page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": len(payload) if response else int(fields["X-Payload-Length"]),
            "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": None if response else _page(fields["WARC-Refers-To"]), "payload": payload}


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = pafs.FileSystem.from_uri(folder)
    path, out, at = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0
    for batch in batches:
        rows = {k: [] for k in ("archive", "offset", "length", "url", "digest", "page_id", "record_type")}
        for page_id, url, html, digest, refers in zip(*(batch.column(i) for i in range(5))):
            kind = "revisit" if refers.is_valid else "response"
            pack = zlib.compressobj(3, zlib.DEFLATED, 31)
            payload = html.as_buffer().to_pybytes() if html.is_valid else b""
            member = pack.compress(record(page_id.as_py(), url.as_py(), payload, digest.as_py(), kind, refers.as_py())) + pack.flush()
            out = out or fs.open_output_stream(path, compression=None)
            out.write(member)
            for k, v in zip(rows, (path, at, len(member), url.as_py(), digest.as_py(), page_id.as_py(), kind)):
                rows[k].append(v)
            at += len(member)
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([
            ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())]))
    if out:
        out.close()


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT) -> str:
    """Write pages as archives under folder, then their index; returns the path of the index."""
    spark = pages.sparkSession
    bound_batches(spark)
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    # who revisits whom is decided on narrow rows; payloads move only if the revisits are too many to broadcast
    slim = materialize(rows.select("page_id", "digest", F.length("payload").alias("bytes")).filter(F.col("bytes") >= min_revisit).drop("bytes"), "warc-slim")
    largest = slim.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).filter("n > 1 and largest is not null").select("digest", "largest")
    largest = materialize(largest, "warc-largest")
    revisits = (sized_join(slim, largest, ["digest"], ["page_id"]).filter("page_id is null or page_id < largest")
                .select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), F.col("largest").alias("refers_to")).distinct())
    revisits = materialize(revisits, "warc-revisits")
    same = F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    decided = rows.join(F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits, same, "left").select("page_id", "url", "payload", "digest", "refers_to")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    decided.mapInArrow(lambda it: _write(it, folder), INDEX).write.parquet(f"{folder}/index")
    return f"{folder}/index"


def _read(batches: Iterator[pa.RecordBatch], folder: str, gap: int, span: int) -> Iterator[pa.RecordBatch]:
    fs, _ = pafs.FileSystem.from_uri(folder)
    handle, opened = None, None
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def fetch(archive: str, run: list[tuple[int, int]]) -> pa.RecordBatch:
        nonlocal handle, opened
        if opened != archive:
            handle, opened = fs.open_input_file(archive), archive
        first = run[0][0]
        data = memoryview(handle.read_at(run[-1][0] + run[-1][1] - first, first))
        found = [parse(zlib.decompress(data[o - first : o - first + n], 31)) for o, n in run]
        return pa.RecordBatch.from_pylist(found, schema=schema)

    archive, run = None, []
    for batch in batches:
        for a, o, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if run and (a != archive or o - sum(run[-1]) > gap or o + n - run[0][0] > span):
                yield fetch(archive, run)
                run = []
            archive = a
            run.append((o, n))
    if run:
        yield fetch(archive, run)


def read_records(spark: SparkSession, index: DataFrame, folder: str, *, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """The records that index (all rows of an index, or any selection of them) points at."""
    bound_batches(spark)
    chosen = index.select("archive", "offset", "length", F.floor(F.col("offset") / span).alias("span"))
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    chosen = chosen.repartition(max(1, -(-total // TASK_BYTES)), "archive", "span").sortWithinPartitions("archive", "offset").select("archive", "offset", "length")
    return chosen.mapInArrow(lambda it: _read(it, folder, gap, span), RECORD)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write all pages, then read every record back from the archives."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    index = spark.read.schema(INDEX).parquet(write_archives(pages, folder, **options))
    return read_records(spark, index, folder)
