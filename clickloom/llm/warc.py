"""WARC archives with an index, and reading selected records back by coalesced byte ranges.

Each task writes gzip members, one per record, to files of its own name and hands on the index rows. The index is written by
Spark, so only rows of tasks that succeeded are in it; a file left by a lost task is named by no row and never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.batches import short_batches
from clickloom.plans.stage import written
from clickloom.session import fresh_dir

RESPONSE, REVISIT = "response", "revisit"
ARCHIVE_BYTES = 64 * 2**20
RANGE_BYTES = 8 * 2**20
GAP_BYTES = 64 * 2**10
DATE = "2020-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
READ = "page_id long, url string, record_type string, refers_to long, digest string, payload binary"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(name: str) -> int | None:
    number = name.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def _record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    kind = REVISIT if is_revisit else RESPONSE
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + '!#$&()*+,/:;=?@[]~')}")
    if is_revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == REVISIT
    if not revisit and _digest(payload) != digest:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None,
        "digest": digest,
        "payload": None if revisit else payload,
    }


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to, is_revisit): of equal payloads of ``min_bytes`` or more, the largest page id is stored.

    Rows that share an id and a payload are all stored. A null id refers to the largest id of its group; in a group
    without any id all are stored. Only ids and digests are grouped; a hot payload is counted before the shuffle.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    rows = rows.withColumn("_sha", F.sha1("html"))
    best = rows.where(F.octet_length("html") >= min_bytes).groupBy("_sha").agg(F.max("page_id").alias("_best"))
    rows = rows.join(best, "_sha", "left")
    revisit = F.col("_best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_best"))
    return rows.select("page_id", "url", "html", F.when(revisit, F.col("_best")).alias("refers_to"), revisit.alias("is_revisit"))


def write_archives(records: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Write ``plan_records`` rows to ``.warc.gz`` files under ``folder`` (default: the shared folder) and return the written index.

    A task starts a new file after ``archive_bytes``. The folder may be in any store that Arrow's file systems reach.
    """
    folder = folder or fresh_dir(records.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        sink, path, offset = None, "", 0
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if sink is None or offset >= archive_bytes:
                    if sink is not None:
                        sink.close()
                    path, offset = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    sink = store.open_output_stream(path, compression=None)
                payload = r["html"].encode()
                digest = _digest(payload)
                raw = gzip.compress(_record(r["page_id"], r["url"], payload, digest, r["refers_to"], r["is_revisit"], date), 6, mtime=0)
                sink.write(raw)
                rows.append((path, offset, len(raw), r["page_id"], r["url"], digest, REVISIT if r["is_revisit"] else RESPONSE))
                offset += len(raw)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["file", "offset", "length", "page_id", "url", "digest", "record_type"]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=names)
        if sink is not None:
            sink.close()

    # Files are complete before the index is read: the index is the output of the tasks that wrote them.
    return written(short_batches(records).mapInArrow(run, INDEX), "warc-index")


def _ranges(rows: list[dict], range_bytes: int, gap_bytes: int) -> Iterator[list[dict]]:
    """Runs of neighbouring records of one file that are read at once."""
    run: list[dict] = []
    for r in rows:
        if run and (r["file"] != run[0]["file"] or r["offset"] > run[-1]["offset"] + run[-1]["length"] + gap_bytes or r["offset"] + r["length"] > run[0]["offset"] + range_bytes):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read_records(index: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records that ``index`` rows name: page_id, url, record_type, refers_to, digest and payload (null for a revisit).

    Records are sorted by place; those with at most ``gap_bytes`` between them are read as one range of up to
    ``range_bytes`` (or one longer record). A payload that does not match its digest raises an error.
    """
    part = F.floor(F.col("offset") / range_bytes)
    # As many partitions as the records' bytes ask for: by the size of the index itself Spark would merge them into one.
    total = index.agg(F.sum("length")).first()[0] or 0
    parts = max(1, -(-int(total) // range_bytes))
    rows = index.select("file", "offset", "length").repartition(parts, F.col("file"), part).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())])
        for b in batches:
            for near in _ranges(b.to_pylist(), range_bytes, gap_bytes):
                first = near[0]["offset"]
                with store.open_input_file(near[0]["file"]) as source:
                    data = source.read_at(near[-1]["offset"] + near[-1]["length"] - first, first)
                found = [_parse(gzip.decompress(data[r["offset"] - first :][: r["length"]])) for r in near]
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return rows.mapInArrow(run, READ)


def archive_and_read(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write all pages, read all records back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload. Size and digest of a revisit are those of the record it refers to.
    """
    folder = fresh_dir(pages.sparkSession, "warc")
    index = write_archives(plan_records(pages, page_id, url, html, min_bytes), folder)
    back = read_records(index, folder).select("page_id", "digest", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("n"))
    back = written(back, "warc-read")
    full = back.where(F.col("record_type") == RESPONSE).groupBy("digest").agg(F.max("n").alias("full"))
    return back.join(full, "digest", "left").select(
        "page_id",
        F.coalesce("n", "full").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
