"""WARC archives: index first, then coalesced sorted byte-range reads of the selected records.

Each task writes archives of its own and returns an index row per record (archive, offset, length,
url, digest). Only the index, committed by Spark as a Parquet table, says which archives count: what
a lost or repeated task left behind has no index row and is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialize, shared_dir

#: Payloads from this size on are written once; later copies refer to them.
REVISIT_BYTES = 1000
#: An archive is closed beyond this size; one read spans at most READ_BYTES and skips gaps up to GAP_BYTES.
ARCHIVE_BYTES, READ_BYTES, GAP_BYTES = 256 << 20, 4 << 20, 64 << 10
#: Bytes of archives that a task reads, about.
TASK_BYTES = 8 << 20

_INDEX = (
    "archive string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"
)
_RECORDS = "page_id long, url string, record_type string, refers_to long, digest string, payload binary"
_ID = "urn:page:"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def plan_revisits(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``(page_id, url, payload, record_type, refers_to)`` of each page.

    Of equal payloads of ``revisit_bytes`` at least, the largest ``page_id`` is the response. Only
    digests meet in groups; a page's html moves once, dealt by its own id.
    """
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    large = p.filter(F.octet_length("payload") >= revisit_bytes).select("page_id", "digest")
    repeated = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    revisits = (
        large.join(repeated, "digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
        .select("page_id", "digest", "refers_to").distinct()
    )
    a, b = p.alias("a"), revisits.alias("b")
    same = F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.digest") == F.col("b.digest"))
    kind = F.when(F.col("b.refers_to").isNull(), "response").otherwise("revisit").alias("record_type")
    return a.join(b, same, "left").select("a.page_id", "a.url", "a.payload", kind, "b.refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One record, a gzip member of its own so that it can be read alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').encode('unicode_escape').decode()}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/octet-stream", f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head += [
            f"WARC-Refers-To: <{_ID}{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """Fields of one record."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:40]}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    number = lambda x: int(x[len(_ID) + 1 : -1]) if len(x or "") > len(_ID) + 2 else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"].encode().decode("unicode_escape"),
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To", "")),
        "digest": base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(),
        "payload": rest[: int(fields["Content-Length"])] if fields["WARC-Type"] == "response" else None,
    }


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Write ``planned`` (see :func:`plan_revisits`) below ``folder``; the index, as a written table."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        name, out, at = "", None, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, kind, refers_to in batch.itertuples(index=False, name=None):
                    page_id, refers_to = (None if x is None or pd.isna(x) else int(x) for x in (page_id, refers_to))
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    data = record(page_id, url, payload, kind, refers_to)
                    out.write(data)
                    rows.append((name, at, len(data), url, hashlib.sha1(payload).hexdigest(), page_id, kind, refers_to))
                    at += len(data)
                frame = pd.DataFrame(rows, columns=[x.split()[0] for x in _INDEX.split(", ")])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    return materialize(planned.select("page_id", "url", "payload", "record_type", "refers_to").mapInPandas(put, _INDEX))


def ranges(index: DataFrame) -> DataFrame:
    """``(archive, start, stop, records)``: neighbouring records of an archive, merged to one read each.

    A read ends at a gap over ``GAP_BYTES`` and where another ``READ_BYTES`` of its archive begin.
    """
    order = Window.partitionBy("archive").orderBy("offset")
    end = F.col("offset") + F.col("length")
    breaks = (F.col("offset") - F.lag(end).over(order) > GAP_BYTES) | (
        F.floor(F.col("offset") / READ_BYTES) > F.floor(F.lag("offset").over(order) / READ_BYTES)
    )
    runs = index.select("archive", "offset", "length").withColumn("new", F.coalesce(breaks.cast("int"), F.lit(0)))
    return (
        runs.withColumn("run", F.sum("new").over(order))
        .groupBy("archive", "run")
        .agg(F.min("offset").alias("start"), F.max(end).alias("stop"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"))
        .drop("run")
    )


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """``(page_id, url, record_type, refers_to, digest, payload)`` of the records in ``index``, which
    may be any selection of index rows. A revisit's payload is null. Damaged records raise."""

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(folder)
        for batch in batches:
            for archive, start, stop, records in batch.itertuples(index=False, name=None):
                with store.open_input_file(f"{root}/{archive}") as f:
                    data = f.read_at(stop - start, start)
                rows = [parse(data[r["offset"] - start : r["offset"] - start + r["length"]]) for r in records]
                frame = pd.DataFrame(rows, columns=[x.split()[0] for x in _RECORDS.split(", ")])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    total = index.agg(F.sum("length")).first()[0] or 0
    # The index is small beside what it points to; tasks are dealt by the bytes that they read.
    return ranges(index).repartition(-(-total // TASK_BYTES) or 1, "archive", "start").mapInPandas(get, _RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, url)`` as read back.

    Nulls: a null html is the empty payload, a null url the empty one. A null ``page_id`` loses to
    any other; if all of a payload's ids are null, each is a response. Rows that repeat the largest
    ``page_id`` of a payload are all responses. Other columns are ignored.
    """
    folder = shared_dir(pages.sparkSession)
    index = write_archives(plan_revisits(pages), folder)
    found = read_records(index, folder).select(
        "page_id", "url", "record_type", "refers_to", "digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("payload").isNotNull() & (F.sha1("payload") != F.col("digest")), F.raise_error(F.lit("payload does not match its digest"))).otherwise(F.col("digest")).alias("payload_digest"),
    )
    found = materialize(found)
    # A revisit has no payload of its own: its size is that of the response with its digest.
    sizes = found.filter("record_type = 'response' AND payload_bytes >= 1").groupBy("digest").agg(F.max("payload_bytes").alias("n"))
    revisits = found.filter("record_type = 'revisit'").join(sizes, "digest")
    columns = ["page_id", "payload_digest", "record_type", "refers_to", "url"]
    return found.filter("record_type = 'response'").select("payload_bytes", *columns).unionByName(
        revisits.select(F.col("n").alias("payload_bytes"), *columns)
    )
