"""WARC archives in seekable Zstandard bundles.

A task appends records to one archive.  Records are grouped into frames of about FRAME_BYTES, each compressed on its own; at
the end come two skippable frames: the record index (record id, frame, offset inside the decompressed frame, length)
and the seek table of the Zstandard seekable format, the file's footer.  A reader finds one record by reading the
footer, one entry of the index and one frame.

Of records with equal payloads the one with the largest page_id is written as a response and the others as revisits
that refer to it; the largest id of each digest combines before the shuffle, and pages meet it by a broadcast as far as the number of repeated digests
allows, so no task gathers a group of equal pages.

Defined results: null html is an empty payload; a page without id is written with the id ``null`` and, among equal payloads,
revisits the largest id there is (all such rows are responses if no row has an id); rows that repeat the largest id are
responses too; a null url becomes the record's own URN; very long pages are frames of their own; an empty table
gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import functools
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covaria.llm.common import ROWS_AT_ONCE, materialize, shared_path
from covaria.llm.files import read_bytes, writing

FRAME_BYTES = 256 * 1024
LEVEL = 3
#: Payloads below this many bytes are never revisits.
MIN_BYTES = 0
#: Repeated digests (some 100 bytes each in memory) that are broadcast at most, and the share of all pages, 1 in so many, beyond which a digest is hot.
BROADCAST_GROUPS = 500_000
HOT_SHARE = 10_000
DATE = "1970-01-01T00:00:00Z"
URN = "urn:covaria:page:"
# The Zstandard format's magic numbers and the WARC profile of revisits.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEK_TABLE_END = 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, with the payload's length, and no payload."""
    urn = f"{URN}{'null' if page_id is None else page_id}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{urn}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join((url or urn).split())}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        *([] if refers_to is None else [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{URN}{refers_to}>"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record, its payload among them (None for a revisit); raises if digest or length are wrong."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if rest[len(block) :] != b"\r\n\r\n" or not revisit and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda urn: None if urn.endswith(":null>") else int(urn[1 + len(URN) : -1])
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }


class Bundle:
    """Writes records to an open stream; finish() appends the index and the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.frame_bytes = frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        self.out, self.held, self.size = out, [], 0
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []

    def add(self, record_id: str, data: bytes) -> None:
        if self.size and self.size + len(data) > self.frame_bytes:
            self._flush()
        self.index.append((record_id, len(self.frames), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)

    def _flush(self) -> None:
        made = self.compressor.compress(b"".join(self.held))
        self.out.write(made)
        self.frames.append((len(made), self.size))
        self.held, self.size = [], 0

    def finish(self) -> None:
        if self.size:
            self._flush()
        columns = dict(zip(("record_id", "frame", "offset", "length"), map(list, zip(*self.index, strict=True)), strict=True)) if self.index else {}
        made = self.compressor.compress(json.dumps(columns).encode())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(made)) + made)
        self.frames.append((len(made) + 8, 0))
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEK_TABLE_END)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(entries) + len(footer)) + entries + footer)


class Archive:
    """Reads an archive by its footer."""

    def __init__(self, uri: str):
        import zstandard

        self.uri, self.decompressor = uri, zstandard.ZstdDecompressor()
        frames, _, magic = struct.unpack("<IBI", read_bytes(uri, -9))
        if magic != SEEK_TABLE_END:
            raise ValueError(f"{uri} has no seek table")
        table = read_bytes(uri, -9 - 8 * frames, 8 * frames)
        self.frames, at = [], 0
        for packed, size in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, size))
            at += packed
        at, packed, _ = self.frames.pop()
        self.index = json.loads(self.decompressor.decompress(read_bytes(uri, at + 8, packed - 8)))

    @functools.cached_property
    def places(self) -> dict[str, int]:
        """Number of the first record with each id."""
        ids = self.index.get("record_id", [])
        return dict(zip(reversed(ids), range(len(ids) - 1, -1, -1), strict=True))

    def frame(self, k: int) -> bytes:
        at, packed, size = self.frames[k]
        return self.decompressor.decompress(read_bytes(self.uri, at, packed), max_output_size=size)

    def record(self, record_id: str) -> dict:
        """One record by its id, by reading one frame."""
        i = self.places[record_id]
        at = self.index["offset"][i]
        return parse(self.frame(self.index["frame"][i])[at : at + self.index["length"][i]])

    def records(self) -> Iterator[dict]:
        now, data = -1, b""
        for k, at, length in zip(*(self.index.get(c, []) for c in ("frame", "offset", "length")), strict=True):
            if k != now:
                now, data = k, self.frame(k)
            yield parse(data[at : at + length])


def originals(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> tuple[DataFrame, int]:
    """(o_digest, o_id, pages) of every payload that more than one page has: the page that the others revisit, and how many pages there are; and the number of all pages."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    light = pages.where(F.octet_length(payload) >= MIN_BYTES).select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha1(payload)).alias("digest"))
    light = materialize(spark, light, "warc-digests")
    groups = light.groupBy(F.col("digest").alias("o_digest")).agg(F.max("id").alias("o_id"), F.count("*").alias("pages")).where("pages > 1 AND o_id IS NOT NULL")
    return materialize(spark, groups, "warc-originals"), light.count()


def _referred(spark: SparkSession, pages: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """``pages`` (id, url, html, digest, size) with the page that each revisits, or null.

    Up to BROADCAST_GROUPS digests are broadcast, and no payload is shuffled.  Beyond that those which more than one page in HOT_SHARE has, HOT_SHARE at
    most, are broadcast still, so that the pages shuffled for the others have no hot key.
    """
    to = lambda o: F.when(F.col("size") >= MIN_BYTES, F.when(~F.col("id").eqNullSafe(o), o))
    if groups.count() <= BROADCAST_GROUPS:
        return pages.join(F.broadcast(groups), F.col("digest") == F.col("o_digest"), "left").select("id", "url", "html", to(F.col("o_id")).alias("to"))
    hot = groups.where(F.col("pages") * HOT_SHARE > n).select(F.col("o_digest").alias("h_digest"), F.col("o_id").alias("h_id"))
    met = pages.join(F.broadcast(hot), F.col("digest") == F.col("h_digest"), "left")
    # a key that meets nothing, and no two pages share
    key = F.when(F.col("h_id").isNull(), F.col("digest")).otherwise(F.concat(F.col("digest"), F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    both = met.withColumn("key", key).join(groups.where(F.col("pages") * HOT_SHARE <= n), F.col("key") == F.col("o_digest"), "left")
    return both.select("id", "url", "html", to(F.coalesce("h_id", "o_id")).alias("to"))


def write_archives(spark: SparkSession, pages: DataFrame, target: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", frame_bytes: int = FRAME_BYTES) -> list[str]:
    """Write one archive for each partition of ``pages`` below the URI ``target``; returns the archives' URIs."""
    groups, n = originals(spark, pages, id_col, html_col)
    payload = F.coalesce(F.col(html_col), F.lit(""))
    light = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"), F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("size"))
    marked = _referred(spark, light, groups, n)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{target}/{context.partitionId():06d}-{context.taskAttemptId()}.warc.zst"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        n = 0
        with writing(name) as out:
            bundle = Bundle(out, frame_bytes)
            while first is not None:
                for at in range(0, first.num_rows, ROWS_AT_ONCE):
                    for r in first.slice(at, ROWS_AT_ONCE).to_pylist():
                        data = record(r["id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), r["to"])
                        bundle.add(f"{URN}{'null' if r['id'] is None else r['id']}", data)
                        n += 1
                first = next((b for b in batches if b.num_rows), None)
            bundle.finish()
        yield pa.RecordBatch.from_pydict({"name": [name], "records": [n]})

    rows = marked.select("id", "url", "html", "to").mapInArrow(write, "name string, records long").collect()
    return sorted(r["name"] for r in rows)


def read_archives(spark: SparkSession, archives: list[str], payloads: bool = False) -> DataFrame:
    """Per record of the archives its fields, with url and payload on request; each response's digest is verified."""
    schema = T._parse_datatype_string("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads)
    names = schema.fieldNames()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held = []
                for r in Archive(name).records():
                    held.append({k: r[k] for k in names})
                    if len(held) == ROWS_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held = []
                yield pa.RecordBatch.from_pylist(held, arrow)

    if not archives:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([(a,) for a in archives], "name string").repartition(len(archives)).mapInArrow(read, schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return read_archives(spark, write_archives(spark, pages, shared_path(spark, "warc")))
