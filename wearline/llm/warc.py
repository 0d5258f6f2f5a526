"""WARC records in seekable Zstandard bundles.

write_bundles() turns rows into WARC/1.1 records, groups them into independent Zstandard frames, and ends each bundle
with the seek table of the seekable format (a skippable frame).  A bundle is one binary value of a Parquet table in
the shared folder - exactly the bytes of a .warc.zst file - with a map from record identifiers to frame numbers and
offsets inside the frame; Spark's committer makes the write safe when executors are lost.  read_bundles() parses the
seek table, opens the frames and yields the records; fetch() opens only the frames that hold the wanted records.

revisits() decides the record types: of rows with equal payloads of LEAST bytes or more, that with the largest id is
a response and the others revisit it (rows that repeat this largest id are responses too; null ids come last and are
never referred to); smaller payloads are all responses.  A null payload is empty; a null address leaves its header
out; line breaks in an address are escaped.  Extra columns are not carried, whatever their names; repeated rows are
records each; payloads of any length are one record; an empty table gives no bundles.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, spread_join

#: Payloads below this many bytes are never revisited.
LEAST = 1000
#: Rows with one payload that a task takes.
COPIES = 256
#: Raw bytes after which a frame ends, compressed bytes after which a bundle ends.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 4 << 20
#: Fixed values of the seekable format: number of the skippable frame and of the footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
BUNDLES = "bundle string, content binary, records array<struct<record_id:string,frame:int,offset:int,length:int>>"
RECORDS = "page_id bigint, record_type string, refers_to bigint, url string, payload binary, header_digest string, length bigint"
WRITE = {"compression": "uncompressed", "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


def revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to of every row."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("digest"), (F.octet_length(body) >= LEAST).alias("large"))
    # small payloads have no copies to look for, and a key of their own each, so that empty pages don't meet in one task
    rows = rows.withColumn("copy", F.when(F.col("large"), F.col("digest")).otherwise(F.concat(F.lit("small "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    last = rows.where("large").groupBy("copy").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 AND last IS NOT NULL")
    again = F.col("large") & F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id"))
    return spread_join(rows, last, ["copy"], "n", COPIES, "left").select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("last")).alias("refers_to"))


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds the headers of the answer only."""
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = answer + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(frame: bytes, at: int = 0, length: int | None = None) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of the records from offset at on."""
    stop = len(frame) if length is None else at + length
    while at < stop:
        head = frame.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in frame[at:head].decode().split("\r\n")[1:])
        begin = head + 4
        end = begin + int(headers["Content-Length"])
        yield at, headers, frame[begin:end]
        at = end + 4


class Bundle:
    """Gathers records; closed() gives the bytes of the seekable file."""

    def __init__(self) -> None:
        self.done, self.open, self.raw, self.sizes, self.records, self.size = [], [], 0, [], [], 0
        self.zip = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, name: str, data: bytes) -> None:
        self.records.append({"record_id": name, "frame": len(self.sizes), "offset": self.raw, "length": len(data)})
        self.open.append(data)
        self.raw += len(data)
        if self.raw >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            self.done.append(self.zip.compress(b"".join(self.open)))
            self.sizes.append((len(self.done[-1]), self.raw))
            self.size += len(self.done[-1])
            self.open, self.raw = [], 0

    def closed(self) -> bytes:
        self.end_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, FOOTER)
        return b"".join(self.done) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """Begin, compressed and raw size of each frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != FOOTER:
        raise ValueError("no seek table")
    out, at = [], 0
    for k in range(n):
        packed, raw = struct.unpack_from("<II", content, len(content) - 9 - 8 * (n - k))
        out.append((at, packed, raw))
        at += packed
    return out


def frame_of(content: bytes, entry: tuple[int, int, int]) -> bytes:
    at, packed, raw = entry
    return zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=raw)


def bundled(rows: DataFrame) -> DataFrame:
    """Bundles of the rows of revisits(), made task by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, Bundle()
        schema = pa.schema([("bundle", pa.string()), ("content", pa.binary()), ("records", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])))])

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"bundle": f"{part:06d}-{made:06d}.warc.zst", "content": held.closed(), "records": held.records}], schema)

        for batch in sliced(batches, "payload"):
            for x in batch.to_pylist():
                held.add(urn(x["page_id"]), record(x["page_id"], x["url"], x["payload"].encode(), x["digest"], x["record_type"], x["refers_to"]))
                if held.size >= BUNDLE_BYTES:
                    yield out()
                    made, held = made + 1, Bundle()
        if held.records:
            yield out()

    return rows.select("page_id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(run, BUNDLES)


def write_bundles(rows: DataFrame, path: str) -> None:
    bundled(rows).write.options(**WRITE).parquet(path)


def answer(headers: dict[str, str], block: bytes) -> dict:
    """A record as a row of RECORDS."""
    number = lambda name: int(x) if (x := headers.get(name, "")[10:-1]) else None
    url = headers.get("WARC-Target-URI")
    kind, inner = headers["WARC-Type"], block[: block.index(b"\r\n\r\n")].decode().split("\r\n")[1:]
    return {
        "page_id": number("WARC-Record-ID"), "record_type": kind, "refers_to": number("WARC-Refers-To"),
        "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "payload": block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None,
        "header_digest": base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex(),
        "length": int(dict(line.split(": ", 1) for line in inner)["Content-Length"]),
    }


ROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("header_digest", pa.string()), ("length", pa.int64())])


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles; the payload of a revisit is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                for entry in seek_table(raw):
                    yield pa.RecordBatch.from_pylist([answer(h, b) for _, h, b in parse(frame_of(raw, entry))], ROW)

    return bundles.select("content").mapInArrow(run, RECORDS)


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose identifiers are in wanted (record_id), opening only their frames."""
    places = bundles.select("bundle", F.explode("records").alias("r")).select("bundle", "r.*").join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    need = places.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                table, frames, rows = seek_table(x["content"]), {}, []
                for p in sorted(x["places"], key=lambda p: (p["frame"], p["offset"])):
                    if p["frame"] not in frames:
                        frames = {p["frame"]: frame_of(x["content"], table[p["frame"]])}
                    rows += [answer(h, b) for _, h, b in parse(frames[p["frame"]], p["offset"], p["length"])]
                yield pa.RecordBatch.from_pylist(rows, ROW)

    return bundles.join(need, "bundle").select("content", "places").mapInArrow(run, RECORDS)


def described(records: DataFrame) -> DataFrame:
    """Per record: its identifier, the length and SHA-1 of its full payload, type and reference; a revisit has those that its headers name."""
    size, digest = F.coalesce(F.octet_length("payload").cast("long"), "length"), F.coalesce(F.sha1("payload"), "header_digest")
    return records.select("page_id", "record_type", "refers_to", size.alias("payload_bytes"), digest.alias("payload_digest"))
