"""WARC archives: one gzip member for each record, read back one after another.

Writing: every page becomes a ``response`` record (an HTTP block with its payload) or, if an equal payload of at least ``least_bytes``
stands in a response with a larger page_id, a ``revisit`` record without payload that names it. Tasks write their own files; the rows of
accepted tasks list them.

Reading: members are inflated as the bytes come, in pieces of bounded size. A header ends at an empty line and its Content-Length frames
the block; block and payload digests are verified. Payloads that nobody asked for are let go with their record; those asked for are handed on by bytes.

Cases: a null html is an empty payload; a null page_id has a record id made of its digest, a null url has no header, both come back null; control characters of a url are written as %XX; among equal payloads a null page_id is
the smallest; rows with the largest page_id of a payload, if there are several, are all responses; an empty table writes nothing and
reads back empty; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.files import new_folder, one_task_each, resolved, task_file
from factloom.operators.stages import written

LEAST_BYTES = 1_000
PIECE = 1 << 16
FILE_BYTES = 1 << 28
HELD_BYTES = 1 << 24
HELD_RECORDS = 4_000


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, seconds: float = 0.0) -> bytes:
    """One record, dated ``seconds`` after 1970, as a gzip member."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:sha1:{hashlib.sha1(b'%r %d ' % (url, revisit) + block).hexdigest()}>"
    dated = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(seconds))
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), ("WARC-Date", dated)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c >= " " else f"%{ord(c):02X}" for c in url)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    data = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _page(value: bytes | None) -> int | None:
    return int(value[len(b"<urn:page:"):-1]) if value and value.startswith(b"<urn:page:") else None


class Members:
    """The inflated bytes of one gzip member after another of a stream."""

    def __init__(self, stream):
        self.stream, self.rest = stream, b""
        self.inflater, self.ready = None, bytearray()

    def begin(self) -> bool:
        """Go to the next member; False at the end of the stream."""
        if not self.rest:
            self.rest = self.stream.read(PIECE)
        self.inflater, self.ready = zlib.decompressobj(31), bytearray()
        return bool(self.rest)

    def _more(self) -> bool:
        if self.inflater.eof:
            return False
        if not self.rest and not self.inflater.unconsumed_tail:
            self.rest = self.stream.read(PIECE)
            if not self.rest:
                raise ValueError("a member is cut off")
        self.ready += self.inflater.decompress(self.inflater.unconsumed_tail or self.rest, PIECE)
        if self.inflater.eof:
            self.rest = self.inflater.unused_data
        elif not self.inflater.unconsumed_tail:
            self.rest = b""
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.ready.find(mark)) < 0:
            if not self._more():
                raise ValueError("a header has no end")
        got = bytes(self.ready[:at])
        del self.ready[:at + len(mark)]
        return got

    def take(self, length: int) -> bytes:
        while len(self.ready) < length:
            if not self._more():
                raise ValueError("a block is shorter than its Content-Length")
        got = bytes(self.ready[:length])
        del self.ready[:length]
        return got

    def close(self) -> None:
        """The member must end with the record."""
        while self._more():
            pass
        if self.ready:
            raise ValueError("a member holds more than its record")


def read_records(stream, with_payload: bool = True) -> Iterator[dict]:
    """The records of an archive; a digest or length that doesn't hold is an error."""
    members = Members(stream)
    while members.begin():
        lines = members.until(b"\r\n\r\n").split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("no WARC record")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines[1:])}
        block = members.take(int(fields[b"content-length"]))
        if members.take(4) != b"\r\n\r\n":
            raise ValueError("a record has no end")
        members.close()
        kind = fields[b"warc-type"].decode()
        head, _, payload = block.partition(b"\r\n\r\n")
        inner = {k.lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
        digest = fields[b"warc-payload-digest"].decode()
        if fields[b"warc-block-digest"].decode() != _digest(block) or kind == "response" and (digest != _digest(payload) or len(payload) != int(inner[b"content-length"])):
            raise ValueError("a digest or length doesn't hold")
        yield {
            "page_id": _page(fields.get(b"warc-record-id")), "url": fields[b"warc-target-uri"].decode() if b"warc-target-uri" in fields else None, "payload_bytes": int(inner[b"content-length"]),
            "payload_digest": base64.b32decode(digest.removeprefix("sha1:")).hex(), "record_type": kind, "refers_to": _page(fields.get(b"warc-refers-to")), "payload": payload if with_payload and kind == "response" else None}


def _writer(folder: str, seconds: float):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = stream = None
        count = size = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to", "revisit")]
            for i in range(len(batch)):
                page_id, url, html, refers_to, revisit = (c[i].as_py() for c in columns)
                if stream is None:
                    path = task_file(folder, ".warc.gz")
                    fs, place = resolved(path)
                    stream = fs.open_output_stream(place, compression=None)
                data = record(page_id, url, (html or "").encode("utf-8"), refers_to, revisit, seconds)
                stream.write(data)
                count, size = count + 1, size + len(data)
                if size >= FILE_BYTES:
                    stream.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [count], "n_bytes": [size]})
                    stream, count, size = None, 0, 0
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [count], "n_bytes": [size]})

    return write


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the pages' records; one row (path, n_records, n_bytes) for each file.

    The response of each payload is found on digests alone. A payload that occurs once needs no mention, so only repeated ones are joined
    to the pages, by page_id and digest.
    """
    id_ = F.col("page_id").cast("long")
    rows = pages.select(id_.alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    slim = rows.select("page_id", F.octet_length("html").alias("size"), F.sha1(F.encode("html", "utf-8")).alias("digest")).where(F.col("size") >= least_bytes).select("page_id", "digest")
    last = slim.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 AND last IS NOT NULL").drop("n")
    again = slim.join(last, "digest").where("page_id IS NULL OR page_id < last").select(F.coalesce("page_id", F.lit(-(1 << 63))).alias("id"), "digest", "last").distinct()
    keyed = rows.withColumn("id", F.coalesce("page_id", F.lit(-(1 << 63)))).withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    dealt = keyed.join(again, ["id", "digest"], "left").select("page_id", "url", "html", F.col("last").alias("refers_to"), F.col("last").isNotNull().alias("revisit"))
    return written(dealt.mapInArrow(_writer(folder, time.time()), "path string, n_records long, n_bytes long"))


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the listed archives (with the payloads of responses)."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), **({"payload": pa.binary()} if with_payload else {})}

    def batch_of(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: pa.array([h[k] for h in held], kind) for k, kind in kinds.items()})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, place = resolved(path)
                held, size = [], 0
                with fs.open_input_stream(place, compression=None) as stream:
                    for got in read_records(stream, with_payload):
                        held.append(got)
                        size += len(got["payload"] or b"")
                        if len(held) == HELD_RECORDS or size >= HELD_BYTES:
                            yield batch_of(held)
                            held, size = [], 0
                yield batch_of(held)

    return one_task_each(manifest.select("path"), manifest.count(), "path").mapInArrow(read, RECORD + (", payload binary" if with_payload else ""))


def archived(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the archives to a new shared folder and read them back."""
    return read_archives(write_archives(pages, new_folder(pages.sparkSession, "warc"), least_bytes))
