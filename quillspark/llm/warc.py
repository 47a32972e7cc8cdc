"""WARC archives: a writer with revisit records, and a sequential reader.

Each record is one gzip member. Archives are rows (archive, segment, data) of a table, so the engine's own writer
commits them and a lost task is simply repeated; a segment holds whole members, and an archive's segments one after
another are a standard .warc.gz file. ``export`` writes such files.

The reader takes bytes in pieces: incremental zlib decompression finds each member's end, Content-Length frames the
block, and the payload's SHA-256 is compared with WARC-Payload-Digest. A truncated or broken member, or a payload of
another digest, raises. ``referred`` holds each revisit against the response that it names.

Defined cases: null html is an empty payload, a null url is about:blank, a null page_id is written as such and read
back as null. Payloads under ``LEAST`` bytes are always responses. Rows alike in page_id and payload are all of the
type of that page. Empty tables give empty archives; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import slices, stage

LEAST, SEGMENT, ARCHIVE, LEVEL, PIECE = 100, 4_000_000, 64_000_000, 3, 65_536
URN = "<urn:page:{}>"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def member(headers: list[tuple[str, object]], block: bytes, level: int = LEVEL) -> bytes:
    """One record as one gzip member; its time stamp is zero, so that reruns agree."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", URN.format(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "about:blank"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if refers_to is None:
        return member(headers, HTTP % len(payload) + payload)
    headers += [("WARC-Refers-To", URN.format(refers_to)), ("WARC-Profile", REVISIT), ("X-Payload-Length", len(payload))]
    return member(headers, HTTP % len(payload))


def records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record, one after another."""
    z, held = zlib.decompressobj(31), bytearray()
    fed = False
    for piece in pieces:
        while piece:
            held += z.decompress(piece)
            fed = True
            piece = b""
            if z.eof:
                yield _framed(bytes(held))
                piece, z, held, fed = z.unused_data, zlib.decompressobj(31), bytearray(), False
    if fed:
        raise ValueError("the archive ends within a record")


def _framed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, sep, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not sep or not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {n} doesn't frame the block")
    return headers, rest[:n]


def in_pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    for i in range(0, len(data), size):
        yield data[i : i + size]


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, digest, refers_to). Only ids and digests are joined on a digest, whatever its share of
    the rows; payloads are then joined to the revisits on page and digest."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    full = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    slim = full.where(F.octet_length("payload") >= least).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    first = first.where("refers_to < last").drop("last")
    revisits = slim.distinct().join(first, "digest").where("page_id > refers_to")
    return full.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The archives of pages(page_id, url, html) as rows (archive, segment, data)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, segment, size = 0, 0, 0

        def name() -> str:
            return f"pages-{part:06d}-{number:04d}.warc.gz"

        def info() -> bytes:
            text = f"software: quillspark\r\nformat: WARC File Format 1.1\r\nfile: {name()}\r\n".encode()
            return member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", name()), ("Content-Type", "application/warc-fields")], text)

        held = bytearray()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([name()]), pa.array([segment], pa.int32()), pa.array([bytes(held)], pa.binary())],
                names=["archive", "segment", "data"],
            )

        for batch in batches:
            for rows, payloads in slices(batch, "payload"):
                ids, urls, digests, refers = (rows.column(i).to_pylist() for i in (0, 1, 3, 4))
                for page_id, url, payload, digest, to in zip(ids, urls, payloads, digests, refers, strict=True):
                    if not held and not segment:
                        held += info()
                    held += page_record(page_id, url, payload, digest, to)
                    if len(held) >= SEGMENT:
                        yield row()
                        size += len(held)
                        segment += 1
                        held.clear()
                        if size >= ARCHIVE:
                            number, segment, size = number + 1, 0, 0
        if held:
            yield row()

    return with_revisits(pages, least).mapInArrow(each, "archive string, segment int, data binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of the page records.

    A response's payload has the digest that its header names, or it raises. A revisit has no payload (null); its length
    and digest are what its own headers say.
    """

    def number(urn: str) -> int | None:
        x = urn[len("<urn:page:") : -1]
        return None if x == "None" else int(x)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_buffer().to_pybytes()
                out, size = [], 0
                for h, block in records(in_pieces(data)):
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    named = h["warc-payload-digest"].removeprefix("sha256:")
                    http, _, body = block.partition(b"\r\n\r\n")
                    row = {"page_id": number(h["warc-record-id"]), "url": h["warc-target-uri"], "record_type": h["warc-type"]}
                    if h["warc-type"] == "response":
                        if hashlib.sha256(body).hexdigest() != named:
                            raise ValueError(f"the payload of {h['warc-record-id']} has another digest")
                        row |= {"refers_to": None, "payload_bytes": len(body), "payload_digest": named, "payload": body.decode()}
                    else:
                        row |= {"refers_to": number(h["warc-refers-to"]), "payload_bytes": int(h["x-payload-length"]), "payload_digest": named, "payload": None}
                    out.append(row)
                    size += len(body)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)

    ddl = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"
    return archives.select("archive", "segment", "data").mapInArrow(each, ddl)


def referred(records: DataFrame) -> DataFrame:
    """records with ``verified``: a response is; a revisit, where the page that it names has a response of its digest
    and length. Only ids, digests and lengths of the two are joined."""
    of = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    of = of.distinct().withColumn("verified", F.lit(True))
    again = records.where("record_type = 'revisit'").join(of, ["refers_to", "payload_digest", "payload_bytes"], "left")
    again = again.withColumn("verified", F.coalesce("verified", F.lit(False)))
    return records.where("record_type = 'response'").withColumn("verified", F.lit(True)).unionByName(again)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes the pages' archives into the shared folder, reads them back and holds revisits against their responses:
    the columns of ``read_archives`` but the payload, and verified."""
    return referred(stage(read_archives(stage(write_archives(pages, least), "warc")).drop("payload"), "records"))


def export(archives: DataFrame, folder: str) -> None:
    """Writes each archive as a file; folder must be one that every executor and the driver see.

    Segments are written in order by one task an archive (of about ``ARCHIVE`` bytes), to a name of its own that is
    then renamed, so a repeated task leaves one whole file.
    """
    import os
    import uuid

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f, done = None, None, []

        def close() -> None:
            if f is not None:
                f.close()
                os.replace(f.name, os.path.join(folder, now))
                done.append(now)

        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                if name != now:
                    close()
                    now, f = name, open(os.path.join(folder, f".{name}.{uuid.uuid4().hex}"), "wb")  # noqa: SIM115
                f.write(batch.column(2)[i].as_buffer())
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["archive"])

    ordered = archives.repartition("archive").sortWithinPartitions("archive", "segment")
    ordered.select("archive", "segment", "data").mapInArrow(each, "archive string").count()
