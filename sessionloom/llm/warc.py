"""WARC archives of web pages: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own. Tasks write files under names of their own into the
shared folder and return them as a table; only files of tasks that were committed are in it.

The reader gives tasks byte ranges of the files. A task looks for the gzip magic in its range,
inflates the start of each place that has it, and takes it for a record only if a WARC
header comes out. It owns the records that start in its range and reads past the range's end to
finish the last one. After a record the next starts at once, so compressed data is not searched.
"""

import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessionloom.llm.common import ship
from sessionloom.llm.files import new_file, new_folder, open_file

RANGE = 4 << 20
MAGIC = b"\x1f\x8b\x08"
_AHEAD = 64 << 10
_HELD = 4 << 20  # bytes of content behind a batch of records
_ENDS = b"\r\n\r\n"
_URN = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_RECORD = "page_id string, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to string"


# ---- records ---------------------------------------------------------------------------


def digest(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id: object, url: str | None, payload: bytes, refers_to: object = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record; a revisit if ``refers_to`` is given."""
    head = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + _ENDS + block + _ENDS


def member(content: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def _fields(head: bytes) -> dict[str, str] | None:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        return None
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def parse(content: bytes) -> dict:
    """Page, payload, its length and digest, type and reference of a record."""
    head, _, rest = content.partition(_ENDS)
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != _ENDS:
        raise ValueError(f"WARC record {fields['warc-record-id']} is cut short")
    length, named = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    payload = None
    if fields["warc-type"] == "response":
        payload = block.partition(_ENDS)[2]
        length, found = len(payload), digest(payload)
        if found != named:
            raise ValueError(f"WARC record {fields['warc-record-id']} has another payload digest: {found}")
    urn = lambda name: fields[name].strip("<>").removeprefix(_URN) or None if name in fields else None
    return {
        "page_id": urn("warc-record-id"), "url": fields.get("warc-target-uri"), "payload": payload, "payload_bytes": length,
        "payload_digest": named, "record_type": fields["warc-type"], "refers_to": urn("warc-refers-to"),
    }


class _Bytes:
    """A file from ``start`` on, read ahead as asked for."""

    def __init__(self, source, start: int, length: int):
        self.source, self.size, self.start = source, source.size(), start
        self.held = source.read_at(min(length, max(0, self.size - start)), start)

    def piece(self, at: int, length: int) -> bytes:
        want = min(at + length, self.size)
        have = self.start + len(self.held)
        if want > have:
            more = min(max(want - have, _AHEAD), self.size - have)
            self.held += self.source.read_at(more, have)
        return self.held[at - self.start : want - self.start]

    def find(self, what: bytes, at: int, end: int) -> int:
        """First place from ``at`` on and before ``end`` where ``what`` begins; -1 if there is none."""
        self.piece(at, end - at + len(what) - 1)
        place = self.held.find(what, at - self.start, end - self.start + len(what) - 1)
        return place + self.start if place >= 0 else -1


def _starts_record(data: _Bytes, at: int) -> bool:
    """Whether a gzip member begins here whose content begins with a WARC header."""
    unpack, out, place = zlib.decompressobj(31), b"", at
    try:
        while _ENDS not in out:
            piece = data.piece(place, 4096)
            if not piece or unpack.eof:
                return False
            out += unpack.decompress(piece)
            place += len(piece)
            if not b"WARC/1.".startswith(out[:7]):
                return False
    except zlib.error:
        return False
    fields = _fields(out.partition(_ENDS)[0])
    return bool(fields) and "warc-type" in fields and fields.get("content-length", "").isdigit()


def records(source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """``(offset, content)`` of the records of a file that start in ``start <= offset < end``."""
    data, at = _Bytes(source, start, end - start + _AHEAD), start
    while (at := data.find(MAGIC, at, end)) >= 0:
        if not _starts_record(data, at):
            at += 1
            continue
        unpack, out, place = zlib.decompressobj(31), [], at
        while not unpack.eof:
            piece = data.piece(place, _AHEAD)
            if not piece:
                raise ValueError(f"the gzip member at byte {at} is cut short")
            out.append(unpack.decompress(piece))
            place += len(piece)
        yield at, b"".join(out)
        at = place - len(unpack.unused_data)


# ---- tables ----------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write a record per row of ``pages (page_id, url, html)``; ``path, bytes, records`` of the files.

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest page_id is a
    response and the others revisit it; smaller payloads are all responses.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or new_folder(spark, "warc")
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", text.cast("binary").alias("payload"), F.sha1(text.cast("binary")).alias("digest"))
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.length("payload") >= least)
    work = rows.join(firsts, "digest").select(
        F.col("page_id").cast("string"), "url", "payload", F.when(again, F.col("first")).cast("string").alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with new_file(folder, "warc.gz") as (path, stream):
            size = count = 0
            for batch in batches:
                for page_id, url, payload, refers_to in zip(*batch.columns, strict=True):
                    packed = member(record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()))
                    stream.write(packed)
                    size, count = size + len(packed), count + 1
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([count])], ["path", "bytes", "records"])

    # one row per file; as results of finished tasks they stay the same when executors are lost later
    return spark.createDataFrame(work.mapInArrow(write, "path string, bytes bigint, records bigint").toArrow())


def read_archives(files: DataFrame, length: int = RANGE, payloads: bool = True) -> DataFrame:
    """The records of ``files (path, bytes)``, read by byte ranges; payload is null in revisits.

    Without ``payloads`` they are read and checked against their digests, but not returned.
    """
    ship(files.sparkSession)
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(length).cast("bigint"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + length, "bytes").alias("end"))
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_file(path) as source:
                    found: list[dict] = []
                    held = 0
                    for _, content in records(source, start, end):
                        one = parse(content)
                        found.append(one if payloads else one | {"payload": None})
                        held += len(content)
                        if held > _HELD:
                            yield _batch(found, kinds)
                            found, held = [], 0
                    if found:
                        yield _batch(found, kinds)

    # deal the ranges out so that each task has about one range's length, however many small files there are
    size = files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return ranges.repartition(max(1, -(-size // length))).mapInArrow(read, _RECORD)


def _batch(found: list[dict], kinds: list[pa.DataType]) -> pa.RecordBatch:
    names = list(found[0])
    return pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], k) for n, k in zip(names, kinds, strict=True)], names)


def archived_pages(pages: DataFrame, least: int = 0, length: int = RANGE) -> DataFrame:
    """Write ``pages`` and read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Null and empty html are empty payloads, which are equal too. Rows that repeat the smallest
    page_id of their payload are responses each; rows without id revisit the smallest id of
    their payload, or are responses if it has none. Payloads of any length are kept whole.
    White space and control characters in a url are percent-encoded; other columns are not
    read. An empty table gives no archives and an empty table.
    """
    kind = pages.schema["page_id"].dataType
    rows = read_archives(write_archives(pages, least=least), length, payloads=False)
    return rows.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))
