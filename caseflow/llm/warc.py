"""WARC archives of pages, compressed record by record with a Zstandard dictionary that the archive itself carries.

An archive begins with a skippable frame that holds its dictionary (itself a Zstandard frame), then has one frame per record, so
a record can be read alone from its offset. The dictionary is trained on the archive's own first records, up to ``SAMPLE_BYTES``;
where these are too few to train on, their last bytes serve as they are.

Of pages with equal payloads the one with the largest page_id is stored as a response, the others as revisits that refer to
it; both kinds hold the HTTP headers with the payload's full length. Which page is stored is found on digests alone: a narrow
table says for each page of a shared payload what it refers to, and each page meets its line there by payload and page_id
together, so copies of one payload spread over all tasks however many they are. Pages move once.

Each task writes archives of at most about ``ARCHIVE_BYTES`` under names of its own and reports their records. Only reported
archives are read, so a task that is run again leaves at most a file that nothing names.

Defined results: a null payload is an empty one; payloads below ``least_bytes`` are always responses; rows that share page_id
and payload are one response and revisits of it (any of them may be the response); a null page_id counts as the smallest; a null
or empty url becomes ``urn:page:<id>``, blanks and control characters in it are percent-encoded; an empty table gives no archive
and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.store import landed

# Fixed by the file format.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 1 << 16
SAMPLE_BYTES = 4 << 20
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 15
LEVEL = 3
SALTS = 16
LINES = "archive string, offset long, length long, page_id long, record_type string"
RECORDS = "archive string, offset long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _filesystem(path: str):
    """(file system, path in it) of a folder that all machines share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary for records like ``samples``."""
    import zstandard

    total = sum(map(len, samples))
    size = min(size, total // 8)
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small records to train on
        return b"".join(samples)[-min(DICTIONARY_BYTES, max(total, 1)) :]


def record_id(digest: str, page_id: int | None) -> str:
    """The id of a response, which its revisits can name without having seen it."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{digest} {page_id}'.encode()).digest()[:16], version=5)}>"


def _uri(url: str | None, page_id: int | None) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url or f"urn:page:{page_id}")


def _record(fields: dict[str, str | int | None], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in [*fields.items(), ("Content-Length", len(block))] if value is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: tuple[int | None] | None, shared: bool, date: str) -> bytes:
    """The record of a page: a response, or a revisit of the page that ``refers`` holds; of a ``shared`` payload, revisits name the response."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Type": "response" if refers is None else "revisit"}
    fields["WARC-Record-ID"] = record_id(digest, page_id) if shared and refers is None else f"<urn:uuid:{uuid.uuid4()}>"
    fields |= {"WARC-Date": date, "WARC-Target-URI": _uri(url, page_id), "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-ID": page_id}
    if refers is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(digest, refers[0]), "X-Refers-To-Page-ID": refers[0]}
    return _record(fields | {"Content-Type": "application/http;msgtype=response"}, head if refers is not None else head + payload)


class _Archive:
    """An archive that is being written; its first records wait until there are enough for a dictionary."""

    def __init__(self, folder: str, date: str):
        self.name, self.date = f"{uuid.uuid4().hex}.warc.zst", date
        self.system, path = _filesystem(folder)
        self.path = f"{path}/{self.name}"
        self.waiting: list[tuple[bytes, int | None, str]] = []
        self.size, self.compressor, self.stream = 0, None, None
        self.lines: list[tuple] = []

    def add(self, record: bytes, page_id: int | None, kind: str) -> None:
        if self.compressor is None:
            self.waiting.append((record, page_id, kind))
            self.size += len(record)
            if self.size >= SAMPLE_BYTES:
                self._begin()
            return
        frame = self.compressor.compress(record)
        self.stream.write(frame)
        self.lines.append((self.name, self.size, len(frame), page_id, kind))
        self.size += len(frame)

    def _begin(self) -> None:
        import zstandard

        content = dictionary([record for record, _, _ in self.waiting])
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True)
        packed = zstandard.ZstdCompressor().compress(content)
        about = _record(
            {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": self.date, "WARC-Filename": self.name, "Content-Type": "application/warc-fields"},
            b"format: WARC File Format 1.1\r\n",
        )
        start = struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed + self.compressor.compress(about)
        self.stream = self.system.open_output_stream(self.path, compression=None)
        self.stream.write(start)
        self.size = len(start)
        waiting, self.waiting = self.waiting, []
        for one in waiting:
            self.add(*one)

    def close(self) -> list[tuple]:
        """The lines of its records, once all of them are stored."""
        if self.compressor is None:
            self._begin()
        self.stream.close()
        return self.lines


def _kept(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    # A second, unrelated hash: payloads that were made to share a SHA-1 stay two payloads.
    return rows.select("*", F.sha1("payload").alias("digest"), F.xxhash64("payload").alias("second"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("who"))


def references(rows: DataFrame, least_bytes: int = 0, salts: int = SALTS) -> DataFrame:
    """(digest, second, who, refers_to, rows): for each page of a payload that several rows share, the page stored for it.

    ``rows`` counts the rows that have the stored page's id and payload.
    """
    key = ["digest", "second"]
    pages = rows.filter(F.octet_length("payload") >= least_bytes).groupBy(*key, "who", "page_id").agg(F.count(F.lit(1)).alias("rows"))
    shared = pages.groupBy(*key).agg(F.max(F.struct("page_id", "rows")).alias("top"), F.sum("rows").alias("n")).filter("n > 1").drop("n")
    # A payload that very many pages share is dealt over salts, and its one line repeated.
    dealt = pages.drop("rows").withColumn("salt", F.pmod(F.xxhash64("who"), F.lit(salts)).cast("int"))
    repeated = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*key, "salt"]).select(*key, "who", F.col("top.page_id").alias("refers_to"), F.col("top.rows").alias("rows"))


def write(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES, date: str | None = None,
) -> DataFrame:
    """Write every row of ``pages`` as a record into archives in ``folder``; (archive, offset, length, page_id, record_type) of each."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, set()
        names = [f.split()[0] for f in LINES.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*archive.close()), kinds)], names=names)

        for batch in batches:
            for row in zip(*batch.columns):
                own, place, payload, hexed, refers_to, rows = (v.as_py() for v in row)
                refers = None if rows is None else (refers_to,)
                if rows is not None and refers_to == own:
                    # The stored page itself; of several rows like it the first, and they all come to this task.
                    if (hexed, own) not in done:
                        refers = None
                        if rows > 1:
                            done.add((hexed, own))
                archive = archive or _Archive(folder, date)
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                archive.add(page_record(own, place, payload, digest, refers, rows is not None, date), own, "response" if refers is None else "revisit")
                if archive.compressor is not None and archive.size >= archive_bytes:
                    yield closed()
                    archive = None
        if archive is not None:
            yield closed()

    system, path = _filesystem(folder)
    system.create_dir(path, recursive=True)
    rows = _kept(pages, page_id, url, html)
    key = ["digest", "second", "who"]
    told = rows.repartition(*key).join(references(rows, least_bytes).hint("shuffle_hash"), key, "left")
    return landed(told.select("page_id", "url", "payload", "digest", "refers_to", "rows").mapInArrow(run, LINES), "warc-lines")


def _frames(stream, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each frame after the dictionary's, a piece of the file at a time."""
    import zstandard

    head = stream.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    content = zstandard.ZstdDecompressor().decompress(stream.read(size))
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    offset = 8 + size
    if start > offset:
        stream.seek(start)
        offset = start
    left = stream.read(READ_BYTES)
    while left:
        frame, parts, read = reader.decompressobj(), [], 0
        while not frame.eof:
            if not left and not (left := stream.read(READ_BYTES)):
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(left))
            read += len(left)
            left = b""
        left = frame.unused_data
        read -= len(left)
        yield offset, b"".join(parts)
        offset += read
        left = left or stream.read(READ_BYTES)


def parsed(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(header fields, HTTP head, payload) of a record; a record that is no HTTP message has its block as the payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(rest) != len(block) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("a record's length is not the one it states")
    return (fields, *block.partition(b"\r\n\r\n")[::2]) if fields["Content-Type"].startswith("application/http") else (fields, b"", block)


def read(spark: SparkSession, folder: str, lines: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per page record of the archives that ``lines`` names, read from the archives alone; with the ``payload`` on request.

    A stored payload that does not have its stated digest, or an archive with more or fewer records than ``lines`` has for it,
    is an error.
    """
    names = [f.split()[0] for f in RECORDS.split(", ")] + ["payload"] * payloads
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def rows(name: str, stream) -> Iterator[tuple]:
        for offset, record in _frames(stream):
            fields, head, payload = parsed(record)
            kind = fields["WARC-Type"]
            if kind not in ("response", "revisit"):
                continue
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            size = int(head.decode().rpartition("Content-Length: ")[2])
            if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError(f"the payload at {offset} of {name} is not what its record states")
            refers = number(fields.get("X-Refers-To-Page-ID"))
            row = (name, offset, number(fields.get("X-Page-ID")), fields["WARC-Target-URI"], size, digest, kind, refers)
            yield (*row, payload if kind == "response" else None) if payloads else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder)
        for batch in batches:
            for name, stated in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, some, size = 0, [], 0
                with system.open_input_file(f"{path}/{name}") as stream:
                    for row in rows(name, stream):
                        some.append(row)
                        n, size = n + 1, size + (len(row[-1] or b"") if payloads else 0)
                        if len(some) >= 10_000 or size >= SAMPLE_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=names)
                            some, size = [], 0
                if n != stated:
                    raise ValueError(f"{name} has {n} records, not {stated}")
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=names)

    archives = lines.groupBy("archive").agg(F.count(F.lit(1)).alias("n"))
    return archives.mapInArrow(run, RECORDS + ", payload binary" * payloads)


def fetch(folder: str, archive: str, offset: int) -> bytes:
    """One record, read from its offset alone."""
    system, path = _filesystem(folder)
    with system.open_input_file(f"{path}/{archive}") as stream:
        return next(_frames(stream, offset))[1]
