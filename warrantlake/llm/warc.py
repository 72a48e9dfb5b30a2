"""WARC records packaged in ZIP archives, written and read back by byte ranges.

An archive is a ZIP of stored members: ``archive/data.warc.gz``, in which every record is a gzip member of its
own, and ``indexes/index.cdx``, a line for each record with its offset and length there. The reader takes the
end-of-central-directory record from the archive's tail, follows the ZIP64 locator where sizes or counts ask for
it, parses the central directory, and from each local header finds where a stored member's bytes begin; then it
reads the index and, for each line, just the record's bytes. Nothing is extracted.

Of records whose payloads are equal and of at least ``LEAST_REVISIT`` bytes, that of the largest ``page_id`` is a
response and the others revisit it. Nulls: a null html is the empty payload; a null ``page_id`` or url is written
as an absent header and read back as null, and such a page is a response unless a payload's largest id is known.
Pages of equal id are records of their own. An empty table gives no archives and no rows. A payload that a third of
the pages share is salted where its response is told. Very long pages are records like others. Only ``page_id``,
``url`` and ``html`` are read, whatever other columns there are.

Archives lie in the shared folder, reached by ``pyarrow.fs``. A task writes under a name of its own attempt, and
the table of archives names those of the attempts that ended well.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warrantlake.llm.common import join_hot, shared_folder, written

LEAST_REVISIT, ARCHIVE_BYTES = 1000, 32_000_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
# Fixed values of the formats: ZIP signatures and the marks of fields that are found in the ZIP64 extension.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
WIDE16, WIDE32, ZIP64_TAG = 0xFFFF, 0xFFFFFFFF, 0x0001
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"


def _at(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit carries headers alone."""
    body = payload if kind == "response" else b""
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", None if page_id is None else f"<urn:page:{page_id}>"),
        ("WARC-Target-URI", None if url is None else json.dumps(url)[1:-1]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(size)),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("Content-Type", "text/html"),
        ("Content-Length", str(len(body))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None) + "\r\n"
    packer = zlib.compressobj(1, wbits=31)
    return packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a gzip member."""
    plain = zlib.decompress(member, wbits=31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


class ArchiveWriter:
    """A ZIP of stored members, written front to back; ``wide`` uses the ZIP64 fields throughout."""

    def __init__(self, out, wide: bool = False):
        self.out, self.wide, self.position, self.members = out, wide, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.position += len(data)

    def add(self, name: str, parts: list[bytes]) -> None:
        size, crc, start = sum(map(len, parts)), 0, self.position
        for part in parts:
            crc = zlib.crc32(part, crc)
        large = self.wide or size >= WIDE32
        extra = struct.pack("<HHQQ", ZIP64_TAG, 16, size, size) if large else b""
        shown = WIDE32 if large else size
        self._write(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x800, 0, 0, 0x21, crc, shown, shown, len(name), len(extra)) + name.encode() + extra)
        for part in parts:
            self._write(part)
        self.members.append((name, size, crc, start))

    def close(self) -> None:
        start = self.position
        for name, size, crc, at in self.members:
            large = self.wide or max(size, at) >= WIDE32
            extra = struct.pack("<HHQQQ", ZIP64_TAG, 24, size, size, at) if large else b""
            shown, place = (WIDE32, WIDE32) if large else (size, at)
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x800, 0, 0, 0x21, crc, shown, shown, len(name), len(extra), 0, 0, 0, 0, place) + name.encode() + extra)
        size, count = self.position - start, len(self.members)
        large = self.wide or max(start, size) >= WIDE32 or count >= WIDE16
        if large:
            end64 = self.position
            self._write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, size, start))
            self._write(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
            count, size, start = WIDE16, WIDE32, WIDE32
        self._write(struct.pack("<IHHHHIIH", END, 0, 0, count, count, size, start, 0))


class ArchiveReader:
    """Stored members of a ZIP by range reads of a random-access file."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.members = {name: (at, size) for name, at, size in self._directory()}

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("the archive ends early")
        return data

    def _end(self) -> tuple[int, int]:
        """Place and size of the central directory."""
        tail_at = max(0, self.size - 22 - WIDE16)
        tail = self._read(tail_at, self.size - tail_at)
        at = tail.rfind(struct.pack("<I", END), 0, max(0, len(tail) - 18))
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(struct.pack("<I", END), 0, at)
        if at < 0:
            raise ValueError("no end of a central directory")
        *_, count, size, start, _ = struct.unpack_from("<IHHHHIIH", tail, at)
        if WIDE16 == count or WIDE32 in (size, start):
            sign, _, end64, _ = struct.unpack("<IIQI", self._read(tail_at + at - 20, 20))
            if sign == LOCATOR64:
                fields = struct.unpack("<IQHHIIQQQQ", self._read(end64, 56))
                if fields[0] != END64:
                    raise ValueError("no ZIP64 end of a central directory")
                size, start = fields[8], fields[9]
        return start, size

    def _directory(self) -> Iterator[tuple[str, int, int]]:
        start, size = self._end()
        entries, at = self._read(start, size), 0
        while at < len(entries):
            sign, _, _, _, method, _, _, _, packed, plain, names, extras, notes, _, _, _, place = struct.unpack_from("<IHHHHHHIIIHHHHHII", entries, at)
            if sign != CENTRAL:
                raise ValueError("not an entry of a central directory")
            name = entries[at + 46 : at + 46 + names].decode()
            extra = entries[at + 46 + names : at + 46 + names + extras]
            while len(extra) >= 4:
                tag, length = struct.unpack_from("<HH", extra)
                if tag == ZIP64_TAG:
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                    plain, packed, place = (next(wide) if value == WIDE32 else value for value in (plain, packed, place))
                extra = extra[4 + length :]
            if method == 0:
                yield name, place, packed
            at += 46 + names + extras + notes

    def begin(self, name: str) -> int:
        """Where a member's bytes begin: behind its local header, whose extra field may differ in length."""
        at = self.members[name][0]
        head = struct.unpack("<IHHHHHIIIHH", self._read(at, 30))
        if head[0] != LOCAL:
            raise ValueError("no local header")
        return at + 30 + head[9] + head[10]

    def read(self, name: str, at: int = 0, size: int | None = None) -> bytes:
        whole = self.members[name][1]
        if at < 0 or at + (size or 0) > whole:
            raise ValueError("a range outside the member")
        return self._read(self.begin(name) + at, whole - at if size is None else size)

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """Every record that the index names, one range read for each."""
        begin, whole = self.begin(DATA), self.members[DATA][1]
        for line in self.read(INDEX).decode().splitlines():
            at, size = map(int, line.split(" ")[-2:])
            if at + size > whole:
                raise ValueError("a record outside its member")
            yield parse_record(self._read(begin + at, size))


def with_record_types(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_bytes, payload_digest, record_type and refers_to.

    Digests that are found more than once are told by a table of ids and digests; the html stays where it is.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    marked = pages.select("page_id", "url", "html", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    shared = marked.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    shared = written(shared.where("n > 1 and original is not null").withColumnRenamed("payload_digest", "shared_digest"), "originals")
    revisits = (F.col("payload_bytes") >= LEAST_REVISIT) & F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    # Small payloads have no partner: each gets a key of its own, so that they aren't dealt to one place.
    key = F.when(F.col("payload_bytes") >= LEAST_REVISIT, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    joined = join_hot(marked.withColumn("shared_digest", key), shared.select("shared_digest", "original"), "shared_digest", shared.select("shared_digest", "n")).drop("shared_digest")
    return joined.withColumns({"record_type": F.when(revisits, "revisit").otherwise("response"), "refers_to": F.when(revisits, F.col("original"))}).drop("original")


def write_archives(typed: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """One or more archives per partition, each of about ``archive_bytes`` at most; (archive, records)."""

    def archive(lines: list[str], parts: list[bytes]) -> tuple[str, int]:
        files, path = _at(folder)
        files.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.zip"
        with files.open_output_stream(f"{path}/{name}") as out:
            writer = ArchiveWriter(out)
            writer.add(DATA, parts)
            writer.add(INDEX, ["".join(lines).encode()])
            writer.close()
        return f"{folder}/{name}", len(lines)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, parts, at, made = [], [], 0, []
        for batch in batches:
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                data = record(row["page_id"], row["url"], row["record_type"], payload, row["payload_digest"], row["payload_bytes"], row["refers_to"])
                lines.append(f"{row['page_id']} {row['record_type']} {row['payload_digest']} {at} {len(data)}\n")
                parts.append(data)
                at += len(data)
                if at >= archive_bytes:
                    made.append(archive(lines, parts))
                    lines, parts, at = [], [], 0
        if lines:
            made.append(archive(lines, parts))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["archive", "records"])

    return written(typed.mapInArrow(write, "archive string, records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row (``RECORD``) for every record; a response's digest and length are those of the bytes read."""
    whole = lambda urn: None if urn is None else int(urn.rpartition(":")[2].rstrip(">"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                files, at = _at(path)
                rows = []
                with files.open_input_file(at) as file:
                    for headers, body in ArchiveReader(file).records():
                        digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["WARC-Payload-Length"])
                        if headers["WARC-Type"] == "response" and (hashlib.sha1(body).hexdigest(), len(body)) != (digest, size):
                            raise ValueError(f"{path}: a payload differs from its digest")
                        rows.append((whole(headers.get("WARC-Record-ID")), size, digest, headers["WARC-Type"], whole(headers.get("WARC-Refers-To")), path))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive"])

    tasks = archives.sparkSession.sparkContext.defaultParallelism
    return archives.repartition(max(1, min(archives.count(), 16 * tasks)), F.xxhash64("archive")).mapInArrow(read, RECORD)


def op3_zip_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long"), "url", "html")
    archives = write_archives(with_record_types(pages), f"{shared_folder(spark)}/warc")
    return read_archives(archives).drop("archive")
