"""Web archives in ZIP packages: writing, and reading records by range.

A package holds stored (not deflated) members: ``archive/data.warc.gz``, each
record a gzip member of its own, and ``indexes/index.cdxj`` with the place of
each record. The reader takes the end of the file, the central directory (and
its ZIP64 forms) and the local headers to find where members lie, reads the
index, and then only the bytes of the records asked for.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small_batches, table

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payload bytes of a package.
PACKAGE = 64_000_000
#: Records read by a task at a time.
RUN = 500
#: Fixed values of the ZIP format: signatures and the 16- and 32-bit marks.
LOCAL, CENTRAL, END, END64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
MARK16, MARK32 = 0xFFFF, 0xFFFFFFFF


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def target_uri(url: str | None, page_id: int | None) -> str:
    """A header line can't hold line ends; a page without a URL gets a name."""
    return "".join(c for c in url or f"urn:page:{page_id}" if c >= " ")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 record as a gzip member; a revisit has no payload of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Target-URI: {target_uri(url, page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is None:
        block += payload
    else:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", mtime=0, compresslevel=6)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload as stored, and the payload's length by its HTTP header."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, payload, length


class ZipWriter:
    """Stored members one after another, with ZIP64 fields where sizes need them."""

    def __init__(self, out, big: int = MARK32):
        self.out, self.at, self.members, self.big = out, 0, [], big

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, chunks: list[bytes]) -> int:
        """Writes a member; gives where its data starts."""
        size, crc = sum(map(len, chunks)), 0
        for c in chunks:
            crc = zlib.crc32(c, crc)
        raw, start = name.encode(), self.at
        wide = size >= self.big
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        shown = MARK32 if wide else size
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra)))
        self._put(raw + extra)
        data_at = self.at
        for c in chunks:
            self._put(c)
        self.members.append((raw, crc, size, start))
        return data_at

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.members:
            wide = [x for x in (size, size, at) if x >= self.big]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            cut = lambda x: MARK32 if x >= self.big else x
            self._put(
                struct.pack(
                    "<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x800, 0, 0, 0x21, crc, cut(size), cut(size),
                    len(raw), len(extra), 0, 0, 0, 0, cut(at),
                )
                + raw
                + extra
            )
        size, n = self.at - start, len(self.members)
        if max(start, size) >= self.big or n >= MARK16:
            end = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<IIQI", LOCATOR, 0, end, 1))
            n, size, start = MARK16, MARK32, MARK32
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, n, n, size, start, 0))


def read_range(source, at: int, size: int) -> bytes:
    source.seek(at)
    return source.read(size)


def members(source, size: int) -> dict[str, tuple[int, int]]:
    """Where the data of each stored member lies: name to (start, length)."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = read_range(source, tail_at, size - tail_at)
    at = tail.rfind(struct.pack("<I", END))
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, length, start, _ = struct.unpack("<IHHHHIIH", tail[at : at + 22])
    if MARK16 == n or MARK32 in (length, start):
        signature, _, end64, _ = struct.unpack("<IIQI", read_range(source, tail_at + at - 20, 20))
        if signature != LOCATOR:
            raise ValueError("no ZIP64 locator")
        fields = struct.unpack("<IQHHIIQQQQ", read_range(source, end64, 56))
        if fields[0] != END64:
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = fields[7:]
    directory, found, at = read_range(source, start, length), {}, 0
    for _ in range(n):
        f = struct.unpack("<IHHHHHHIIIHHHHHII", directory[at : at + 46])
        if f[0] != CENTRAL:
            raise ValueError("broken central directory")
        stored, whole, names, extras, notes, place = f[8], f[9], f[10], f[11], f[12], f[16]
        name = directory[at + 46 : at + 46 + names].decode()
        extra = directory[at + 46 + names : at + 46 + names + extras]
        at += 46 + names + extras + notes
        while len(extra) >= 4:
            kind, width = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{width // 8}Q", extra[4 : 4 + width // 8 * 8]))
                whole = next(wide) if whole == MARK32 else whole
                stored = next(wide) if stored == MARK32 else stored
                place = next(wide) if place == MARK32 else place
            extra = extra[4 + width :]
        if f[4] != 0:
            raise ValueError(f"{name} is not stored")
        local = struct.unpack("<IHHHHHIIIHH", read_range(source, place, 30))
        if local[0] != LOCAL:
            raise ValueError("broken local header")
        found[name] = (place + 30 + local[9] + local[10], stored)
    return found


def _store(folder: str, package: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        held, size = [], 0

        def close():
            # the name is new for each attempt, and only a finished file is listed
            path = f"{base}/{uuid.uuid4().hex}.wacz"
            chunks, lines, at = [], [], 0
            for page, url, html, refers in held:
                got = record(page, url, html, refers)
                line = {"page_id": page, "url": target_uri(url, page), "offset": at, "length": len(got)}
                lines.append(json.dumps(line) + "\n")
                chunks.append(got)
                at += len(got)
            with where.open_output_stream(path) as out:
                zipped = ZipWriter(out)
                zipped.add(ARCHIVE, chunks)
                zipped.add(INDEX, ["".join(lines).encode()])
                zipped.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([len(held)], pa.int64())], names=["path", "records"]
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[2])
                if size > package:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return run


def write_packages(
    df: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    package: int = PACKAGE,
) -> DataFrame:
    """Writes a record for each row; gives ``path`` and ``records`` of packages.

    Of rows with equal payloads of ``least_bytes`` or more, the one of least id
    is a response and the others revisit it. Payloads are compared by SHA-1, in
    a grouping that sends one row for each payload and task.

    Defined cases: null html is an empty payload; a null id is greater than all
    others; rows repeated with the least id are all responses; other columns
    are not stored; an empty table gives no package.
    """
    small_batches(df.sparkSession, 500)
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html).alias("sha")
    )
    first = (
        rows.where(F.octet_length("html") >= least_bytes)
        .groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("sha", "first")
    )
    revisit = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    # written before the pages meet it: Spark can then split a payload of very many pages
    listed = rows.join(table(first, "first"), "sha", "left").select("page_id", "url", "html", revisit.alias("refers_to"))
    return table(listed.mapInArrow(_store(folder, package), "path string, records long"), "packages")


def _open(folder: str, path: str):
    where, _ = fs.FileSystem.from_uri(folder)
    return where.open_input_file(path)


def _list(folder: str, run_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(folder, path) as source:
                    found = members(source, source.size())
                    lines = read_range(source, *found[INDEX]).splitlines()
                    data_at = found[ARCHIVE][0]
                places = [json.loads(x) for x in lines]
                runs = [places[k : k + run_length] for k in range(0, len(places), run_length)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(runs), pa.string()),
                        pa.array([[data_at + p["offset"] for p in r] for r in runs], pa.list_(pa.int64())),
                        pa.array([[p["length"] for p in r] for r in runs], pa.list_(pa.int64())),
                    ],
                    names=["path", "starts", "lengths"],
                )

    return run


def _fetch(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        names = ["page_id", "url", "record_type", "digest", "payload_bytes", "refers_to", "payload"]
        for batch in batches:
            for path, starts, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                with _open(folder, path) as source:
                    for at, size in zip(starts, lengths, strict=True):
                        h, payload, length = parse_record(read_range(source, at, size))
                        number = lambda key: int(h[key]) if key in h else None  # noqa: B023, E731
                        kind = h["WARC-Type"]
                        rows.append(
                            (
                                number("X-Page-ID"), h["WARC-Target-URI"], kind,
                                h["WARC-Payload-Digest"].removeprefix("sha1:"), length,
                                number("X-Refers-To-Page-ID"), payload if kind == "response" else None,
                            )
                        )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
                )

    return run


def read_packages(packages: DataFrame, folder: str, run_length: int = RUN) -> DataFrame:
    """The records of the packages that ``packages`` lists under ``path``.

    Packages are opened once for their directories and indexes; the records
    are then dealt out in runs, so one large package is read by many tasks.
    Revisits have a null ``payload``.
    """
    runs = packages.select("path").mapInArrow(
        _list(folder, run_length), "path string, starts array<long>, lengths array<long>"
    )
    dealt = runs.repartition(F.col("path"), F.col("starts")[0])
    return dealt.mapInArrow(
        _fetch(folder),
        "page_id long, url string, record_type string, digest string, payload_bytes long, refers_to long, payload binary",
    )


def archive_folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return new_path(spark, "warc")
