"""Web archives in ZIP packages: writing, and reading records by their byte ranges.

A package is an uncompressed ZIP file that holds ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.cdxj``, one line per record with its place.  The reader parses the ZIP's directory from the end
of the file, with its 64-bit form, finds where the stored members begin, and reads nothing but the index and
the ranges of the records; a package without an index is walked record by record.

Files are opened through ``pyarrow.fs``, so a folder may be local to all machines or an object store.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.work import unused, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

#: A package is closed once it holds so many bytes; records shorter than this are never revisits.
PACKAGE_BYTES = 256 << 20
LEAST_REVISIT = 100

#: Bytes read at once.
_CHUNK = 4 << 20

_RECORD_ID = "urn:x-page:"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

ReadAt = Callable[[int, int], bytes]


# --- one package ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    """A file of a ZIP package: its stored bytes begin at ``start``."""

    name: str
    method: int
    start: int
    size: int


def _directory(read: ReadAt, size: int) -> tuple[int, int, int]:
    """Place, length and number of entries of the central directory."""
    tail_at = max(0, size - 22 - 65535)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0:
        # the comment that follows must reach to the end of the file
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("not a ZIP package")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read(tail_at + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("the package lacks its 64-bit directory")
        end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("the package's 64-bit directory is broken")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    return start, length, count


def members(read: ReadAt, size: int) -> dict[str, Member]:
    """The files of a package of ``size`` bytes, by name; ``read(start, length)`` gives its bytes."""
    start, length, count = _directory(read, size)
    directory, at, found = read(start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the package's directory is broken")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        stored, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        at += 46 + n_name + n_extra + n_note
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # 64-bit values, for those that don't fit in 32 bits, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                stored = next(values) if stored == 0xFFFFFFFF else stored
                header = next(values) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        local = read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} is not where the directory says")
        own_name, own_extra = struct.unpack_from("<HH", local, 26)
        found[name] = Member(name, method, header + 30 + own_name + own_extra, stored)
    return found


def _stored(found: dict[str, Member], name: str) -> Member:
    member = found[name]
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{name} is compressed: its records can't be read by range")
    return member


def ranges(read: ReadAt, size: int) -> Iterator[tuple[int, int | None]]:
    """Place and length of every record; the length is None where no index tells it."""
    found = members(read, size)
    data = _stored(found, DATA)
    if INDEX in found:
        index = _stored(found, INDEX)
        rest, at = b"", 0
        while at < index.size or rest:
            part = read(index.start + at, min(_CHUNK, index.size - at)) if at < index.size else b"\n"
            at += len(part) if at < index.size else 0
            *lines, rest = (rest + part).split(b"\n")
            for line in lines:
                if line:
                    entry = json.loads(line[line.index(b"{") :])
                    yield data.start + int(entry["offset"]), int(entry["length"])
        return
    at = 0
    while at < data.size:
        length = _record_length(read, data.start + at, data.size - at)
        yield data.start + at, length
        at += length


def _record_length(read: ReadAt, start: int, most: int) -> int:
    """Length of the gzip member that starts here."""
    unzip, at = zlib.decompressobj(31), 0
    while not unzip.eof:
        part = read(start + at, min(_CHUNK, most - at))
        if not part:
            raise ValueError("the last record is cut off")
        at += len(part)
        while part and not unzip.eof:
            unzip.decompress(part, _CHUNK)
            part = unzip.unconsumed_tail
    return at - len(unzip.unused_data)


def record(packed: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case, and block, of one record's bytes."""
    plain = zlib.decompress(packed, 31) if packed[:2] == b"\x1f\x8b" else packed
    end = plain.find(b"\r\n\r\n")
    if not plain.startswith(b"WARC/") or end < 0:
        raise ValueError("not a WARC record")
    headers = {}
    for line in plain[:end].decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, plain[end + 4 : end + 4 + int(headers["content-length"])]


def _line(value: str) -> str:
    """A header value on one line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in value)


def _packed_record(page, url, digest, payload: bytes, refers_to, at: str) -> bytes:
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    name = f"{_RECORD_ID}{page}" if page is not None else f"urn:uuid:{uuid.uuid4()}"
    headers = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>"]
    headers += [f"WARC-Date: {at}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        headers.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        headers.append(f"WARC-Refers-To: <{_RECORD_ID}{refers_to}>")
        headers.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    headers += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    headers.append(f"Content-Length: {len(block)}")
    plain = "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
    return zipped.compress(plain) + zipped.flush()


def write_package(stream, rows: Iterator[tuple], at: str, most: int = PACKAGE_BYTES) -> int:
    """Write rows (page, url, digest, payload, refers_to) until the package is full; number of records."""
    lines, place = [], 0
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        with package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
            for page, url, digest, payload, refers_to in rows:
                packed = _packed_record(page, url, digest, payload, refers_to, at)
                data.write(packed)
                entry = {"offset": place, "length": len(packed), "digest": f"sha256:{digest}"}
                lines.append(f"{_line(url or '-')} {at} {json.dumps(entry)}")
                place += len(packed)
                if place >= most:
                    break
        with package.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            for line in lines:
                index.write(line.encode() + b"\n")
    return len(lines)


# --- all packages --------------------------------------------------------------------------------


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def with_records(
    pages: DataFrame, page: str = "page_id", payload: str = "html", least: int = LEAST_REVISIT
) -> DataFrame:
    """``pages`` with ``payload_digest`` (SHA-256, hex), ``record_type`` and ``refers_to``.

    Of the rows with one payload of at least ``least`` bytes those with the smallest page are responses, and
    the others revisit it; a shorter payload is always a response.  A null payload is empty, a null page comes
    after all others and, alone, is a response.  Columns of these names are replaced.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.withColumn("payload_digest", F.sha2(body, 256))
    first = unused(rows, "_first")
    copies = rows.where(F.octet_length(body) >= least).groupBy("payload_digest")
    copies = copies.agg(F.min(page).alias(first), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    # Stored, so that the join deals both sides anew and a payload that very many rows have can be split.
    found = rows.join(written(copies, "copied-payloads"), "payload_digest", "left")
    revisits = F.col(first).isNotNull() & ~F.col(page).eqNullSafe(F.col(first))
    found = found.withColumns(
        {
            "record_type": F.when(revisits, "revisit").otherwise("response"),
            "refers_to": F.when(revisits, F.col(first)),
        }
    )
    kept = [c for c in pages.columns if c not in ("payload_digest", "record_type", "refers_to")]
    return found.select(*(F.col(f"`{c}`") for c in kept), "payload_digest", "record_type", "refers_to")


def written_packages(
    pages: DataFrame,
    folder: str,
    date: str,
    page: str = "page_id",
    url: str = "url",
    payload: str = "html",
    package_bytes: int = PACKAGE_BYTES,
) -> DataFrame:
    """Write ``pages`` into packages under ``folder``; one row per package: ``path``, ``records``.

    Every task writes packages under names of its own, and only those of tasks that succeeded are in the
    result, so that a repeated task leaves no record twice.  ``date`` is the records' WARC-Date.
    """
    rows = with_records(pages, page, payload)
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = rows.select(
        F.col(page).cast("bigint").alias("page"),
        F.col(url).cast("string").alias("url"),
        F.col("payload_digest").alias("digest"),
        body.alias("payload"),
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(folder)
        system.create_dir(base, recursive=True)
        every = (tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(len(b)))
        waiting = next(every, None)
        while waiting is not None:
            name = f"{uuid.uuid4().hex}.wacz"
            with system.open_output_stream(f"{base}/{name}") as stream:
                n = write_package(stream, itertools.chain([waiting], every), date, package_bytes)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})
            waiting = next(every, None)

    return written(rows.mapInArrow(write, "path string, records long"), "packages")


def read_packages(paths: DataFrame, path: str = "path") -> DataFrame:
    """All records of the packages that ``paths`` names, read by range.

    Columns ``page_id``, ``url``, ``record_type``, ``refers_to``, ``payload_bytes``, ``payload_digest`` (of the
    full payload: as read for a response, as recorded for a revisit) and ``payload`` (null for a revisit).  A
    response whose payload isn't the recorded one raises an error.  Null paths are left out.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, at = _opened(name)
                with system.open_input_file(at) as file:
                    read = lambda start, n: file.read_at(n, start)  # noqa: B023, E731
                    group: list[tuple[int, int | None]] = []
                    for found in ranges(read, file.size()):
                        group.append(found)
                        if len(group) == 10_000:
                            yield _places(name, group)
                            group = []
                    yield _places(name, group)

    def _places(name: str, group: list[tuple[int, int | None]]) -> pa.RecordBatch:
        columns = {"path": [name] * len(group), "start": [a for a, _ in group], "length": [n for _, n in group]}
        return pa.RecordBatch.from_pydict(columns, pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        for batch in batches:
            out: list[dict] = []
            size = 0
            for name, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != opened:
                    system, at = _opened(name)
                    opened, file = name, system.open_input_file(at)
                out.append(_row(file.read_at(length, start)))
                size += length
                if size >= _CHUNK:
                    yield pa.RecordBatch.from_pylist(out, _ROW)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, _ROW)

    names = paths.where(F.col(path).isNotNull()).select(F.col(path).alias("path"))
    places = written(names.mapInArrow(find, "path string, start long, length long"), "places")
    # A package's records are dealt in blocks of neighbours, so that large ones are read by many tasks; how many is a
    # matter of the records' sizes, of which the places show nothing.
    total = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(places.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    block = F.floor(F.col("start") / BLOCK_BYTES)
    dealt = places.repartition(tasks, "path", block).sortWithinPartitions("path", "start")
    return dealt.mapInArrow(
        fetch,
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
        "payload binary",
    )


#: Bytes of packages that a task reads, on average, and bytes of neighbours that stay together.
TASK_BYTES = 32 << 20
BLOCK_BYTES = 2 << 20

_ROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def _page(name: str | None) -> int | None:
    name = (name or "").strip("<>")
    return int(name[len(_RECORD_ID) :]) if name.startswith(_RECORD_ID) else None


def _row(packed: bytes) -> dict:
    headers, block = record(packed)
    kind = headers["warc-type"]
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    payload, length = None, int(headers.get("x-payload-length", 0))
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        found = hashlib.sha256(payload).hexdigest()
        if digest and found != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} is not the recorded one")
        digest, length = found, len(payload)
    return {
        "page_id": _page(headers.get("warc-record-id")),
        "url": headers.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _page(headers.get("warc-refers-to")),
        "payload_bytes": length,
        "payload_digest": digest,
        "payload": payload,
    }
