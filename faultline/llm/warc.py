"""WARC archives with a two-level capture index.

Records are written as gzip members of archive files in the shared folder, one set of
files per task; the rows a task returns name the files of the attempt that succeeded, so what a
lost attempt left behind is never read. The index holds reversed-host keys, sorted over all
captures and cut into compressed blocks, and a sparse directory with the first key of
each block. A lookup searches the directory by halving, opens the blocks it names, and reads
byte ranges of the archives.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.skew import attach, by_size, held
from faultline.llm.words import few_rows
from faultline.session import new_folder

# Payloads of at least so many bytes are written once; later ones revisit them.
LEAST_BYTES = 100
ARCHIVE_BYTES = 256 << 20
# Lines of a block, and how many blocks the directory may name before blocks get longer.
BLOCK_LINES, MOST_BLOCKS = 3000, 100_000
# Stands for a null page_id in keys and record ids.
NO_ID = -(1 << 63)
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

ENTRIES = "urlkey string, page_id long, record_type string, archive string, offset long, length long"
NAMES = [part.split()[0] for part in ENTRIES.split(", ")]


def reversed_host(url: str | None) -> str:
    """Sort key of a URL: host labels from the right, port, then path and query, in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    labels = ",".join(reversed(host.removeprefix("www.").split(".")))
    plain = {"http": 80, "https": 443}.get(parts.scheme)
    place = labels + (f":{port}" if port and port != plain else "")
    return f"{place}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def header_text(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value)


def record_bytes(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP head alone, which states the full length."""
    block = HTTP.format(len(payload)).encode() + (b"" if refers_to is not None else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url:
        lines.append(f"WARC-Target-URI: {header_text(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def parse_record(member: bytes) -> dict:
    """The fields of one record; raises if it is cut short or its payload is not the one it states."""
    raw = gzip.decompress(member)
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise ValueError("no WARC record here")
    fields = parse_head(head)
    length = int(fields["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise ValueError("a WARC record ends too early")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    size = int(parse_head(http)["content-length"])
    refers = fields.get("warc-refers-to")
    if refers is None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    return {
        "page_id": int(fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": None if refers is None else int(refers.removeprefix("<urn:page:").removesuffix(">")),
        "payload": payload if refers is None else None,
    }


def file_system(folder: str):
    """The file system of a folder and the path in it, for tasks: local, mounted or remote."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_records(folder: str, archive_bytes: int):
    """mapInArrow: (page_id, url, payload, digest, refers_to) to ENTRIES; writes archives below ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        attempt = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        stream, name, offset, number = None, "", 0, 0
        try:
            for batch in few_rows(batches):
                rows = []
                for page, url, payload, digest, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if stream is None or offset >= archive_bytes:
                        if stream is not None:
                            stream.close()
                        name, offset, number = f"{attempt}-{number:04d}.warc.gz", 0, number + 1
                        stream = system.open_output_stream(f"{path}/{name}", compression=None)
                    member = record_bytes(page, url, payload, digest, refers)
                    stream.write(member)
                    kind = "response" if refers is None else "revisit"
                    rows.append((reversed_host(url), page, kind, name, offset, len(member)))
                    offset += len(member)
                yield entry_batch(rows)
        finally:
            if stream is not None:
                stream.close()

    return run


def entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(NAMES)
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)


def payloads(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    return pages.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))


def first_pages(rows: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that revisit another; payloads of at least ``least_bytes``."""
    narrow = held(
        rows.select("page_id", F.when(F.octet_length("payload") >= least_bytes, F.col("digest")).alias("digest")), "digests"
    )
    groups = held(
        narrow.filter(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min("page_id").alias("first"))
        .filter("group_size > 1"),
        "equal-payloads",
    )
    return (
        attach(narrow, groups, "digest", "page_id", ["first"])
        .filter(F.col("first").isNotNull() & (F.col("first") != F.col("page_id")))
        .select(F.col("page_id").alias("_id"), F.unhex("digest").alias("_sha"), F.col("first").alias("refers_to"))
        .distinct()
    )


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, **columns: str) -> DataFrame:
    """Write a record per page into archives below ``folder``; returns the capture entries, held."""
    file_system_here, path = file_system(folder)
    file_system_here.create_dir(path, recursive=True)
    rows = payloads(pages, **columns)
    revisits = by_size(first_pages(rows), "revisits")
    # By payload as well: rows that repeat a page_id may differ in it.
    same = (F.col("page_id") == F.col("_id")) & (F.unhex("digest") == F.col("_sha"))
    joined = rows.join(revisits, same, "left").select("page_id", "url", "payload", "digest", "refers_to")
    return held(joined.mapInArrow(write_records(folder, archive_bytes), ENTRIES), "captures")


BLOCKS = "block long, first_key string, first_page long, lines int, body binary"


def pack_blocks(size: int):
    """mapInArrow over sorted entries: blocks of ``size`` lines, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []

        def packed(rows: list[tuple], number: int) -> pa.RecordBatch:
            body = zlib.compress(entries_text(rows), 6)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number]),
                    pa.array([rows[0][0]]),
                    pa.array([rows[0][1]]),
                    pa.array([len(rows)], pa.int32()),
                    pa.array([body], pa.binary()),
                ],
                names=["block", "first_key", "first_page", "lines", "body"],
            )

        for batch in batches:
            waiting += zip(*[c.to_pylist() for c in batch.columns], strict=True)
            while len(waiting) >= size:
                yield packed(waiting[:size], block)
                waiting, block = waiting[size:], block + 1
        if waiting:
            yield packed(waiting, block)

    return run


def entries_text(rows: list[tuple]) -> bytes:
    """Entries as Arrow stream bytes: keys may hold any character."""
    sink = pa.BufferOutputStream()
    batch = entry_batch(rows)
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (body) of blocks to their ENTRIES."""
    for batch in batches:
        for body in batch.column(0).to_pylist():
            yield from pa.ipc.open_stream(zlib.decompress(body))


class CaptureIndex:
    """Compressed blocks of captures sorted by (key, page), and the first key of each."""

    def __init__(self, entries: DataFrame, block_lines: int = BLOCK_LINES):
        total = entries.count()
        # Longer blocks, not more of them, keep the directory small enough to be sent to every task.
        size = max(block_lines, -(-total // MOST_BLOCKS))
        self.blocks = held(
            entries.repartitionByRange("urlkey", "page_id", "archive", "offset")
            .sortWithinPartitions("urlkey", "page_id", "archive", "offset")
            .mapInArrow(pack_blocks(size), BLOCKS),
            "capture-blocks",
        )
        self.directory = sorted(
            (r.first_key.encode(), r.first_page, r.block)
            for r in self.blocks.select("first_key", "first_page", "block").collect()
        )

    def lookup(self, queries: DataFrame) -> DataFrame:
        """ENTRIES of the asked (urlkey, page_id); only blocks that may hold one are opened."""
        directory = queries.sparkSession.sparkContext.broadcast(self.directory)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = directory.value
            for batch in batches:
                hits = set()
                # Captures of one key may run over many blocks, and begin at the end of the one before.
                for key, page in set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    first = bisect_left(table, (key.encode(), page)) - 1
                    last = bisect_right(table, (key.encode(), page, 1 << 62)) - 1
                    hits.update(table[at][2] for at in range(max(first, 0), last + 1))
                yield pa.RecordBatch.from_arrays([pa.array(sorted(hits), pa.int64())], names=["_block"])

        asked = queries.select("urlkey", "page_id")
        hit = asked.mapInArrow(search, "_block long").distinct()
        # No more rows than the directory has.
        opened = self.blocks.join(F.broadcast(hit), F.col("block") == F.col("_block"), "left_semi")
        entries = opened.select("body").mapInArrow(open_blocks, ENTRIES)
        wanted = asked.select(F.col("urlkey").alias("_key"), F.col("page_id").alias("_page")).distinct()
        return entries.join(
            wanted, (F.col("page_id") == F.col("_page")) & (F.col("urlkey") == F.col("_key")), "left_semi"
        )


RECORDS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)


def read_ranges(folder: str, with_payload: bool):
    """mapInArrow over entries sorted by archive and offset: RECORDS, by range reads."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [part.split()[0] for part in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        name, stream = None, None
        try:
            for batch in few_rows(batches):
                rows = []
                for archive, offset, length in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                    if archive != name:
                        if stream is not None:
                            stream.close()
                        name, stream = archive, system.open_input_file(f"{path}/{archive}")
                    record = parse_record(stream.read_at(length, offset))
                    if not with_payload:
                        record["payload"] = None
                    rows.append([record[n] for n in names])
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
                )
        finally:
            if stream is not None:
                stream.close()

    return run


def read_records(entries: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """RECORDS of the given entries. Tasks get neighbouring ranges, in the order they stand in the archives."""
    return (
        entries.select("archive", "offset", "length")
        .repartitionByRange("archive", "offset")
        .sortWithinPartitions("archive", "offset")
        .mapInArrow(read_ranges(folder, with_payload), RECORDS)
    )


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (url, page_id) to (urlkey, page_id)."""
    for batch in batches:
        keys = [reversed_host(u) for u in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), batch.column(1).cast(pa.int64())], names=["urlkey", "page_id"]
        )


def archive_pages(pages: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, read back from archives.

    A null page is an empty payload; a null URL has an empty key. Equal payloads of at
    least 100 bytes are written once, by the smallest page_id; shorter ones every time. Rows that
    repeat a page_id are records of their own and come back as often. No rows give no archive.
    """
    folder = new_folder(pages.sparkSession, "warc")
    entries = write_archives(pages, folder)
    index = CaptureIndex(entries, block_lines)
    queries = pages.select("url", F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id")).mapInArrow(keyed, "urlkey string, page_id long")
    found = read_records(index.lookup(queries), folder)
    return found.select(
        F.nullif("page_id", F.lit(NO_ID)).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.nullif("refers_to", F.lit(NO_ID)).alias("refers_to"),
    )
