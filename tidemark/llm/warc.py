"""WARC archives: a writer that deduplicates payloads, and a splittable reader.

Writing: every row becomes one gzip member. Of rows with equal payloads of at least LEAST_BYTES, the one with the largest
id is the response and the others are revisits that refer to it; their records keep the HTTP headers, and with them the
length of the payload, but not the payload. A task writes one file and moves it into place when it is whole.

Reading: archives are cut into byte ranges. A task scans its range for the magic bytes of gzip and validates a candidate by
decoding it: it has to inflate to a WARC header with a length, and what follows the member has to be another member or
the end of the file. It owns the records that start in its range and reads the last one beyond it. Within a member that
is read, nothing is scanned.

Nulls: a null payload is empty, a null URL is an empty target, rows with a null id are never the largest unless all are,
and read back with a null id. Rows that repeat the largest id are all responses. An empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_path, slices, written
from tidemark.llm.storage import Publish, open_read

LEAST_BYTES = 1000
#: Ranges are cut so that every core has a few, within these sizes.
LEAST_SPLIT, MOST_SPLIT = 4 << 20, 128 << 20
CHUNK = 1 << 18
MAGIC = b"\x1f\x8b\x08"
LEVEL = 6
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
ID = "urn:page:"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit if it refers to another page."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<{ID}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is None:
        return member(headers, http + payload)
    return member([*headers, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{ID}{refers_to}>")], http)


def with_referred(pages: DataFrame, id_column: str, payload_column: str) -> DataFrame:
    """pages with refers_to: the id of the response whose payload the row repeats, else null.

    Digests are counted with partial sums; only those that repeat are joined back, a row for each digest. These are the hash
    tables of the join, so payloads pass one exchange and no sort, and adaptive execution splits a digest that very many
    rows have.
    """
    payload = F.coalesce(F.col(payload_column), F.lit("")).cast("binary")
    rows = pages.withColumn("payload", payload)
    small, large = (rows.filter(x) for x in (F.octet_length("payload") < LEAST_BYTES, F.octet_length("payload") >= LEAST_BYTES))
    large = large.withColumn("payload_digest", F.sha1("payload"))
    groups = large.groupBy("payload_digest").agg(F.max(id_column).alias("largest"), F.count("*").alias("n"))
    large = large.join(groups.filter("n > 1").drop("n").hint("shuffle_hash"), "payload_digest", "left")
    refers = F.when(F.col("largest").isNotNull() & ~F.col(id_column).eqNullSafe(F.col("largest")), F.col("largest"))
    large = large.withColumn("refers_to", refers).drop("largest", "payload_digest")
    # small ones repeat nothing and stay where they are
    return large.unionByName(small.withColumn("refers_to", F.lit(None).cast(large.schema["refers_to"].dataType)))


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Write pages as archives; (path, bytes, records) of each file, a small table that is written too."""
    rows = with_referred(pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(payload_column).alias("html")), "page_id", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():06d}.warc.gz"
        out, size, count = None, 0, 0
        for batch in batches:
            for part in slices(batch):
                out = out or Publish(path, str(task.taskAttemptId()))
                for row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    data = record(*row)
                    out.write(data)
                    size, count = size + len(data), count + 1
        if out:
            out.commit()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["path", "bytes", "records"])

    return written(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, bytes long, records long"), "manifest")


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int


class Window:
    """A file read forward in chunks, with only the bytes from `base` on kept."""

    def __init__(self, file: BinaryIO, at: int):
        self.file, self.base, self.data, self.ended = file, at, bytearray(), False
        file.seek(at)

    def more(self) -> bool:
        chunk = b"" if self.ended else self.file.read(CHUNK)
        self.ended = not chunk
        self.data += chunk
        return bool(chunk)

    def drop(self, upto: int) -> None:
        del self.data[: upto - self.base]
        self.base = upto

    def fill(self, n: int) -> None:
        while len(self.data) < n and self.more():
            pass


def parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def member_at(window: Window, checked: bool) -> Record | None:
    """The record that starts at the window's base, which then moves behind it; None, and no move, if there is none.

    checked: the place is known to be the end of a member, so what follows needs no look.
    """
    unpack = zlib.decompressobj(31)
    text, at, head = bytearray(), 0, -1
    while not unpack.eof:
        if at >= len(window.data) and not window.more():
            return None
        chunk = window.data[at : at + CHUNK]
        at, seen = at + len(chunk), len(text)
        try:
            text += unpack.decompress(chunk)
        except zlib.error:
            return None
        if head < 0:
            # a header may be of any length: its URL is
            if text[:5] != b"WARC/"[: len(text)]:
                return None
            head = text.find(b"\r\n\r\n", max(0, seen - 3))
    if head < 0:
        return None
    headers = parsed(bytes(text[:head]))
    length = headers.get("content-length", "")
    if not length.isdigit() or len(text) < head + 4 + int(length):
        return None
    end = at - len(unpack.unused_data)
    if not checked:
        window.fill(end + len(MAGIC))
        if window.data[end : end + len(MAGIC)] not in (b"", MAGIC):
            return None
    start = window.base
    window.drop(start + end)
    return Record(headers, bytes(text[head + 4 : head + 4 + int(length)]), start)


class DamagedArchiveError(ValueError):
    """A record that is known to begin at a place cannot be read there."""


def records(file: BinaryIO, start: int, end: int, damaged: str = "skip") -> Iterator[Record | int]:
    """The records that start in [start, end).

    Where a record has to begin - at the file's start and behind each record - but cannot be read, that is an error if
    damaged is 'raise'; with 'report' its place is given instead of it. Then, as with 'skip', the search for the next
    one goes on.
    """

    def complain(place: int) -> Iterator[int]:
        if damaged == "raise":
            raise DamagedArchiveError(f"no whole record at byte {place}")
        if damaged == "report":
            yield place

    window, checked = Window(file, start), start == 0
    while window.base < end:
        window.fill(len(MAGIC))
        if window.data.startswith(MAGIC):
            found = member_at(window, checked)
            if found:
                checked = True
                yield found
                continue
        if checked and window.data:
            yield from complain(window.base)
        checked = False
        place = window.data.find(MAGIC, 1)
        if place < 0:
            # keep the last bytes: the magic may go on in the next chunk
            keep = min(len(MAGIC) - 1, max(0, len(window.data) - 1))
            window.drop(window.base + len(window.data) - keep)
            if not window.more():
                return
            if not window.data.startswith(MAGIC):
                place = window.data.find(MAGIC)
                window.drop(window.base + (place if place >= 0 else len(window.data) - len(MAGIC) + 1))
        else:
            window.drop(window.base + place)
    if checked and damaged != "skip":
        # the next record begins behind the range, whose reader does not know that one has to begin there
        window.fill(len(MAGIC))
        if window.data and not member_at(window, True):
            yield from complain(window.base)


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean, payload binary"


def row_of(found: Record) -> tuple:
    head, _, payload = found.block.partition(b"\r\n\r\n")
    number = lambda x: int(y) if (y := (x or "").strip("<>").removeprefix(ID)).lstrip("-").isdigit() else None
    stated = base64.b32decode(found.headers.get("warc-payload-digest", "").partition(":")[2]).hex()
    kind = found.headers.get("warc-type")
    url = unquote(found.headers.get("warc-target-uri", ""))
    page = number(found.headers.get("warc-record-id"))
    if kind == "revisit":
        return page, url, kind, int(parsed(head).get("content-length", 0)), stated, number(found.headers.get("warc-refers-to")), True, None
    digest = hashlib.sha1(payload).hexdigest()
    return page, url, kind, len(payload), digest, None, digest == stated, payload


#: The record_type of a place where a record has to begin but cannot be read.
DAMAGED = "damaged"


def read_archives(files: DataFrame, split_bytes: int | None = None, payload: bool = True, damaged: str = "raise") -> DataFrame:
    """One row a record. files: (path, bytes); they are cut into ranges of split_bytes, each read by a task of its own.

    A record that is known to be there but cannot be read is an error; with damaged='report' it is a row of type DAMAGED
    that has its file as url and its place as payload_bytes and is not intact, with 'skip' it is passed over. Each range
    looks at the record behind its last one too. Of several damaged records in a row, only the first is known: who knows
    how many records there are, as `archived` does, compares. intact: whether the payload has the digest that the record
    states.
    """
    if split_bytes is None:
        total = files.agg(F.sum("bytes")).first()[0] or 0
        split_bytes = min(max(total // (4 * files.sparkSession.sparkContext.defaultParallelism), LEAST_SPLIT), MOST_SPLIT)
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0
    ranges = files.filter("bytes > 0").select("path", F.explode(cuts).alias("start")).withColumn("end", F.col("start") + split_bytes).repartition(max(1, n))
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
    if not payload:
        names, kinds = names[:-1], kinds[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_read(path) as file:
                    rows, size = [], 0
                    for found in records(file, start, end, damaged):
                        if isinstance(found, int):
                            rows.append((None, path, DAMAGED, found, None, None, False, None)[: len(names)])
                            continue
                        rows.append(row_of(found)[: len(names)])
                        size += len(found.block)
                        if size > CHUNK * 16:
                            yield packed(rows)
                            rows, size = [], 0
                    if rows:
                        yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return ranges.mapInArrow(run, READ if payload else READ.rpartition(",")[0])


def archived(pages: DataFrame) -> DataFrame:
    """Write pages to new archives in the shared folder and read them back.

    An error if not as many records are read as were written, or a payload does not have its digest.
    """
    files = write_archives(pages, shared_path(pages.sparkSession, "warc"))
    found = written(read_archives(files, payload=False), "records")
    wrote = files.agg(F.sum("records")).first()[0] or 0
    read, intact = found.agg(F.count("*"), F.count_if("intact")).first()
    if not wrote == read == intact:
        raise DamagedArchiveError(f"{wrote} records were written, {read} read, {intact} of them intact")
    return found
