"""WARC archives written by tasks, and a reader that salvages damaged ones.

Archives go to a folder that all executors share; tasks reach it through ``pyarrow.fs`` (local or
mounted paths, HDFS, object stores), as Spark has no writer for them. What a task wrote counts only
through the manifest table that Spark commits, so that the files of lost attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.text import whole

ARCHIVE_BYTES = 64 * 1024 * 1024
SPLIT_BYTES = 16 * 1024 * 1024
CHUNK = 1 << 20
# A plain record whose header is longer than this counts as broken.
HEADER_BYTES = 1 << 20
MOST_TASKS = 100_000

# Fixed values of the format.
CRLF2 = b"\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, n_bytes long, n_records long, starts array<long>"
RECORDS = (
    "kind string, path string, offset long, length long, record_type string, page_id long, "
    "target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"
)
MANIFEST_COLUMNS = [field.split()[0] for field in MANIFEST.split(", ")]
COLUMNS = [field.split()[0] for field in RECORDS.split(", ")]


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def open_folder(uri: str):
    """The file system of a path and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


# Writing


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: the page whose equal payload was stored before.

    Of equal payloads of at least ``least_bytes`` bytes the one with the smallest page id is stored
    and the others refer to it (``refers_to`` is null for what is stored). A null html is an
    empty payload; null ids come after all others; repeated rows of the first page are all stored.
    The sums of the payloads are grouped first, and only those that occur twice take part in the join.
    """
    payloads = pages.select("page_id", "url", whole("html").cast("binary").alias("payload"))
    payloads = payloads.withColumn("sum", F.sha1("payload"))
    stored = F.octet_length("payload") >= least_bytes
    firsts = (
        payloads.filter(stored)
        .groupBy("sum")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 AND first IS NOT NULL")
        .select(F.col("sum").alias("first_sum"), "first")
    )
    own = F.col("page_id").eqNullSafe(F.col("first")) | ~stored
    return payloads.join(firsts, F.col("sum") == F.col("first_sum"), "left").select(
        "page_id", "url", "payload", F.when(~own, F.col("first")).alias("refers_to")
    )


def _urn(page_id: int) -> str:
    return f"<urn:x-page:{page_id}>"


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None
) -> bytes:
    """One uncompressed record, the two line ends behind it included."""
    digest = base32_sha1(payload)
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + payload if refers_to is None else http
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    identity = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}")
    fields += [f"WARC-Record-ID: <urn:uuid:{identity}>"]
    if page_id is not None:
        fields += [f"X-Page-ID: {page_id}"]
    if url is not None:
        fields += ["WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url)]
    if refers_to is not None:
        fields += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    fields += [
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(fields).encode() + CRLF2 + block + CRLF2


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own."""
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The manifest of archives of at most about ``archive_bytes`` each, one record per row.

    Evaluating the result writes; store it once and read what was stored. Each task writes
    files of its own and holds one record at a time, beside the places where the records of an
    archive start, which go into the manifest.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        stream = path = None
        size, starts = 0, []
        done = []

        def entry() -> tuple:
            return f"{folder}/{path.rsplit('/', 1)[1]}", size, len(starts), starts

        for batch in batches:
            for page_id, url, payload, refers_to in batch.itertuples(index=False):
                if stream is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    stream, size, starts = system.open_output_stream(path, compression=None), 0, []
                packed = member(
                    record_bytes(
                        None if pd.isna(page_id) else int(page_id),
                        url,
                        payload,
                        None if pd.isna(refers_to) else int(refers_to),
                    )
                )
                stream.write(packed)
                starts.append(size)
                size += len(packed)
                if size >= archive_bytes:
                    stream.close()
                    done.append(entry())
                    stream = None
            yield pd.DataFrame(done, columns=MANIFEST_COLUMNS)
            done = []
        if stream is not None:
            stream.close()
            yield pd.DataFrame([entry()], columns=MANIFEST_COLUMNS)

    ids = {c: F.col(c).cast("string") for c in ("page_id", "refers_to")}
    return (
        rows.withColumns(ids)
        .select("page_id", "url", "payload", "refers_to")
        .mapInPandas(write, MANIFEST)
    )


# Reading


class Broken(Exception):
    """A record that fails a check."""


def parse_record(data: bytes) -> dict:
    """Fields of one whole uncompressed record; raises ``Broken`` if any check fails."""
    if not VERSION.match(data):
        raise Broken("no version line")
    head_end = data.find(CRLF2)
    if head_end < 0:
        raise Broken("no end of the header")
    fields = {}
    for line in data[:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("a header line without a colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError):
        raise Broken("no length") from None
    block = data[head_end + 4 : head_end + 4 + length]
    if len(block) != length or data[head_end + 4 + length :] != CRLF2:
        raise Broken("another length than stated")
    stated = fields.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != base32_sha1(block):
        raise Broken("another block digest than stated")
    kind = fields.get("warc-type", "")
    payload, n_bytes = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(CRLF2)
        n_bytes = len(payload)
        if kind == "revisit":
            found = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]+)", http)
            n_bytes = int(found[1]) if found else n_bytes
    digest = fields.get("warc-payload-digest", "")
    digest = digest[5:] if digest.startswith("sha1:") else None
    if kind != "revisit":
        own = base32_sha1(payload)
        if digest is not None and digest != own:
            raise Broken("another payload digest than stated")
        digest = own
    number = fields.get("x-page-id", "")
    refers = re.fullmatch(r"<urn:x-page:(-?[0-9]+)>", fields.get("warc-refers-to", ""))
    return {
        "record_type": kind,
        "page_id": int(number) if re.fullmatch(r"-?[0-9]+", number) else None,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": int(refers[1]) if refers else None,
        "payload_bytes": n_bytes,
        "payload_digest": digest,
        "payload": payload,
    }


class Archive:
    """Random access to the records of one archive, compressed by record or not at all.

    ``starts`` are the places where its records were written, in order; then nothing else is taken
    for one, whatever payloads hold. Without them the bytes are searched.
    """

    def __init__(self, file, starts: Sequence[int] | None = None):
        self.file = file
        self.size = file.size()
        self.starts = starts

    def chunk(self, at: int, n: int = CHUNK) -> bytes:
        return self.file.read_at(min(n, max(0, self.size - at)), at) if at < self.size else b""

    def record_at(self, at: int) -> tuple[dict, int]:
        """The record that begins at a byte, and where it ends; raises ``Broken``."""
        start = self.chunk(at, 64)
        if start.startswith(MEMBER):
            return self._member_at(at)
        if VERSION.match(start):
            return self._plain_at(at)
        raise Broken("neither a member nor a version line")

    def _member_at(self, at: int) -> tuple[dict, int]:
        unpacker, parts, end = zlib.decompressobj(31), [], at
        try:
            while not unpacker.eof:
                raw = self.chunk(end, 1 << 16)
                if not raw:
                    raise Broken("a member without an end")
                parts.append(unpacker.decompress(raw))
                end += len(raw)
                if len(parts) == 1 and parts[0] and not parts[0].startswith(b"WARC/1."):
                    raise Broken("a member that is no record")
        except zlib.error as error:
            raise Broken(str(error)) from None
        return parse_record(b"".join(parts)), end - len(unpacker.unused_data)

    def _plain_at(self, at: int) -> tuple[dict, int]:
        head, end = b"", at
        while CRLF2 not in head:
            raw = self.chunk(end, 1 << 16)
            if not raw:
                raise Broken("no end of the header")
            head += raw
            end += len(raw)
            if len(head) > HEADER_BYTES and CRLF2 not in head:
                raise Broken("no end of the header")
        head_end = head.index(CRLF2) + 4
        found = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]+)\r\n", head[:head_end])
        if not found:
            raise Broken("no length")
        whole_length = head_end + int(found[1]) + 4
        if at + whole_length > self.size:
            raise Broken("a record without an end")
        return parse_record(self.chunk(at, whole_length)), at + whole_length

    def next_valid(self, at: int) -> tuple[int, dict | None, int]:
        """The first byte from ``at`` on where a whole record passes all checks, with the record
        and its end; the end of the archive if there is none."""
        if self.starts is not None:
            for place in self.starts[bisect_left(self.starts, at) :]:
                try:
                    return place, *self.record_at(place)
                except Broken:
                    continue
            return self.size, None, self.size
        while at < self.size:
            raw = self.chunk(at)
            for found in re.finditer(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n", raw):
                try:
                    record, end = self.record_at(at + found.start())
                    return at + found.start(), record, end
                except Broken:
                    continue
            if len(raw) < CHUNK:
                break
            at += CHUNK - 16
        return self.size, None, self.size

    def salvage(self, start: int, end: int) -> Iterator[tuple[str, int, int, dict]]:
        """Records that begin in a range of bytes, and the gaps behind records of the range.

        A gap is what lies between the end of a record (or the start of the archive) and the next
        valid record. It belongs to the range of the record before it, so ranges that are read
        apart give every record and every gap once.
        """
        at, record, stop = (0, None, 0) if start == 0 else self.next_valid(start)
        while at < end and at < self.size:
            if record is None:
                try:
                    record, stop = self.record_at(at)
                except Broken:
                    found, record, stop = self.next_valid(at + 1)
                    yield "gap", at, found - at, {}
                    at = found
                    continue
            yield "record", at, stop - at, record
            at, record = stop, None
            if end <= at < self.size:
                try:
                    self.record_at(at)
                except Broken:
                    yield "gap", at, self.next_valid(at + 1)[0] - at, {}


def read_archives(
    manifest: DataFrame, with_payload: bool = True, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Records and gaps (``kind``) of archives ``(path, n_bytes)``, in the columns of ``RECORDS``.

    A gap is a quarantined range of bytes, ``offset`` and ``length`` of its archive, in which no
    record passed its checks. Archives whose manifest lists the ``starts`` of their records are read
    in ranges of ``split_bytes`` by different tasks. Others, which come from elsewhere, are one range
    each, read from the first byte on: a payload may hold what looks like a record, even whole
    members, and only the chain of records before it tells. Behind a damaged record of such an
    archive the bytes are searched, so what its own payload holds may be taken for records there. A
    task holds one record, long ones whole, and one chunk at a time. Further columns of the
    manifest are ignored; an empty archive or manifest gives no rows.
    """
    total = manifest.agg(F.sum(F.ceil(F.col("n_bytes") / split_bytes))).first()[0] or 0
    if "starts" not in manifest.columns:
        manifest = manifest.withColumn("starts", F.lit(None).cast("array<long>"))
    last = F.greatest(F.col("n_bytes") - 1, F.lit(0))
    known = F.col("starts").isNotNull()
    from_bytes = F.when(
        known, F.sequence(F.lit(0).cast("long"), last, F.lit(split_bytes).cast("long"))
    ).otherwise(F.array(F.lit(0).cast("long")))
    ranges = (
        manifest.filter("n_bytes > 0")
        .select("path", "n_bytes", "starts", F.explode(from_bytes).alias("start"))
        .select(
            "path",
            "start",
            F.when(known, F.col("start") + split_bytes).otherwise(F.col("n_bytes")).alias("stop"),
            "starts",
        )
        .repartition(max(1, min(int(total), MOST_TASKS)))
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, stop, starts in batch.itertuples(index=False):
                system, name = open_folder(path)
                known = None if starts is None else list(map(int, starts))
                with system.open_input_file(name) as file:
                    rows, size = [], 0
                    for kind, offset, length, record in Archive(file, known).salvage(start, stop):
                        row = {"kind": kind, "path": path, "offset": offset, "length": length}
                        row |= record
                        if not with_payload:
                            row["payload"] = None
                        rows.append(tuple(row.get(c) for c in COLUMNS))
                        size += 200 + len(row.get("payload") or b"")
                        if size > CHUNK * 4:
                            yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)
                            rows, size = [], 0
                    yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)

    return ranges.mapInPandas(read, RECORDS)

