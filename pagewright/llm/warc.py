"""WARC writing and a reader that salvages what is left of damaged archives.

Writing: one gzip member for each record, payloads that occur more than once
are stored once (the other records are revisits that refer to it).

Reading: a record is taken if its member unpacks with the right checksum, its
header parses, its block has the promised length and digest and, in responses
and resources, its payload the promised digest (md5, SHA-1 and SHA-2; revisits
and segments promise the payload of another record).  After a failed check the
reader searches on from the next byte for the next valid gzip member (magic
number, trial unpacking, version line) or, in plain archives and in unpacked
members, for the next version line at a line start, and logs the bytes in
between as a quarantined gap.  What a damaged member gives before the damage is
read too; its checksum proves nothing, so a record of it needs a block digest
that holds and unpacked bytes behind it.  Headers have no digest.  Of a member
that unpacks to more than MAX_RECORD bytes, what lies beyond is a gap.
"""

from __future__ import annotations

import base64
import hashlib
import mmap
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_join, map_batches, materialize, scratch
from .tokens import filesystem

MIN_REVISIT = 1000
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
#: Bytes of a record's header, and of one record unpacked, beyond which it fails the check.
MAX_HEADER, MAX_RECORD = 1 << 20, 1 << 31
DATE = "2000-01-01T00:00:00Z"


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    payload: bytes
    version: str = "WARC/1.1"


@dataclass
class Gap:
    start: int
    end: int
    reason: str


@dataclass
class Outcome:
    """A reader's log."""

    records: int = 0
    gaps: list[Gap] = field(default_factory=list)


class Bad(Exception):
    pass


def sha1_label(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digest_holds(promised: str, *blocks: bytes) -> bool | None:
    """Whether one of ``blocks`` has the promised digest (base32 or hex); None if the algorithm isn't known."""
    name, _, value = promised.partition(":")
    if name.lower() not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    value = value.strip()
    digests = [hashlib.new(name.lower(), b).digest() for b in blocks]
    return any(value.lower() == d.hex() or value.upper().rstrip("=") == base64.b32encode(d).decode().rstrip("=") for d in digests)


def payloads(headers: dict[str, str], block: bytes) -> list[bytes]:
    """What a payload digest may be of: the block, or the body of its HTTP message as it is and without chunks."""
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return [block]
    close = re.search(rb"\r?\n\r?\n", block)
    if not close:
        return [b""]
    body, out, at = block[close.end() :], [], 0
    if not re.search(rb"^transfer-encoding:[^\n]*chunked", block[: close.end()], re.I | re.M):
        return [body]
    while size := re.compile(rb"([0-9A-Fa-f]{1,15})[^\n]*\n").match(body, at):
        n = int(size[1], 16)
        out.append(body[size.end() : size.end() + n])
        at = size.end() + n
        at += 2 if body[at : at + 2] == b"\r\n" else 1
        if not n:
            break
    return [body, b"".join(out)]


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data, at: int, end: int | None = None, proven: bool = False) -> tuple[Record, int]:
    """The record at ``at`` of a bytes-like object and the offset behind it; Bad if a check fails or, if it is to be ``proven``, no digest could be checked."""
    limit = len(data) if end is None else end
    window = bytes(data[at : min(limit, at + MAX_HEADER)])
    version = VERSION.match(window)
    if not version:
        raise Bad("no version line")
    for gap in (b"\r\n\r\n", b"\n\n"):
        close = window.find(gap, version.end() - len(gap) // 2)
        if close >= 0:
            break
    else:
        raise Bad("header without end")
    headers: dict[str, str] = {}
    last = None
    for line in window[version.end() : close].split(b"\n"):
        text = line.rstrip(b"\r").decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            headers[last] += " " + text.strip()
            continue
        if not text:
            continue
        name, colon, value = text.partition(":")
        if not colon or not name.strip():
            raise Bad("header line without a name")
        last = name.strip().lower()
        headers[last] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Bad("no content length")
    start = at + close + len(gap)
    stop = start + int(length)
    if stop > limit:
        raise Bad("block shorter than promised")
    payload = bytes(data[start:stop])
    after = bytes(data[stop : stop + 4])
    tail = 4 if after == b"\r\n\r\n" else 2 if after[:2] == b"\n\n" else 0
    if not tail:
        raise Bad("no record end")
    promised = headers.get("warc-block-digest", "")
    holds = digest_holds(promised, payload)
    if holds is False:
        raise Bad("block digest differs")
    of_payload = headers.get("warc-payload-digest", "")
    if headers.get("warc-type", "").lower() in ("response", "resource") and "warc-segment-number" not in headers:
        bodies = payloads(headers, payload)
        own = holds if of_payload == promised and len(bodies) == 1 and bodies[0] is payload else digest_holds(of_payload, *bodies)
        if own is False:
            raise Bad("payload digest differs")
    if proven and not holds:  # a payload digest does not cover the HTTP headers
        raise Bad("damaged member and no block digest")
    return Record(at, headers, payload, window[: version.end()].decode().strip()), stop + tail


def unpack_member(data, at: int) -> tuple[bytes, int, str]:
    """What one gzip member holds, the offset behind it and ""; of a damaged one, what comes before the damage, its offset and the reason."""
    z, out, pos, size, step = zlib.decompressobj(31), [], at, 0, 65536
    while not z.eof:
        piece = bytes(data[pos : pos + step])
        if not piece:
            return b"".join(out), pos, "member cut off"
        before = z.copy() if step > 1 else None
        try:
            got = z.decompress(piece)
        except zlib.error as e:
            if step == 1:
                return b"".join(out), pos, f"member damaged: {str(e)[:40]}"
            z, step = before, 1  # byte by byte up to the damage
            continue
        size += len(got)
        if size > MAX_RECORD:
            return b"".join(out), pos, "record too long"
        out.append(got)
        pos += len(piece)
    return b"".join(out), pos - len(z.unused_data), ""


def member_records(plain: bytes, whole: bool) -> tuple[list[Record], list[Gap]]:
    """Valid records of unpacked bytes and the gaps between them; those of a member that is not whole need a digest that holds."""
    at, found, gaps = 0, [], []
    while at < len(plain):
        try:
            record, end = parse_record(plain, at, proven=not whole)
            if not whole and end == len(plain):
                raise Bad("record at the damage")
            found.append(record)
        except Bad as e:
            end = next_line(plain, at + 1)
            end = len(plain) if end < 0 else end
            if gaps and gaps[-1].end == at:
                gaps[-1].end = end
            else:
                gaps.append(Gap(at, end, str(e)))
        at = end
    return found, gaps


def read_archive(data, outcome: Outcome) -> Iterator[Record]:
    """Valid records of a bytes-like object (bytes or a memory map) in order; gaps go to ``outcome``.

    A gap inside a member has the member's offsets; its reason names the unpacked bytes."""
    at, size, bad_from, reason = 0, len(data), None, ""

    def close_gap(end: int) -> None:
        nonlocal bad_from
        if bad_from is not None:
            outcome.gaps.append(Gap(bad_from, end, reason))
            bad_from = None

    while at < size:
        damage = ""
        try:
            if bytes(data[at : at + 3]) == MAGIC:
                plain, end, damage = unpack_member(data, at)
                found, inner = member_records(plain, not damage)
                if not found:
                    raise Bad(damage or (inner[0].reason if inner else "empty member"))
                for record in found:
                    record.offset = at
            elif VERSION.match(bytes(data[at : at + 16])):
                record, end = parse_record(data, at)
                found, inner = [record], []
            else:
                raise Bad("neither a member nor a version line")
        except Bad as e:
            if bad_from is None:
                bad_from, reason = at, str(e)
            at = next_start(data, at + 1)
            continue
        close_gap(at)
        outcome.gaps += [Gap(at, end, f"{g.reason}; unpacked bytes {g.start} to {g.end}") for g in inner]
        for record in found:
            outcome.records += 1
            yield record
        at = end
        if damage:
            bad_from, reason = at, damage
            at = next_start(data, at)
    close_gap(size)


def next_line(data, at: int, stop: int = -1) -> int:
    """The next offset from ``at`` on of a version line at a line start; -1 if there is none (before ``stop``, where that is given)."""
    line_at = data.find(b"WARC/", at)
    while line_at >= 0 and not ((line_at == 0 or data[line_at - 1 : line_at] == b"\n") and VERSION.match(bytes(data[line_at : line_at + 16]))):
        line_at = data.find(b"WARC/", line_at + 1)
        if 0 <= stop < line_at:
            return -1
    return line_at


def next_start(data, at: int) -> int:
    """The next offset from ``at`` on where a gzip member or, at a line start, a version line may begin; the length if there is none."""
    member_at = data.find(MAGIC, at)
    found = [x for x in (member_at, next_line(data, at, member_at)) if x >= 0]
    return min(found, default=len(data))


def open_archive(path: str):
    """A local file's memory map, or another store's bytes."""
    fs, inner = filesystem(path)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(inner, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if fs.get_file_info(inner).size else b""
    with fs.open_input_file(inner) as f:
        return f.read()


def plan(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html (bytes), digest, record_type and refers_to of each row.

    Of rows with equal payloads of ``least`` bytes or more, the one with the
    greatest page_id is the response.  A null page_id never serves as one for
    others; rows that repeat the greatest id are all responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    copies = rows.filter(F.length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1 and first is not null").drop("c")
    copies = materialize(copies, "warc-copies")
    joined = bounded_join(rows, copies, ["digest"], "left")
    revisit = F.coalesce(F.col("first").isNotNull() & (F.col("page_id") != F.col("first")), F.lit(False))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, least: int = MIN_REVISIT) -> DataFrame:
    """Write one archive for each partition and return the manifest (path, records, bytes).

    A file is written under a name of its attempt and renamed when complete."""
    spark = pages.sparkSession
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = filesystem(folder)
        name = f"part-{context.partitionId():06d}.warc.gz"
        temp, out, records = f"{root}/.{name}-{context.taskAttemptId()}", None, 0
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(temp, compression=None)
                out.write(member(record_bytes([("WARC-Type", "warcinfo"), ("WARC-Date", DATE), ("WARC-Record-ID", f"<urn:x-info:{name}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
            for row in batch.to_pylist():
                payload, kind = row["html"], row["record_type"]
                uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in row["url"] or "")
                headers = [("WARC-Type", kind), ("WARC-Date", DATE), ("WARC-Record-ID", f"<urn:x-page:{'' if row['page_id'] is None else row['page_id']}>"), ("WARC-Target-URI", uri or "urn:x-none"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()), ("X-Payload-Length", str(len(payload)))]
                if kind == "revisit":
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:x-page:{row['refers_to']}>")]
                    payload = b""
                headers += [("Content-Type", "text/html"), ("WARC-Block-Digest", sha1_label(payload))]
                out.write(member(record_bytes(headers, payload)))
                records += 1
        if out is None:
            return
        out.close()
        size = fs.get_file_info(temp).size
        fs.move(temp, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    manifest = map_batches(plan(pages, least), run, "path string, records long, bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_warc(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """All records and gaps of the archives in column ``path``, an archive to a task.

    kind 'record': warc_type, record_id, uri, refers_to, payload_digest, payload_length, payload; kind 'gap':
    start, stop and reason of quarantined bytes."""
    schema = "kind string, path string, start long, stop long, reason string, warc_type string, record_id string, uri string, refers_to string, payload_digest string, payload_length long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
        names = [x.strip().split()[0] for x in schema.split(",")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                outcome, rows, size = Outcome(), [], 0
                for r in read_archive(open_archive(path), outcome):
                    h = r.headers
                    length = h.get("x-payload-length", "")
                    rows.append(("record", path, r.offset, None, None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), int(length) if length.isdigit() else None, r.payload))
                    size += len(r.payload)
                    if len(rows) >= 512 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                rows += [("gap", path, g.start, g.end, g.reason, None, None, None, None, None, None, None) for g in outcome.gaps]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return map_batches(paths.select("path").repartition(max(1, paths.count())), run, schema)


def round_trip(pages: DataFrame, least: int = MIN_REVISIT, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records read back.

    A response's length and digest are those of its stored payload; a revisit's come from its header.  Null html is
    an empty payload, a null page_id stays null, an empty table gives an empty result; columns other than page_id, url
    and html are ignored."""
    folder = folder or scratch(pages.sparkSession, "warc")
    records = read_warc(pages.sparkSession, write_warc(pages, folder, least)).filter("kind = 'record' and warc_type in ('response', 'revisit')")
    mine = F.col("warc_type") == "response"
    return records.select(
        F.expr("try_cast(nullif(regexp_extract(record_id, '(-?[0-9]+)>$', 1), '') as bigint)").alias("page_id"),
        F.when(mine, F.length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(mine, F.sha1("payload")).otherwise(base32_hex(F.substring("payload_digest", 6, 32))).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.expr("try_cast(nullif(regexp_extract(refers_to, '(-?[0-9]+)>$', 1), '') as bigint)").alias("refers_to"),
    )


def base32_hex(label):
    """Lower-case hex of a 32-character base32 text: eight characters are 40 bits, ten hex digits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = F.translate(label, alphabet, "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    return F.concat(*[F.lpad(F.lower(F.conv(F.substring(digits, 8 * i + 1, 8), 32, 16)), 10, "0") for i in range(4)])
