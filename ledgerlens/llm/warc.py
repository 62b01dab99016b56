"""WARC archives: written by Spark tasks, read back by a salvage reader.

``write_archives`` writes one gzip member for each record, in files of about
``roll_bytes`` that start with a warcinfo record.  Each task attempt writes names of its
own; the manifest, written by Spark, holds the files of the attempts that count, and only
those are read, so a lost executor leaves no record twice.

``read_archives`` gets whole files from Spark's binaryFile source (gzip or plain) and
checks each record: the member's CRC, the version line, Content-Length, the closing line
feeds and the block digest.  After a failed check it searches for the nearest of a version
line or a member that opens with one (inside a member for the next version line), and goes
on there; the bytes between are logged as a quarantined gap (offset, length, reason).  Of a
truncated or damaged member the records before the damage are read and the rest is the gap;
if its data ends and only its CRC or length is wrong or missing, the damage may lie anywhere:
a single record is quarantined, of several those with a sound block digest are read.  A file
without any valid record is one gap.

``page_records`` decides what is written for a table of pages: of equal payloads of at
least ``min_revisit`` bytes the record with the smallest page_id is a response, the others
are revisits that refer to it.  Only payloads that may be repeated move between tasks.

Defined results: null html is an empty payload; null urls have no target; control
characters and spaces in a url are percent-encoded.  Rows that repeat the page_id of their
payload's response are responses too.  Null page_ids refer to others but are not referred
to.  An empty table writes no file and reads back as no record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_dir
from .common import bitmap_of, field, join_by_key, map_arrow, with_member_flag

MIN_REVISIT = 100
ROLL_BYTES = 8 << 20
DATE = "2000-01-01T00:00:00Z"   # pages carry no date; a fixed one keeps the files reproducible

VERSION = re.compile(rb"(?:\A|(?<=\n))WARC/1\.[01]\r\n")
MAGIC = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- what to write --------------------------------------------------------------------

def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is set for revisits."""
    payload = F.coalesce(field(html_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(field(id_col).cast("bigint").alias("page_id"), field(url_col).cast("string").alias("url"),
                        payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    sizes = rows.filter(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = cut_lineage(sizes.filter("n > 1"), "warc-repeated")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    flagged = with_member_flag(rows, cut_lineage(bitmap_of(repeated, F.col("digest")), "warc-bitmap"),
                               F.col("digest"), "suspect")
    columns = ["page_id", "url", "payload", "digest", F.lit(None).cast("bigint").alias("refers_to")]
    single = flagged.filter(~F.col("suspect")).select(*columns)
    suspects = flagged.filter("suspect").drop("suspect")
    # false positives of the bitmap go with the singles
    chance = suspects.join(repeated, "digest", "left_anti").select(*columns)
    copies = join_by_key(suspects, repeated, "digest", "n", total).select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))
    return single.unionByName(chance).unionByName(copies)


# --- writing ----------------------------------------------------------------------------

def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _safe_url(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def record_bytes(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("WARC-Date", DATE),
             ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    headers = [("WARC-Record-ID", _urn(page_id))]
    if url is not None:
        headers.append(("WARC-Target-URI", _safe_url(url)))
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload))),
                ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return record_bytes("response", headers, _HTTP + payload)
    headers += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", _PROFILE)]
    return record_bytes("revisit", headers, _HTTP)


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write_archives(records: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the rows of ``page_records`` under ``folder`` (a URI that every executor
    reaches, of a scheme that pyarrow's file systems know).  Returns the manifest,
    already written: path, records, bytes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, count, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for part in parts:
            for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if out is None:
                    name, count = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    info = gzip_member(record_bytes("warcinfo", [("WARC-Record-ID", f"<urn:file:{name}>"),
                                                                 ("WARC-Filename", name),
                                                                 ("Content-Type", "application/warc-fields")],
                                                    b"format: WARC File Format 1.1\r\n"))
                    out.write(info)
                    size = len(info)
                member = gzip_member(page_record(*row))
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= roll_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, size))
        yield pa.record_batch([pa.array(c, f.type) for c, f in
                               zip(list(zip(*done, strict=True)) or [[]] * 3, _MANIFEST, strict=True)], schema=_MANIFEST)

    rows = records.select("page_id", "url", "payload", "digest", "refers_to")
    return cut_lineage(map_arrow(rows, run, "path string, records bigint, bytes bigint"), "warc-manifest")


# --- reading ------------------------------------------------------------------------------

class Record(NamedTuple):
    kind: str
    headers: dict[str, str]
    payload: bytes


class Gap(NamedTuple):
    offset: int
    length: int
    reason: str


def _record_at(data: bytes, at: int) -> tuple[Record | str, int]:
    """The record at ``at`` and where it ends, or why there is none."""
    m = VERSION.match(data, at)
    if not m:
        return "no version line", at
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        return "header without end", at
    headers: dict[str, str] = {}
    for line in data[m.end():end].decode("utf-8", "replace").split("\r\n"):
        key, colon, value = line.partition(":")
        if line and not colon:
            return "malformed header", at
        headers[key.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not size.isdigit():
        return "no content length", at
    begin, stop = end + 4, end + 4 + int(size)
    if data[stop:stop + 4] != b"\r\n\r\n":
        return "wrong content length", at
    block = data[begin:stop]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(block).hexdigest():
        return "wrong block digest", at
    kind = headers.get("warc-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
    return Record(kind, headers, b"" if kind == "revisit" else payload), stop + 4


def read_plain(data: bytes) -> Iterator[tuple[int, int, Record | Gap]]:
    """(offset, length, record or gap) of concatenated records."""
    at, bad, why = 0, -1, ""
    while at < len(data):
        found, end = _record_at(data, at)
        if isinstance(found, Record):
            if bad >= 0:
                yield bad, at - bad, Gap(bad, at - bad, why)
                bad = -1
            yield at, end - at, found
            at = end
            continue
        if bad < 0:
            bad, why = at, found
        m = VERSION.search(data, at + 1)
        at = m.start() if m else len(data)
    if bad >= 0:
        yield bad, len(data) - bad, Gap(bad, len(data) - bad, why)


class Member(NamedTuple):
    data: bytes      # what it decompresses to, as far as that goes
    end: int
    why: str         # why it is not sound, or nothing
    complete: bool   # its data ended, so only its check is wrong or missing


def _member_at(data: bytes, at: int, step: int = 1 << 15) -> Member:
    """The gzip member at ``at``; a damaged one with all that it gives before the damage shows."""
    z = zlib.decompressobj(31)
    out, pos = [], at
    try:
        while not z.eof and pos < len(data):
            out.append(z.decompress(data[pos:pos + step]))
            pos = min(len(data), pos + step)
    except zlib.error as e:
        out.append(_before_error(data, at, pos))
        return Member(b"".join(out), pos, "damaged gzip member",
                      str(e).endswith(("incorrect data check", "incorrect length check")))
    if z.eof:
        return Member(b"".join(out), pos - len(z.unused_data), "", True)
    got = b"".join(out)
    check = zlib.crc32(got).to_bytes(4, "little") + (len(got) & 0xFFFFFFFF).to_bytes(4, "little")
    return Member(got, pos, "truncated gzip member", any(data.endswith(check[:k]) and _ends(z, check[k:]) for k in range(8)))


def _ends(z, check: bytes) -> bool:
    """Whether the rest of its check ends the member that ``z`` has read."""
    z = z.copy()
    try:
        z.decompress(check)
    except zlib.error:
        return False
    return z.eof


def _before_error(data: bytes, at: int, pos: int) -> bytes:
    """What the bytes from ``pos`` on add to those of the member at ``at`` up to its error."""
    z = zlib.decompressobj(31)
    z.decompress(data[at:pos])
    out = []
    for i in range(pos, len(data)):
        last = z.copy()
        try:
            out.append(z.decompress(data[i:i + 1]))
        except zlib.error:
            break
    try:                               # the failing byte, by single bytes of output
        piece = last.decompress(data[i:i + 1], 1)
        while piece:
            out.append(piece)
            piece = last.decompress(last.unconsumed_tail, 1)
    except zlib.error:
        pass
    return b"".join(out)


def _input_of(data: bytes, at: int, size: int, step: int = 1 << 15) -> int:
    """Where the bytes end from which the member at ``at`` gives its first ``size``."""
    z = zlib.decompressobj(31)
    pos = at
    try:
        while True:
            last = z.copy()
            n = len(z.decompress(data[pos:pos + step]))
            if n >= size or pos >= len(data):
                break
            pos, size = pos + step, size - n
    except zlib.error:
        pass
    try:
        while size > 0 and pos < len(data):
            pos += 1
            size -= len(last.decompress(data[pos - 1:pos]))
    except zlib.error:
        pass
    return pos


def _opens(data: bytes, at: int, step: int = 1 << 15) -> bool:
    """Whether the bytes at ``at`` decompress to a version line."""
    z = zlib.decompressobj(31)
    out = b""
    try:
        while len(out) < 7 and not z.eof and at < len(data):
            out += z.decompress(data[at:at + step], 16)
            at += step
    except zlib.error:
        return False
    return out.startswith(b"WARC/1.")


def _records_at(data: bytes, at: int) -> tuple[list[tuple[int, int, Record | Gap]], int, str]:
    """The record at ``at`` or those of the member there, where they end, and why what
    follows belongs to a gap."""
    if data[at:at + 3] != MAGIC:
        x, end = _record_at(data, at)
        return ([(at, end - at, x)], end, "") if isinstance(x, Record) else ([], at, x)
    member = _member_at(data, at)
    found = list(read_plain(member.data))
    if member.why and member.complete:
        # the check of a member of one record is that record's; of several, those with a sound digest count
        found = [] if len(found) == 1 else [
            (o, n, x if isinstance(x, Gap) or x.headers.get("warc-block-digest", "").startswith("sha256:")
             else Gap(o, n, "wrong check of the member")) for o, n, x in found]
    if not any(isinstance(x, Record) for _, _, x in found):
        return [], at if member.why else member.end, member.why or (found[0][2].reason if found else "empty member")
    end = member.end
    if member.why:
        while isinstance(found[-1][2], Gap):
            found.pop()
        end = _input_of(data, at, found[-1][0] + found[-1][1])
    return [(at, end - at, x if isinstance(x, Record) else
             Gap(at, end - at, f"{x.reason}, bytes {o} to {o + n} of the member")) for o, n, x in found], end, member.why


def read_archive(data: bytes) -> Iterator[tuple[int, int, Record | Gap]]:
    """(offset, length, record or gap) of a file of records, gzip members or both; a gap inside
    a member counts as that member's bytes if something in it is valid, and names the bytes inside."""
    at, bad, why = 0, -1, ""
    version = member = -1     # the next version line, and the next member before it that opens with one
    while at < len(data):
        found, end, reason = _records_at(data, at)
        if found:
            if 0 <= bad < at:
                yield bad, at - bad, Gap(bad, at - bad, why)
            yield from found
            bad = -1
        if reason and bad < 0:
            bad, why = end if found else at, reason
        if not reason or end > at and not found:
            at = end
            continue
        at = end if found else at + 1
        if version < at:
            m = VERSION.search(data, at)
            version = m.start() if m else len(data)
        if member < at:
            member = data.find(MAGIC, at, version)
            while member >= 0 and not _opens(data, member):
                member = data.find(MAGIC, member + 1, version)
            if member < 0:
                member = version
        at = member
    if 0 <= bad < len(data):
        yield bad, len(data) - bad, Gap(bad, len(data) - bad, why)


_ROWS = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()),
                   ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
                   ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary()),
                   ("gap_reason", pa.string())])
_ROW_SQL = ("path string, offset bigint, length bigint, record_type string, record_id string, refers_to string, "
            "target_uri string, payload_digest string, payload_length bigint, payload binary, gap_reason string")


def _row(path: str, offset: int, length: int, x: Record | Gap) -> tuple:
    if isinstance(x, Gap):
        return path, offset, length, "quarantined", None, None, None, None, None, None, x.reason
    h = x.headers
    digest = h.get("warc-payload-digest")
    size = h.get("x-payload-length", "")
    return (path, offset, length, x.kind, h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"),
            digest and digest.removeprefix("sha256:"), int(size) if size.isdigit() else None, x.payload, None)


def read_archives(spark: SparkSession, paths: list[str], batch_bytes: int = 4 << 20) -> DataFrame:
    """One row for each record and each quarantined gap of the files."""
    if not paths:
        return spark.createDataFrame([], _ROW_SQL)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                path, data = part.column(0)[i].as_py(), part.column(1)[i].as_py()
                rows, held = [], 0
                for offset, length, x in read_archive(data):
                    rows.append(_row(path, offset, length, x))
                    held += len(rows[-1][9] or b"")
                    if held >= batch_bytes:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return map_arrow(files, run, _ROW_SQL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for every page into the shared folder and read the archives back."""
    spark = pages.sparkSession
    manifest = write_archives(page_records(pages, id_col, url_col, html_col), scratch_dir(spark, "warc"))
    # one short path for each file of about ROLL_BYTES, as for any list of input files
    return read_archives(spark, [r.path for r in manifest.select("path").collect()])


def page_id_of(urn: Column) -> Column:
    """The page_id in a record id."""
    return F.nullif(F.regexp_extract(urn, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("bigint")


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
