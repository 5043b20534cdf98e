"""WARC writing and splittable reading (operator 10).

``write_archives`` writes one gzip member per record, as the WARC 1.1 format asks
for: a ``response`` with the payload, or a ``revisit`` that names the response
with the same payload. ``read_archives`` deals byte ranges of the archives to
tasks: a task looks for gzip magic from its range's start, validates each
candidate by inflating and decoding its record header, and owns the records that
start inside its range, reading past its end where the last one does.

The first of equal payloads is found by an aggregation on the digest (combined
before the shuffle); rows meet their digest's first page over a salted key, so a
payload that a third of all pages share is spread over ``SALTS`` tasks. A file is
written under a temporary name and moved when complete, and only files named in
the manifest are read: a retried task leaves no half record.

Nulls: a null html is the empty payload; a null url is left out of the record; a
row with a null page_id keeps it and is never referred to unless no row of its
payload has an id. Repeated rows that share the smallest page_id of their payload
are all responses. Further input columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, open_fs, table, text_rows

#: Payloads below this size are always stored in full.
MIN_REVISIT = 100
SALTS = 32
ROLL_BYTES = 64 << 20
SPLIT_BYTES = 16 << 20
_MAGIC = b"\x1f\x8b\x08"
_DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def _block(fields: list[tuple[str, object]], body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    raw = f"WARC/1.1\r\n{head}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The gzip member of one page. A revisit keeps the head of the answer, so the payload's length is known."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = refers_to is not None
    fields = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", _DATE), ("WARC-Target-URI", url and re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("X-Page-Id", page_id)]
    if again:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-Id", refers_to)]
    return _block(fields, http if again else http + payload)


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = (
        rows.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first_id is not null").select("digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id"))
    return rows.join(firsts, ["digest", "salt"], "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(spark: SparkSession, pages: DataFrame, uri: str) -> DataFrame:
    """Write the pages below ``uri`` and return the manifest: path (a URI), bytes, records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(uri)
        fs.create_dir(base, recursive=True)
        out = name = None
        size = count = 0

        def close() -> pa.RecordBatch:
            out.close()
            fs.move(f"{base}/{name}.tmp", f"{base}/{name}")
            return pa.record_batch([pa.array([f"{uri}/{name}"]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], ["path", "bytes", "records"])

        for rows in text_rows(batches, ("page_id", "url", "payload", "digest", "refers_to"), 256):
            for page_id, url, payload, digest, refers_to in zip(*rows, strict=True):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}.tmp")
                    info = _block([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    size += len(info)
                made = record(page_id, url, payload, digest, refers_to)
                out.write(made)
                size, count = size + len(made), count + 1
                if size >= ROLL_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    manifest = f"{uri}/manifest"
    marked(pages).mapInArrow(write, "path string, bytes long, records long").write.parquet(manifest)
    return spark.read.parquet(manifest)


class _Window:
    """Bytes of a file from a position on, read in steps and forgotten when passed."""

    def __init__(self, file, at: int, size: int, step: int = 1 << 20) -> None:
        self.file, self.base, self.size, self.step, self.data = file, at, size, step, b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(min(self.step, self.size - self.base - len(self.data)))
        self.data += got
        return bool(got)

    def forget(self, to: int) -> None:
        self.data, self.base = self.data[to - self.base :], to


def _inflate(window: _Window, at: int, head_only: bool) -> tuple[bytes, int] | None:
    """The member at a position and the position after it; None if there is no whole, valid member."""
    z, out, pos = zlib.decompressobj(31), [], at - window.base
    try:
        while not z.eof:
            if pos >= len(window.data) and not window.more():
                return None
            chunk = window.data[pos : pos + (1 << 16)]
            out.append(z.decompress(chunk))
            pos += len(chunk)
            if head_only and (sum(map(len, out)) >= 7 or z.eof):
                break
    except zlib.error:
        return None
    return b"".join(out), window.base + pos - len(z.unused_data)


def members(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Position and content of the WARC records whose gzip member starts in [start, end)."""
    window, at, known = _Window(file, start, size), start, False
    while at < end:
        if not known:
            found = window.data.find(_MAGIC, at - window.base)
            if found < 0:
                at = max(at, window.base + len(window.data) - 2)
                window.forget(at)
                if at >= end or not window.more():
                    return
                continue
            at = window.base + found
            if at >= end:
                return
            head = _inflate(window, at, True)
            if not head or not head[0].startswith(b"WARC/1."):
                at += 1
                continue
        whole = _inflate(window, at, False)
        if not whole or not whole[0].startswith(b"WARC/1."):
            if known and at >= size:
                return
            at, known = at + 1 - known, False
            continue
        yield at, whole[0]
        at, known = whole[1], True
        window.forget(at)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's block doesn't have its length")
    return fields, rest[:size]


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per response or revisit record of the archives in a manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths, sizes, starts in text_rows(batches, ("path", "bytes", "start")):
            for path, size, start in zip(paths, sizes, starts, strict=True):
                fs, local = open_fs(path)
                rows = []
                with fs.open_input_file(local) as file:
                    for _, raw in members(file, size, start, min(size, start + split_bytes)):
                        fields, block = parse(raw)
                        if fields["warc-type"] not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said = fields["warc-payload-digest"].partition(":")[2]
                        n = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                        if fields["warc-type"] == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != said):
                            raise ValueError(f"a payload in {path} isn't what its digest says")
                        number = lambda k, f=fields: int(f[k]) if k in f else None
                        rows.append((number("x-page-id"), n, said, fields["warc-type"], number("x-refers-to-page-id"), fields.get("warc-target-uri")))
                        if len(rows) == 4096:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    ranges = manifest.select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {int(split_bytes)}L)")).alias("start"))
    total = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    return ranges.repartition(int(total)).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark, table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"))
    return read_archives(manifest).drop("url")


QUERIES = {"op10_warc": op10_warc}
ORACLES = {
    "op10_warc": """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
q as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id is distinct from first_id and first_id is not null then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id is distinct from first_id then first_id end as refers_to
from q"""
}
