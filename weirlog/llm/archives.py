"""WARC records in ZIP packages: written as stored members with an index, read back by range without extraction."""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .common import stage, stage_path

#: A package is closed when its archive member has this many bytes.
PACKAGE_BYTES = 64 << 20
#: Every record is a gzip member of its own, as is usual for archives that are read by range.
GZIP_LEVEL = 1
#: Bytes read at once from an archive member.
READ_BYTES = 4 << 20
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
LOCAL, CENTRAL, END, END64, LOCATOR, DESCRIPTOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x07\x08"


class ZipWriter:
    """Writes stored members to a stream that cannot seek: sizes follow each member in a descriptor, ZIP64 where needed.

    Every member's local header announces ZIP64 sizes, as they are not known yet; the central directory carries ZIP64
    fields only for values that do not fit (or always, if force64).
    """

    def __init__(self, out, force64: bool = False) -> None:
        self.out, self.force64, self.at, self.members, self.open = out, force64, 0, [], None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.open = [raw, self.at, 0, 0]
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4s5H3I2H", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, MAX32, MAX32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> int:
        """Returns where data begins within the member."""
        was = self.open[3]
        self.open[2] = binascii.crc32(data, self.open[2])
        self.open[3] += len(data)
        self._put(data)
        return was

    def end(self) -> None:
        raw, at, crc, size = self.open
        self._put(struct.pack("<4sIQQ", DESCRIPTOR, crc, size, size))
        self.members.append((raw, at, crc, size))
        self.open = None

    def close(self) -> None:
        begin = self.at
        for raw, at, crc, size in self.members:
            big = [v for v in (size, size, at) if self.force64 or v >= MAX32]
            if self.force64 or big:
                extra = struct.pack(f"<HH{len(big)}Q", 1, 8 * len(big), *big)
            else:
                extra = b""
            short = lambda v: MAX32 if self.force64 or v >= MAX32 else v
            self._put(struct.pack("<4s6H3I5H2I", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, short(size), short(size), len(raw), len(extra), 0, 0, 0, 0, short(at)) + raw + extra)
        size, n = self.at - begin, len(self.members)
        if self.force64 or begin >= MAX32 or size >= MAX32 or n >= MAX16:
            at = self.at
            self._put(struct.pack("<4sQ2H2I4Q", END64, 44, 45, 45, 0, 0, n, n, size, begin))
            self._put(struct.pack("<4sIQI", LOCATOR, 0, at, 1))
            begin, size, n = MAX32, MAX32, MAX16
        self._put(struct.pack("<4s4H2IH", END, 0, 0, n, n, size, begin, 0))
        self.out.close()


def read_directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (offset of its data, size, crc) of the stored members of a ZIP file, from its central and ZIP64 directories.

    f has read_at(n, offset). Reads the tail, the directory and each member's local header, no member.
    """
    tail_at = max(0, size - (22 + MAX16 + 20))
    tail = f.read_at(size - tail_at, tail_at)
    k = tail.rfind(END)
    while k >= 0 and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail):
        k = tail.rfind(END, 0, k)
    if k < 0:
        raise ValueError("no ZIP end record")
    _, disk, _, _, n, length, begin, _ = struct.unpack_from("<4s4H2IH", tail, k)
    if disk not in (0, MAX16):
        raise ValueError("a ZIP file of several parts")
    if (n == MAX16 or length == MAX32 or begin == MAX32) and k >= 20 and tail[k - 20 : k - 16] == LOCATOR:
        at = struct.unpack_from("<4sIQI", tail, k - 20)[2]
        record = f.read_at(56, at)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end record where its locator points")
        n, length, begin = struct.unpack_from("<3Q", record, 32)
    data, at, out = f.read_at(length, begin), 0, {}
    for _ in range(n):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("a broken ZIP directory")
        (_, _, _, flags, method, _, _, crc, packed, plain, a, b, c, _, _, _, where) = struct.unpack_from("<4s6H3I5H2I", data, at)
        name = data[at + 46 : at + 46 + a].decode()
        extra = data[at + 46 + a : at + 46 + a + b]
        while len(extra) >= 4:
            kind, m = struct.unpack_from("<HH", extra)
            if kind == 1:
                values = list(struct.unpack_from(f"<{m // 8}Q", extra, 4))
                plain = values.pop(0) if plain == MAX32 else plain
                packed = values.pop(0) if packed == MAX32 else packed
                where = values.pop(0) if where == MAX32 else where
            extra = extra[4 + m :]
        at += 46 + a + b + c
        if method == 0 and not flags & 1:
            head = f.read_at(30, where)
            if head[:4] != LOCAL:
                raise ValueError(f"no local header for {name}")
            x, y = struct.unpack_from("<2H", head, 26)
            out[name] = (where + 30 + x + y, packed, crc)
    return out


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, response: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the response's header, with the payload's length, and no payload."""
    web = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = web + payload if response else web
    name = "null" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += ["WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if not response:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; a response's digest and length are taken anew from its payload and must agree with the header."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    at = block.index(b"\r\n\r\n")
    web = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block[:at].decode().split("\r\n")[1:])}
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    payload = block[at + 4 :]
    if head["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    number = lambda s: None if s is None or s.endswith(":null>") else int(s[len("<urn:page:") : -1])
    return {
        "page_id": number(head["warc-record-id"]), "url": head.get("warc-target-uri"), "payload_bytes": int(web["content-length"]), "payload_digest": digest,
        "record_type": head["warc-type"], "refers_to": number(head.get("warc-refers-to")), "payload": payload if head["warc-type"] == "response" else None,
    }


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any store that pyarrow knows (local, hdfs, s3, ...) by its URI."""
    return pafs.FileSystem.from_uri(uri.replace("file:///", "/", 1) if uri.startswith("file:///") else uri)


def _write(batches: Iterator[pa.RecordBatch], folder: str, package_bytes: int, force64: bool) -> Iterator[pa.RecordBatch]:
    fs, base = _open(folder)
    zipped, index, path, done = None, [], "", []

    def close() -> None:
        nonlocal zipped, index
        zipped.end()
        zipped.begin("indexes/index.cdxj")
        zipped.write("\n".join(index).encode())
        zipped.end()
        zipped.close()
        done.append((path, len(index)))
        zipped, index = None, []

    for batch in batches:
        for page_id, url, html, digest, refers_to, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if zipped is None:
                path = f"{folder}/package-{uuid.uuid4().hex}.wacz"
                zipped = ZipWriter(fs.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}"), force64)
                zipped.begin("archive/data.warc.gz")
            data = record_bytes(page_id, url, (html or "").encode(), base64.b32encode(bytes.fromhex(digest)).decode(), refers_to, response)
            data = gzip.compress(data, GZIP_LEVEL, mtime=0)
            at = zipped.write(data)
            index.append(json.dumps({"id": page_id, "offset": at, "length": len(data)}))
            if at + len(data) >= package_bytes:
                close()
    if zipped is not None:
        close()
    if done:
        yield pa.record_batch([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["package", "records"])


class _Ranges:
    """read_at over a pyarrow file, one large read for neighbouring small ones."""

    def __init__(self, f) -> None:
        self.f, self.begin, self.data = f, 0, b""

    def read_at(self, n: int, at: int) -> bytes:
        return self.f.read_at(n, at)

    def range(self, at: int, n: int, limit: int) -> bytes:
        if not (self.begin <= at and at + n <= self.begin + len(self.data)):
            self.begin, self.data = at, self.f.read_at(min(max(n, READ_BYTES), limit - at), at)
        return self.data[at - self.begin : at - self.begin + n]


RECORDS = pa.schema([("package", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_package(uri: str, payloads: bool = True) -> Iterator[dict]:
    """Records of one package: directory, index member, then each record by its range."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as raw:
        f = _Ranges(raw)
        members = read_directory(f, raw.size())
        begin, size, _ = members["archive/data.warc.gz"]
        at, length, crc = members["indexes/index.cdxj"]
        index = f.read_at(length, at)
        if binascii.crc32(index) != crc:
            raise ValueError(f"the index of {uri} is broken")
        for line in index.decode().split("\n"):
            entry = json.loads(line)
            record = parse_record(gzip.decompress(f.range(begin + entry["offset"], entry["length"], begin + size)))
            if not payloads:
                record["payload"] = None
            yield record | {"package": uri}


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            for r in read_package(uri, payloads):
                rows.append(r)
                held += 200 + len(r["payload"] or b"")
                if held >= READ_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, RECORDS)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, RECORDS)


def write_packages(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, package_bytes: int = PACKAGE_BYTES, force64: bool = False) -> DataFrame:
    """Write one record per page into ZIP packages under folder, which all executors share; returns (package, records).

    Of pages with equal payloads of at least `least` bytes, that with the smallest id is a response and the others are
    revisits that refer to it. Smallest ids are found by an aggregate over digests; only digests that occur twice come
    back in a join, whose large partitions Spark can split. A package is written under a name of its own and counts
    only if its task's row is committed, so a task that runs again leaves nothing that is read.

    Null html: an empty payload. Null ids: a response unless another id has the payload. Rows that repeat an id and a
    payload are equal records. Null urls: no target. Empty table: no packages. Other columns are not read.
    """
    ship(pages.sparkSession)
    body = F.coalesce(F.col(html_col), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    first = p.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    p = p.join(first.select("digest", "first"), "digest", "left")
    response = F.col("first").isNull() | F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    rows = p.select("page_id", "url", "html", "digest", F.when(response, F.lit(None)).otherwise(F.col("first")).alias("refers_to"), response.alias("response"))
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    return stage(rows.mapInArrow(lambda it: _write(it, folder, package_bytes, force64), "package string, records long"), "packages")


def read_packages(packages: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Records of the packages named in the column `package`; each package is read by one task, record by record."""
    ship(packages.sparkSession)
    n = max(1, min(packages.count(), 100_000))
    schema = "package string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return packages.select("package").repartition(n).mapInArrow(lambda it: _read(it, payloads), schema)


def op4_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    packages = write_packages(pages, stage_path(spark, "warc"))
    return read_packages(packages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, ((k // 4) * 5 + 1)::INTEGER, 5))::BIGINT >> (5 * (3 - k % 4))::INTEGER) & 31)::INTEGER + 1, 1)), '') AS payload_digest
  FROM p),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM d JOIN f USING (h)
"""
