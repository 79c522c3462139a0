import base64
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from weirlog.llm import archives


class Memory:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


class Sink(io.BytesIO):
    def close(self):
        self.whole = self.getvalue()
        super().close()


@pytest.mark.parametrize("force64", [False, True])
def test_zip_files(force64):
    sink = Sink()
    z = archives.ZipWriter(sink, force64)
    want = {"a/b.txt": b"x" * 1000, "é.bin": b"", "c": bytes(range(256)) * 9}
    for name, data in want.items():
        z.begin(name)
        z.write(data[:7])
        z.write(data[7:])
        z.end()
    z.close()
    with zipfile.ZipFile(io.BytesIO(sink.whole)) as f:
        assert {n: f.read(n) for n in f.namelist()} == want
        assert f.testzip() is None
    found = archives.read_directory(Memory(sink.whole), len(sink.whole))
    assert {n: sink.whole[at : at + size] for n, (at, size, _) in found.items()} == want


def test_other_writers_and_broken_files():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as f:
        f.writestr("one", b"1" * 50)
        f.writestr(zipfile.ZipInfo("two"), b"22", zipfile.ZIP_DEFLATED)
        f.comment = b"PK\x05\x06 a comment that looks like an end"
    data = out.getvalue()
    found = archives.read_directory(Memory(data), len(data))
    assert set(found) == {"one"}  # only stored members can be read by range
    with pytest.raises(ValueError, match="no ZIP end"):
        archives.read_directory(Memory(data[:40]), 40)


ROWS = [(3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", "é " * 9), (7, "u\r\nx", "long " * 300_000), (None, "u", "other"), (8, "u", "other"), (9, "u", "x"), (9, "u", "x")]


@pytest.mark.parametrize("force64", [False, True])
def test_round_trip(spark, tmp_path, clash, force64):
    pages = clash(spark.createDataFrame(ROWS, "page_id long, url string, html string"))
    packages = archives.write_packages(pages.repartition(3), f"file://{tmp_path}/w", package_bytes=20_000, force64=force64)
    rows = archives.read_packages(packages).collect()
    first = {}
    for i, _, html in ROWS:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=repr)
    want = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        lead = first.get(html or "")
        response = lead is None or i == lead
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else lead))
    assert got == sorted(want, key=repr)
    texts = {r["page_id"]: r["payload"].decode() for r in rows if r["payload"] is not None}
    assert texts == {i: html or "" for i, _, html in ROWS if i in (1, 4, 6, 7, 8, 9)}
    assert packages.agg(F.sum("records")).first()[0] == len(ROWS)


def test_least_payload(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = archives.read_packages(archives.write_packages(pages, f"file://{tmp_path}/w", least=5)).collect()
    assert {r["page_id"]: r["record_type"] for r in got} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.read_packages(archives.write_packages(pages, f"file://{tmp_path}/w")).count() == 0


def test_damage_is_noticed(spark):
    data = archives.record_bytes(1, "u", b"payload", base64.b32encode(hashlib.sha1(b"payload").digest()).decode(), None, True)
    assert archives.parse_record(data)["payload"] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        archives.parse_record(data.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))


def test_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    want = con.sql(archives.SQL).fetchall()
    got = archives.op4_warc_packages(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
