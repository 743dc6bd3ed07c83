import hashlib
import io
import struct
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import warc
from cohortlens.llm.queries import ORACLE_SQL, op8_warc

DATE = "2024-01-01T00:00:00Z"


def reader(data):
    return lambda start, n: data[start : start + n]


def package(rows, **kw):
    out = io.BytesIO()
    warc.write_package(out, iter(rows), DATE, **kw)
    return out.getvalue()


def row(page, payload=b"x", url="http://a.example/", refers_to=None):
    return page, url, hashlib.sha256(payload).hexdigest(), payload, refers_to


def test_records_come_back_by_range_alone():
    rows = [row(k, f"page {k}".encode() * k) for k in range(50)]
    data = package(rows)
    read, asked = reader(data), []
    found = list(warc.ranges(lambda a, n: asked.append(n) or read(a, n), len(data)))
    assert len(found) == 50
    for (start, n), wanted in zip(found, rows, strict=True):
        got = warc._row(read(start, n))
        assert (got["page_id"], got["payload"], got["payload_digest"]) == (wanted[0], wanted[3], wanted[2])
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None


def test_packages_without_an_index_comment_or_prefix():
    rows = [row(k, b"abc" * k) for k in range(9)]
    whole = zipfile.ZipFile(io.BytesIO(package(rows)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as other:
        other.writestr(warc.DATA, whole.read(warc.DATA))
        other.comment = b"PK\x05\x06 in a comment" * 20
    data = out.getvalue()
    found = list(warc.ranges(reader(data), len(data)))
    assert [warc._row(data[a : a + n])["page_id"] for a, n in found] == list(range(9))


def test_64_bit_directory():
    """Rewrite the directory in its 64-bit form: all 32-bit fields full."""
    data = package([row(1, b"one"), row(2, b"two")])
    start, length, count = warc._directory(reader(data), len(data))
    directory, at = b"", start
    for _ in range(count):
        head = bytearray(data[at : at + 46])
        stored, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", head, 20)
        header = struct.unpack_from("<I", head, 42)[0]
        name = data[at + 46 : at + 46 + n_name]
        at += 46 + n_name + n_extra + n_note
        extra = struct.pack("<HHQQQ", 1, 24, plain, stored, header)
        struct.pack_into("<IIHHH", head, 20, 2**32 - 1, 2**32 - 1, n_name, len(extra), 0)
        struct.pack_into("<I", head, 42, 2**32 - 1)
        directory += bytes(head) + name + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, len(directory), start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(directory), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 2**16 - 1, 2**16 - 1, 2**32 - 1, 2**32 - 1, 0)
    big = data[:start] + directory + end64 + locator + end
    assert warc.members(reader(big), len(big)) == warc.members(reader(data), len(data))
    assert [warc._row(big[a : a + n])["payload"] for a, n in warc.ranges(reader(big), len(big))] == [b"one", b"two"]


def test_broken_packages_are_refused():
    data = package([row(1)])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as other:
        other.writestr(warc.DATA, b"x" * 1000)
    for bad in (b"", b"no package at all", data[:-30], out.getvalue()):
        with pytest.raises((ValueError, KeyError)):
            list(warc.ranges(reader(bad), len(bad)))


def test_round_trip_with_copies_nulls_and_odd_values(spark, tmp_path):
    long = "é" * 60
    rows = [(5, None, long), (3, "http://x/\r\nEvil: 1", long), (9, "u", long), (None, "u", long), (1, "u", "short")]
    rows += [(2, "u", "short"), (4, None, None), (6, "", ""), (None, None, "alone " * 50), (7, "u", "big" * 500_000)]
    ddl = "page_id long, url string, html string, refers_to string, payload_digest int"
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], ddl).repartition(3)
    made = warc.written_packages(df, f"file://{tmp_path}/w", DATE, package_bytes=2000)
    assert sum(r.records for r in made.collect()) == len(rows) and made.count() > 1
    got = warc.read_packages(made).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit") == (r.refers_to is not None)
        if r.payload is not None:
            assert r.payload_digest == hashlib.sha256(r.payload).hexdigest()
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(5, 3), (9, 3), (None, 3)}
    assert {r.payload_bytes for r in got if r.record_type == "revisit"} == {120}
    assert {r.url for r in got if r.page_id == 3} == {"http://x/%0D%0AEvil:%201"}
    empty = warc.written_packages(df.limit(0), f"file://{tmp_path}/e", DATE)
    assert empty.count() == 0 and warc.read_packages(empty).count() == 0


def test_rows_of_the_smallest_page_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "y" * 100)] * 2 + [(2, "u", "y" * 100)], "page_id long, url string, html string")
    got = warc.with_records(df).groupBy("page_id", "record_type", "refers_to").agg(F.count("*").alias("n")).collect()
    assert {tuple(r) for r in got} == {(1, "response", None, 2), (2, "revisit", 1, 1)}


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{folder}/pages.parquet'")
    want = con.sql(ORACLE_SQL["op8_warc"])
    got = op8_warc(spark, folder).select(want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_headers_of_any_length_come_back():
    wanted = [row(1, b"one", url="http://a.example/" + "x" * 3_000_000), row(2, b"two")]
    data = package(wanted)
    got = [warc._row(reader(data)(start, n)) for start, n in warc.ranges(reader(data), len(data))]
    assert [(g["page_id"], g["url"], g["payload"]) for g in got] == [(w[0], w[1], w[3]) for w in wanted]


def test_records_are_read_by_many_tasks(spark, tmp_path):
    line = lambda i: F.sha2(F.concat_ws("-", "id", i).cast("binary"), 256)
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1500)), line), "")
    pages = spark.range(240).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), body.alias("html"))
    made = warc.written_packages(pages.coalesce(1), str(tmp_path / "w"), "1999-01-01T00:00:00Z")
    found = warc.read_packages(made).withColumn("task", F.spark_partition_id()).select("page_id", "task").collect()
    assert sorted(r.page_id for r in found) == list(range(240))
    assert len({r.task for r in found}) >= 2
