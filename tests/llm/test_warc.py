import gzip
import os

import pytest

from lotscope.llm import queries, warc
from lotscope.plans.lineage import new_folder
from tests.compare import check

A, B = "<p>" + "a" * 200, "<p>é" + "b" * 300


@pytest.fixture
def archives(spark):
    rows = [(1, "http://x/1", A), (2, "http://x/2", A), (3, None, B), (4, "http://y/4", "short"), (5, "http://y/5", "short"), (6, "u", None),
            (0, "http://x/0", A), (None, "http://n/", A), (3, None, B)]
    path = new_folder(spark, "warc")
    warc.write(warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)), path)
    return path


def test_round_trip(spark, archives):
    got = sorted((r.record_id, r.record_type, r.refers_to or "", r.payload_bytes, r.payload.decode() if r.payload is not None else None)
                 for r in warc.read(spark, archives, verify=True).collect())
    name = "urn:page:".__add__
    assert got == sorted([(name("0"), "response", "", 203, A), *((name(i), "revisit", name("0"), 203, None) for i in ("", "1", "2")),
                          *[(name("3"), "response", "", len(B.encode()), B)] * 2, (name("4"), "response", "", 5, "short"),
                          (name("5"), "response", "", 5, "short"), (name("6"), "response", "", 0, "")])


def test_predicates_reach_the_reader(spark, archives, monkeypatch):
    read = warc.read(spark, archives, payload=False)
    assert read.filter("record_type = 'revisit'").count() == 3
    assert read.filter("target_uri like 'http://y/%' and record_type in ('response', 'x')").count() == 2
    assert read.filter("record_type = 'nothing'").count() == 0
    reader = warc.WarcReader({"path": archives, "payload": "false"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.tests == [("record_type", "in", ("revisit",))]
    inflated = []
    monkeypatch.setattr(warc._Member, "block", lambda *a: inflated.append(a) or b"")
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in rows) == 3 == len(inflated)  # the other members are stepped over after their headers


def test_other_archives(spark, tmp_path):
    record = lambda kind, body: (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{kind}>\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + b"z" * 200_000
    plain = record("warcinfo", b"a: b\r\n") + record("response", http) + record("request", b"GET /")
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(k, b)) for k, b in (("warcinfo", b"a"), ("response", http), ("request", b"GET"))))
    (tmp_path / "_empty").write_bytes(b"")
    got = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r.archive, r.record_type, len(r.payload)) for r in got) == [
        ("a.warc", "request", 5), ("a.warc", "response", 200_000), ("a.warc", "warcinfo", 6),
        ("b.warc.gz", "request", 3), ("b.warc.gz", "response", 200_000), ("b.warc.gz", "warcinfo", 1)]
    assert warc.read(spark, str(tmp_path), payload=False).filter("record_type = 'request'").count() == 2


def test_large_archives_are_split_and_damage_is_seen(spark, tmp_path):
    rows = spark.range(200).selectExpr("'response' as record_type", "concat('urn:', id) as record_id", "'u' as target_uri",
                                       "cast(null as string) as refers_to", "cast(repeat(md5(cast(id as string)), 100) as binary) as payload").coalesce(1)
    warc.register(spark)
    rows.write.format("warc").option("archive_bytes", 20_000).mode("append").save(str(tmp_path / "w"))
    names = os.listdir(tmp_path / "w")
    assert len(names) > 1 and warc.read(spark, str(tmp_path / "w")).count() == 200
    data = bytearray((tmp_path / "w" / names[0]).read_bytes())
    data[len(data) // 2] ^= 255
    (tmp_path / "w" / names[0]).write_bytes(data)
    with pytest.raises(Exception):
        warc.read(spark, str(tmp_path / "w"), verify=True).collect()


def test_empty_table_and_folder(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(warc.with_revisits(empty), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_query_against_sql(spark):
    text, _, ok = check(spark, "/root/testdata/sf0.01", queries.op7_warc, queries.SQL["op7_warc"])
    assert ok, text


def test_several_records_in_a_gzip_stream(spark, tmp_path):
    record = lambda i, body: f"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    sizes = [5, 0, 300_000, 65_536, 7]
    stream = [record(i, b"z" * n) for i, n in enumerate(sizes)]
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(stream)))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(b"".join(stream[:3])) + gzip.compress(b"".join(stream[3:])))
    (tmp_path / "plain.warc").write_bytes(b"".join(stream) + b"\r\n")
    read = lambda: [(r["archive"], r["record_id"], len(r["payload"])) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    reader = warc.WarcReader({"path": str(tmp_path)})
    want = [(name, str(i), n) for name in ("one.warc.gz", "plain.warc", "two.warc.gz") for i, n in enumerate(sizes)]
    assert read() == want
    reader.tests = [("record_id", "in", ("4",))]  # the blocks before it are not asked for
    assert read() == [w for w in want if w[1] == "4"]
    for bad in (b"".join(stream[:2]) + b"no header", stream[0] + b"WARC/1.0\r\nx", stream[0] + stream[2][:1000]):
        for name, data in (("bad.warc", bad), ("bad.warc", gzip.compress(bad))):
            (tmp_path / name).write_bytes(data)
            reader.tests = [("record_id", "in", ("none",))]
            with pytest.raises(ValueError):
                read()
