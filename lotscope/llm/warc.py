"""WARC archives as a Spark data source in Python.

Writing makes one archive per task, or several once one is large, under hidden names; the commit gives them their names,
so attempts that failed leave nothing behind that a reader sees. Records are gzip members that state their own length
in the header's extra field ("sl"), so a reader can step over a record without inflating it.

Reading plans a partition per archive. Headers are parsed first; predicates on record type, URI, id and digest that
Spark pushes down decide from them whether the record is wanted, and the rest of its member is inflated only if so and
only if payloads are asked for. Archives by others, gzipped without lengths or plain, are read as well.

Files are reached through Arrow's file systems, by local path or by URI (file, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition,
                                    StringStartsWith, WriterCommitMessage)

#: A new archive begins after so many bytes.
ARCHIVE_BYTES = 128 << 20
#: Smallest payload whose repeats are written as revisits.
LEAST_REVISIT = 100
SCHEMA = ("record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
          "payload_bytes bigint, payload binary, archive string, offset bigint")
_PUSHED = ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")
_HEADER = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
           "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
_END = b"\r\n\r\n"
_HEAD_READ = 4096


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def make_record(kind: str, record_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header of its payload, a response the payload too."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + record_id.encode() + b">",
             b"WARC-Date: " + date.encode(), b"WARC-Payload-Digest: sha256:" + hashlib.sha256(payload).hexdigest().encode()]
    if uri is not None:
        lines.append(b"WARC-Target-URI: " + " ".join(uri.split()).encode())
    if kind == "revisit":
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  b"WARC-Refers-To: <" + (refers_to or "").encode() + b">"]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    record = b"\r\n".join(lines) + _END + block + _END
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    length = 10 + 2 + 12 + len(body) + 8
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, length, len(record) & 0xFFFFFFFF)
            + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF))


class Written(NamedTuple):
    names: tuple[str, ...]


class _Commit(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of record_type, record_id, target_uri, refers_to and payload."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.date = options["path"].rstrip("/"), options.get("date", "1970-01-01T00:00:00Z")
        self.limit = int(options.get("archive_bytes", ARCHIVE_BYTES))
        if overwrite:
            files, root = file_system(self.path)
            if files.get_file_info(root).type != arrow_fs.FileType.NotFound:
                files.delete_dir_contents(root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Commit:
        files, root = file_system(self.path)
        files.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                columns = [batch.column(c) for c in ("record_type", "record_id", "target_uri", "payload", "refers_to")]
                for i in range(batch.num_rows):
                    kind, record_id, uri, payload, refers = (c[i].as_py() for c in columns)
                    if out is None:
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = files.open_output_stream(f"{root}/.{names[-1]}", compression=None), 0
                    record = make_record(kind or "response", record_id or "", uri, payload or b"", refers, self.date)
                    out.write(record)
                    size += len(record)
                    if size >= self.limit:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return _Commit(names)

    def commit(self, messages) -> None:
        files, root = file_system(self.path)
        files.create_dir(root, recursive=True)
        for message in messages:
            for name in message.names if message else ():
                files.move(f"{root}/.{name}", f"{root}/{name}")

    def abort(self, messages) -> None:
        files, root = file_system(self.path)
        for message in messages:
            for name in message.names if message else ():
                files.delete_file(f"{root}/.{name}")


class Archive(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class WarcReader(DataSourceReader):
    """Reads archives; ``payload`` = false leaves payloads undecoded (null), ``verify`` = true checks digests of payloads."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in _PUSHED and isinstance(f, EqualTo) and f.value is not None:
                self.tests.append((column, "in", (f.value,)))
            elif column in _PUSHED and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in _PUSHED and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", (f.value,)))
            else:
                yield f

    def partitions(self):
        files, root = file_system(self.path)
        found = files.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True))
        return [Archive(x.base_name) for x in sorted(found, key=lambda x: x.base_name)
                if x.type == arrow_fs.FileType.File and x.base_name[0] not in "._" and x.size] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, root = file_system(self.path)
        rows, size = [], 0
        with files.open_input_file(f"{root}/{partition.name}") as source:
            for offset, header, rest in _records(source):
                row = _fields(header)
                if not all(_passes(row[c], how, values) for c, how, values in self.tests):
                    continue
                if row["record_type"] in ("response", "revisit"):
                    block = rest(None if self.payload or self.verify else _END)
                    http, _, payload = block.partition(_END)
                    stated = _lines(http).get("content-length", "")
                    whole = row["record_type"] == "response" and (self.payload or self.verify)
                    row["payload_bytes"] = len(payload) if whole else int(stated) if stated.isdigit() else None
                    if whole and self.verify and row["payload_digest"] != hashlib.sha256(payload).hexdigest():
                        raise ValueError(f"payload of {row['record_id']} in {partition.name} does not match its digest")
                    row["payload"] = payload if whole and self.payload else None
                elif self.payload:
                    row["payload"] = rest(None)
                    row["payload_bytes"] = len(row["payload"])
                rows.append(row | {"archive": partition.name, "offset": offset})
                size += len(row["payload"] or b"")
                if len(rows) >= 5000 or size >= 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([(c, pa.string()) for c in _PUSHED] + [("payload_bytes", pa.int64()), ("payload", pa.binary()),
                                                          ("archive", pa.string()), ("offset", pa.int64())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _passes(value: str | None, how: str, values: tuple) -> bool:
    return value is not None and (value in values if how == "in" else value.startswith(values[0]))


def _lines(header: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in header.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _fields(header: bytes) -> dict:
    lines = _lines(header)
    row = {column: lines.get(name) for column, name in _HEADER.items()}
    for column in ("record_id", "refers_to"):
        if row[column] is not None:
            row[column] = row[column].removeprefix("<").removesuffix(">")
    if row["payload_digest"] is not None:
        row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
    return row | {"payload_bytes": None, "payload": None}


def _records(source) -> Iterator[tuple[int, bytes, object]]:
    """Offset and header of every record, and a function that reads its block, whole or up to a mark.

    Records of one gzip member share its offset. Anything but white space where a record should begin is an error.
    """
    at, total = 0, source.size()
    while at < total:
        source.seek(at)
        head = source.read(_HEAD_READ)
        member = _Member(source, at, head) if head[:2] == b"\x1f\x8b" else _Plain(source, at, head)
        while header := member.until(_END):
            if not header.startswith(b"WARC/"):
                raise ValueError(f"no record begins where one should, at or after byte {at}")
            length = int(_lines(header).get("content-length", "0"))
            yield member.at, header, lambda mark, m=member, n=length: m.block(n, mark)
            if not member.step(length):
                break
        at = member.end()


class _Member:
    """Records in a gzip member, inflated as far as they are needed."""

    def __init__(self, source, at: int, head: bytes):
        self.source, self.at, self.length, self.whole, self.made, self.taken = source, at, None, None, b"", 0
        if head[3] & 4:
            size = struct.unpack_from("<H", head, 10)[0]
            extra = head[12:12 + size]
            while len(extra) >= 4:
                name, n = extra[:2], struct.unpack_from("<H", extra, 2)[0]
                if name == b"sl" and n == 8:
                    self.length, self.whole = struct.unpack_from("<II", extra, 4)
                extra = extra[4 + n:]
        self.inflate, self.waiting, self.passed, self.stepped = zlib.decompressobj(31), head, 0, False
        self.read = len(head)

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        if not self.waiting:
            self.source.seek(self.at + self.read)
            self.waiting = self.source.read(1 << 16)
            self.read += len(self.waiting)
            if not self.waiting:
                raise ValueError("an archive ends within a record")
        self.made += self.inflate.decompress(self.waiting, 1 << 16)
        self.waiting = self.inflate.unconsumed_tail
        return True

    def _drop(self, n: int) -> None:
        self.made, self.passed = self.made[n:], self.passed + n

    def until(self, mark: bytes) -> bytes:
        """Bytes up to a mark, after white space; none if nothing but that is left."""
        while not self.made or self.made[0] in b"\r\n":
            self._drop(len(self.made) - len(self.made.lstrip(b"\r\n")))
            if not self.made and not self._more():
                return b""
        at = 0
        while (i := self.made.find(mark, at)) < 0:
            at = max(0, len(self.made) - len(mark) + 1)
            if len(self.made) >= 5 and not self.made.startswith(b"WARC/") or not self._more():
                raise ValueError(f"a record of the member at byte {self.at} has no header")
        out, self.taken = self.made[:i], i + len(mark)
        return out

    def block(self, length: int, mark: bytes | None) -> bytes:
        while len(self.made) < self.taken + length and not (mark and mark in self.made[self.taken:]):
            if not self._more():
                raise ValueError(f"a record of the member at byte {self.at} is cut off")
        return self.made[self.taken:self.taken + length]

    def step(self, length: int) -> bool:
        """Go behind the block of a record; whether another may follow. A member that states that it ends there is stepped over."""
        left = self.taken + length
        if self.whole is not None and self.passed + left + len(_END) == self.whole:
            self.stepped = True
            return False
        while left > len(self.made):
            left -= len(self.made)
            self._drop(len(self.made))
            if not self._more():
                raise ValueError(f"a record of the member at byte {self.at} is cut off")
        self._drop(left)
        return True

    def end(self) -> int:
        if self.stepped:
            return self.at + self.length
        return self.at + self.read - len(self.inflate.unused_data)


class _Plain:
    """A record that is not compressed."""

    def __init__(self, source, at: int, head: bytes):
        self.source, self.at, self.made, self.behind = source, at, head, None

    def _more(self) -> bool:
        self.source.seek(self.at + len(self.made))
        more = self.source.read(1 << 16)
        self.made += more
        return bool(more)

    def until(self, mark: bytes) -> bytes:
        """Bytes up to a mark, after white space; none if nothing but that is left."""
        while not self.made or self.made[0] in b"\r\n":
            blank = len(self.made) - len(self.made.lstrip(b"\r\n"))
            self.made, self.at = self.made[blank:], self.at + blank
            if not self.made and not self._more():
                self.behind = self.at
                return b""
        at = 0
        while (i := self.made.find(mark, at)) < 0:
            at = max(0, len(self.made) - len(mark) + 1)
            if len(self.made) >= 5 and not self.made.startswith(b"WARC/") or not self._more():
                raise ValueError(f"a record at byte {self.at} has no header")
        self.start = i + len(mark)
        return self.made[:i]

    def block(self, length: int, mark: bytes | None) -> bytes:
        self.source.seek(self.at + self.start)
        if mark is None:
            return self.source.read(length)
        return self.source.read(min(length, 1 << 16))

    def step(self, length: int) -> bool:
        self.behind = self.at + self.start + length
        if self.behind > self.source.size():
            raise ValueError(f"a record at byte {self.at} is cut off")
        return False

    def end(self) -> int:
        return self.behind


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark) -> None:
    """Make the format known to the session and let Spark push predicates into it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, key: str = "page_id", uri: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Records to write: of equal payloads of at least ``least`` bytes, that with the smallest key is the response.

    The others revisit it. A null page is an empty payload; rows of one key and payload are all responses; rows without
    a key revisit if a row with one has the payload.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(uri).alias("target_uri"), F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    heads = rows.filter("digest is not null").groupBy("digest").agg(F.min("key").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    later = F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("key"))
    return rows.join(heads, "digest", "left").select(
        F.when(later, "revisit").otherwise("response").alias("record_type"), name("key").alias("record_id"), "target_uri",
        F.when(later, name("head")).alias("refers_to"), "payload")


def write(records: DataFrame, path: str) -> None:
    """Write records into a new or existing folder of archives."""
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read(spark, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """Records of a folder of archives."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload)).option("verify", str(verify)).load(path)
