"""Fill-in-the-middle forms of documents, cut out of texts that are stored as seekable compressed frames.

A text is a list of independent zstandard frames of bounded size. Each frame carries how many lines and code points end
in it and in the frames before it, so a cut after any number of lines is found by a search in these counts and by
decompressing one frame. An output text is a list of frames again: frames that no cut touches are taken over as they
are, only the pieces of cut frames and the marks are compressed anew. (Frames in a row are a valid zstandard stream.)
Digests and the rebuilt text read one frame after the other, so no step after packing holds more than one frame of text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lotscope.llm.words import BATCH_BYTES, as_text, slices

FRAME_BYTES = 1 << 16
LEVEL = 3
FRAMES = "array<struct<units: bigint, chars: bigint, data: binary>>"
_FRAMES = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())]))


class Marks(NamedTuple):
    """Texts that begin the parts of an output; none may be a part of another one, or end as another one begins."""
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


MARKS = Marks()


class Text:
    """A text as frames: ``units`` and ``chars`` count up to the end of each frame."""

    def __init__(self, units: list[int], chars: list[int], data: list[bytes]):
        self.units, self.chars, self.data = units, chars, data

    @classmethod
    def pack(cls, text: bytes, coder: zstandard.ZstdCompressor, size: int = FRAME_BYTES) -> Text:
        """Frames of about ``size`` bytes, cut between code points. A last line without a line feed counts as well."""
        units, chars, data, start, n, m = [], [], [], 0, 0, 0
        while start < len(text):
            end = min(start + size, len(text))
            while end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
            piece = text[start:end]
            n += piece.count(b"\n") + (end == len(text) and piece[-1] != 10)
            m += len(piece.decode())
            units.append(n), chars.append(m), data.append(coder.compress(piece))
            start = end
        return cls(units, chars, data)

    @property
    def n(self) -> int:
        return self.units[-1] if self.units else 0

    def cut(self, after: int, reader: zstandard.ZstdDecompressor) -> Cut:
        """The place after so many units (at most ``n``)."""
        if after == 0:
            return Cut(0, 0, 0)
        at = bisect_left(self.units, after)
        piece = reader.decompress(self.data[at])
        more = after - (self.units[at - 1] if at else 0)
        ends = np.flatnonzero(np.frombuffer(piece, np.uint8) == 10)
        offset = int(ends[more - 1]) + 1 if more <= len(ends) else len(piece)
        return Cut(at, offset, (self.chars[at - 1] if at else 0) + len(piece[:offset].decode()))

    def between(self, a: Cut, b: Cut, coder, reader) -> Iterator[bytes]:
        """Frames of the text from one cut to another: whole ones as they are, pieces compressed anew."""
        for i in range(a.frame, min(b.frame, len(self.data) - 1) + 1):
            if i > a.frame and i < b.frame:
                yield self.data[i]
                continue
            piece = reader.decompress(self.data[i])
            start, end = a.offset if i == a.frame else 0, b.offset if i == b.frame else len(piece)
            if start == 0 and end == len(piece):
                yield self.data[i]
            elif start < end:
                yield coder.compress(piece[start:end])


class Cut(NamedTuple):
    frame: int
    offset: int
    chars: int


def plan(doc_id, n: int, marked: bool, seed: int, rate: int, spm_rate: int) -> tuple[str, int, int]:
    """Form of a document of ``n`` units, and the units before the middle and before the suffix.

    All follows from the hash of seed and id: ``rate`` of 100 documents are rearranged, ``spm_rate`` of 100 of those
    with the suffix first. Empty texts and texts that hold a mark stay plain.
    """
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(name[i:i + 8], 16) for i in (0, 8, 16, 24)]
    if n == 0 or marked or h[2] % 100 >= rate:
        return "plain", 0, 0
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return "spm" if h[3] % 100 < spm_rate else "psm", a, b


def _order(form: str, marks: Marks) -> tuple[str, ...]:
    return (marks.prefix, marks.suffix, marks.middle) if form == "psm" else (marks.suffix, marks.prefix, marks.middle)


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows (each with its number of bytes first) as batches of about ``size`` bytes."""
    held, total = [], 0
    for weight, *row in rows:
        held.append(row)
        total += weight + 64
        if total >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def pack(docs: DataFrame, marks: Marks = MARKS, size: int = FRAME_BYTES) -> DataFrame:
    """``doc_id``, ``marked`` (the text holds one of the marks) and ``frames`` of every row of ``docs`` (doc_id, text).

    A null text is the empty text, which has no frames. Other columns of ``docs`` are left out; repeated rows stay.
    """
    some = [m.encode() for m in marks]
    schema = pa.schema([("doc_id", pa.int64()), ("marked", pa.bool_()), ("frames", _FRAMES)])

    def rows(batches):
        coder = zstandard.ZstdCompressor(level=LEVEL)
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_text(batch.column("text")).cast(pa.large_binary())):
                text = text.as_buffer().to_pybytes()
                made = Text.pack(text, coder, size)
                frames = [{"units": u, "chars": c, "data": d} for u, c, d in zip(made.units, made.chars, made.data)]
                yield sum(map(len, made.data)), doc_id, any(m in text for m in some), frames

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(
        lambda batches: _batches(rows(batches), schema), f"doc_id bigint, marked boolean, frames {FRAMES}")


def _lists(column: pa.ListArray) -> Iterator[pa.Array]:
    """The part of each row of a list column; null is an empty one."""
    values, offsets, valid = column.values, column.offsets.to_pylist(), column.is_valid().to_pylist()
    for a, b, v in zip(offsets, offsets[1:], valid):
        yield values.slice(a, b - a if v else 0)


def rearrange(packed: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, marks: Marks = MARKS) -> DataFrame:
    """Rows of ``pack`` in their form: ``doc_id``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    ``output`` is the new text as an array of zstandard frames; a plain one has the frames of the text, and no numbers
    of code points. ``marks`` must be those that the texts were packed with.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("output", pa.list_(pa.binary()))])

    def rows(batches):
        coder, reader = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        mark = {m: coder.compress(m.encode()) for m in marks}
        for batch in batches:
            for doc_id, marked, frames in zip(batch.column("doc_id").to_pylist(), batch.column("marked").to_pylist(), _lists(batch.column("frames"))):
                text = Text(*(frames.field(i).to_pylist() for i in range(3)))
                form, before, upto = plan(doc_id, text.n, marked, seed, rate, spm_rate)
                if form == "plain":
                    yield sum(map(len, text.data)), doc_id, text.n, form, None, None, text.data
                    continue
                a, b, end = text.cut(before, reader), text.cut(upto, reader), Cut(len(text.data), 0, text.chars[-1])
                parts = {marks.prefix: (Cut(0, 0, 0), a), marks.middle: (a, b), marks.suffix: (b, end)}
                out = [f for m in _order(form, marks) for f in (mark[m], *text.between(*parts[m], coder, reader))]
                yield sum(map(len, out)), doc_id, text.n, form, a.chars, b.chars - a.chars, out

    return packed.select("doc_id", "marked", "frames").mapInArrow(
        lambda batches: _batches(rows(batches), schema),
        "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output array<binary>")


def restore(frames: list[bytes], form: str, marks: Marks, reader: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """Pieces of the text that an output came from, in its order, read from the output and its form alone.

    A mark must lie inside one frame, as ``rearrange`` writes it.
    """
    if form == "plain":
        yield from map(reader.decompress, frames)
        return
    order, places, at = [m.encode() for m in _order(form, marks)], [], 0
    for i, frame in enumerate(frames):
        piece, start = reader.decompress(frame), 0
        while at < len(order) and (found := piece.find(order[at], start)) >= 0:
            start = found + len(order[at])
            places.append(((i, found), (i, start)))
            at += 1
    if at < len(order):
        raise ValueError(f"a mark of form {form} is missing")
    ends = [p[0] for p in places[1:]] + [(len(frames), 0)]
    parts = dict(zip(order, zip((p[1] for p in places), ends)))
    for m in (marks.prefix, marks.middle, marks.suffix):
        (i, start), (j, end) = parts[m.encode()]
        for k in range(i, min(j, len(frames) - 1) + 1):
            piece = reader.decompress(frames[k])
            yield piece[start if k == i else 0:end if k == j else len(piece)]


def digest(made: DataFrame, marks: Marks = MARKS) -> DataFrame:
    """Rows of ``rearrange`` with ``output_sha256`` and ``restored_sha256`` (of the text rebuilt from output and form) for ``output``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])

    def sha(pieces: Iterable[bytes]) -> str:
        state = hashlib.sha256()
        for p in pieces:
            state.update(p)
        return state.hexdigest()

    def rows(batches):
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            kept = zip(*(batch.column(c).to_pylist() for c in schema.names[:5]))
            for row, frames in zip(kept, _lists(batch.column("output"))):
                frames = frames.to_pylist()
                yield 0, *row, sha(map(reader.decompress, frames)), sha(restore(frames, row[2], marks, reader))

    return made.select(*schema.names[:5], "output").mapInArrow(
        lambda batches: _batches(rows(batches), schema),
        "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string")


def texts(made: DataFrame) -> DataFrame:
    """Rows of ``rearrange`` with the whole new ``text`` for ``output``."""
    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("text", pa.string())])

    def rows(batches):
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc_id, form, frames in zip(batch.column("doc_id").to_pylist(), batch.column("form").to_pylist(), _lists(batch.column("output"))):
                text = b"".join(map(reader.decompress, frames.to_pylist()))
                yield len(text), doc_id, form, text.decode()

    return made.select("doc_id", "form", "output").mapInArrow(lambda batches: _batches(rows(batches), schema), "doc_id bigint, form string, text string")
