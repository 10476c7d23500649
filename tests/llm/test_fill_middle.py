import hashlib
import re

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lotscope.llm import fill_middle, queries
from tests.compare import check
from tests.llm.helpers import docs, prose

TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb\nc", "a\r\nb c\n", "has <P> in it", "<M>", "almost <P <S <M\n> <", "é日😀\n" * 50,
         "x" * 300, prose(3000).replace(" ", "\n"), "\n".join("long" * 40 + str(i) for i in range(200))]


def brute(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 16])
@pytest.mark.parametrize("seed,rate,spm", [(7, 100, 50), (3, 60, 0), (5, 90, 100)])
def test_forms(spark, size, seed, rate, spm):
    rows = [(10 * k + i, t) for k in range(3) for i, t in enumerate(TEXTS) if size > 7 or len(t or "") < 400] + [(None, "a\nb"), (1, "a\nb"), (1, "a\nb")]
    made = fill_middle.rearrange(fill_middle.pack(docs(spark, *rows, n=1, form="x", output=2), size=size), seed, rate, spm)
    want = [(d, *brute(d, t, seed, rate, spm), t) for d, t in rows]
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got = fill_middle.digest(made).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(*w[:5], sha(w[5]), sha(w[6])) for w in want], key=str)
    assert sorted(map(tuple, fill_middle.texts(made).collect()), key=str) == sorted([(w[0], w[2], w[5]) for w in want], key=str)


def test_frames_that_no_cut_touches_are_taken_over(spark):
    text = "\n".join(f"line {i}" for i in range(5000))
    packed = fill_middle.pack(docs(spark, (4, text)), size=1000)
    frames = [f.data for f in packed.first().frames]
    made = fill_middle.rearrange(packed).first()
    kept = sum(bytes(f) in set(map(bytes, frames)) for f in made.output)
    assert made.form != "plain" and kept >= len(frames) - 2
    assert zstandard.ZstdDecompressor().stream_reader(b"".join(map(bytes, made.output)), read_across_frames=True).read().decode() == brute(4, text)[4]


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="ab<PSM>\n é😀", max_size=60), st.integers(1, 9))
def test_cuts_are_found_in_one_frame(text, size):
    coder, reader = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
    packed = fill_middle.Text.pack(text.encode(), coder, size)
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert packed.n == len(lines)
    for after in range(packed.n + 1):
        cut = packed.cut(after, reader)
        assert cut.chars == len("".join(lines[:after]))
        start = fill_middle.Cut(0, 0, 0)
        assert b"".join(map(reader.decompress, packed.between(start, cut, coder, reader))).decode() == "".join(lines[:after])


def test_a_missing_mark_is_an_error():
    coder, reader = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
    with pytest.raises(ValueError):
        list(fill_middle.restore([coder.compress(b"no marks")], "psm", fill_middle.MARKS, reader))


def test_empty_table_and_long_text(spark):
    assert fill_middle.digest(fill_middle.rearrange(fill_middle.pack(docs(spark, (1, "a")).limit(0)))).count() == 0
    text = "word " * 600_000 + "\n" + "é" * 1_000_000
    got = fill_middle.digest(fill_middle.rearrange(fill_middle.pack(docs(spark, (2, text))))).first()
    assert got.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got.output_sha256 == hashlib.sha256(brute(2, text)[4].encode()).hexdigest()


def test_query_against_sql(spark):
    text, _, ok = check(spark, "/root/testdata/sf0.001", queries.op13_fill_middle, queries.SQL["op13_fill_middle"])
    assert ok, text
