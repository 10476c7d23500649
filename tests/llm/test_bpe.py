import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lotscope.llm import bpe, queries
from tests.llm.helpers import docs, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tables():
    return bpe.vocabulary(bpe.load_vocabulary(PATH)), Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(3)
    alphabet = ["a", "e", "th", " ", "\n", "é", "日", "😀", "the", "ing", "-", "=", "1", "'s", "\t", "ÃÂ", " ", "\x1c", "<|endoftext|>"]
    yield from ["", "   ", "a" * 5000, " " * 3000, "<|endoftext|>x <|endoftext|>", "<|endoftext", "\r\n\r\n \t x　y", "=-" * 2000, "\x00\x01�"]
    yield from ("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(800))
    yield from (a + chr(c) + b for c in (9, 10, 28, 31, 133, 160, 5760, 8203, 8232, 12288, 65279) for a in ("a", " ", "") for b in ("b", "  c"))


def test_equals_merging(tables):
    own, other = tables
    for text in odd_texts():
        ids = own.encode(text)
        assert ids == other.encode(text, add_special_tokens=False).ids, text[:60]
        assert own.decode(np.array(ids, np.int64)) == other.decode(ids, skip_special_tokens=False)


def test_random_tokens_side_by_side(tables):
    own, other = tables
    rng, known = random.Random(5), list(own.id_of)
    for _ in range(500):
        text = "".join(rng.choice(known).encode("latin-1").decode("utf-8", "replace") for _ in range(20))
        assert own.encode(text) == other.encode(text, add_special_tokens=False).ids


def test_memories_may_be_emptied(tables, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    own = bpe.Vocabulary(bpe.load_vocabulary(PATH))
    assert own.encode("one two three one two four") == tables[1].encode("one two three one two four").ids


def test_query_on_all_documents(spark):
    own = Tokenizer.from_file(PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in table(spark, "documents").select("doc_id", "text").collect():
        ids = own.encode(r.text, add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False))))
    got = queries.op1_bpe(spark, "/root/testdata/sf0.001").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_nulls_repeats_and_clashing_columns(spark):
    text = bpe.load_vocabulary(PATH)
    rows = docs(spark, (1, None), (1, None), (None, "a b"), (2, ""), ids="x", decoded=3, n_tokens="y")
    got = sorted((r.doc_id or 0, r.ids, r.decoded, r.n_tokens) for r in bpe.round_trip(rows, text).collect())
    assert [g[1] for g in got] == [[64, 275], [], [], []] and [g[2] for g in got] == ["a b", "", "", ""]
    assert bpe.round_trip(rows.limit(0), text).count() == 0
    assert bpe.decode(rows.selectExpr("doc_id", "cast(null as array<int>) as ids"), text).first().decoded == ""


def test_workers_forget_what_a_task_remembered(spark):
    text = bpe.load_vocabulary(PATH)
    bpe.digest(docs(spark, *((i, f"some words of number {i}") for i in range(64))).repartition(16), text).collect()

    def left(batches):
        table = bpe.vocabulary(text)
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(table._runs) + len(table._pieces) + len(table._pairs)])], ["n"])

    assert {r.n for r in spark.range(64).repartition(32).mapInArrow(left, "n long").collect()} == {0}
