import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lotscope.llm import words as W
from tests.llm.helpers import words

TEXT = st.text(alphabet="ab C.\n-_é日1 ", max_size=60)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_equal_words_have_equal_hashes(texts):
    got = W.hash_words(pa.array(texts, pa.string()))
    want = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert got.rows.tolist() == [i for i, _ in want]
    seen = {}
    for (_, w), h in zip(want, got.hashes.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_blocks_do_not_cut_words(monkeypatch):
    text = " ".join(f"word{i}" for i in range(3000)) + " " + "x" * 5000
    whole = W.hash_words(pa.array([text, text])).hashes
    monkeypatch.setattr(W, "BLOCK_BYTES", 100)
    assert (W.hash_words(pa.array([text, text])).hashes == whole).all()


def test_shingles_of_short_and_long_rows():
    got, rows = W.shingle_hashes(W.hash_words(pa.array(["a b c d e f", "a b", "", None, "a b", "b a"])), 5)
    by = {i: sorted(got[rows == i].tolist()) for i in range(6)}
    assert [len(by[i]) for i in range(6)] == [2, 1, 0, 0, 1, 1] and by[1] == by[4] != by[5]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (0, 5, 100, 1, 1)] + [None]})
    parts = list(W.slices(iter([batch, batch.slice(0, 0)]), "t", 6, 2))
    assert sum(p.num_rows for p in parts) == 6 and max(p.num_rows for p in parts) <= 2


def test_distinct():
    x = np.array([3, 1, 3, 2], np.uint64)
    assert W.distinct(x).tolist() == [1, 2, 3] and W.distinct(x[:0]).tolist() == []
