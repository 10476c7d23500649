from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa

from lotscope.llm import quality, queries
from tests.compare import check
from tests.llm.helpers import docs, table

TEXTS = [None, "", "  \n\t ", "a b c a b c", "a b\na b\n\n \nA B", "#* $%&|<> é日😀", "x y x y x y x", "a\x0bb\x0cc\x1cd\x85e f", "one " * 60]


def brute(text):
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in text).split(" ") if w]
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered),
            sum(c.isascii() and c.isalpha() for c in text), sum(c.isascii() and c.isupper() for c in text))


def test_measures(spark):
    rows = docs(spark, *enumerate(TEXTS), n_words="x", failed=7)
    got = {r.doc_id: tuple(r[c] for c in quality.MEASURES) for r in quality.ledger(rows).collect()}
    assert got == {d: brute(t) for d, t in enumerate(TEXTS)}
    assert quality.ledger(rows.limit(0)).count() == 0


@settings(deadline=None, max_examples=100)
@given(st.lists(st.text(alphabet="ab \n\t\x1cé", max_size=40), min_size=1, max_size=4))
def test_repeated_words(texts):
    from lotscope.llm.words import hash_words
    import numpy as np

    words = hash_words(pa.array(texts), quality._NOT_SPACE, lower=False)
    got = quality._repeated(words, np.bincount(words.rows, minlength=len(texts)))
    assert got.tolist() == [brute(t)[5] for t in texts]


def test_query_against_sql(spark):
    text, _, ok = check(spark, "/root/testdata/sf0.001", queries.op8_quality, queries.SQL["op8_quality"])
    assert ok, text


def test_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op8_quality(spark, folder).collect()}
    good = [r.doc_id for r in table(spark, "labels", folder).collect() if r.quality == 1]
    assert all(got[d].kept for d in good if not got[d].base_failed)


def test_policies_and_ablations(spark):
    ledger = docs(spark, (1, "a")).selectExpr("explode(array(0L, 1L, 1L, 3L, 4L, 2L)) as failed")
    rules = {"r0": "x", "r1": "y", "r2": "z"}
    got = {(r.policy, r.rule): (r.n_docs, r.rejected, r.failing, r.only_this)
           for r in quality.ablations(ledger, {"p1": ("r0", "r1"), "p2": ("r2",)}, rules).collect()}
    assert got == {("p1", "r0"): (6, 4, 3, 2), ("p1", "r1"): (6, 4, 2, 1), ("p2", "r2"): (6, 1, 1, 1)}
    assert [r.ok for r in ledger.select(quality.passes(("r0",), rules).alias("ok")).collect()] == [True, False, False, False, True, True]
