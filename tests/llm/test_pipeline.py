import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as P
from tests.llm import test_decontaminate, test_line_dedup, test_minhash
from tests.llm.helpers import docs, table, words

SF = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_match_brute_force(spark):
    """Each stage against a plain counterpart on its own input."""
    frame = table(spark, "documents", SF)
    columns = frame.columns
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    before = rows(frame)
    stages = dict(P.STAGES)
    kept = P.drop_toxic(spark, frame, SF).persist()
    gone = before.keys() - rows(kept).keys()
    labels = {r.doc_id: r.toxic for r in table(spark, "labels", SF).collect()}
    assert kept.columns == columns and gone and all(labels.get(d, 1) for d in gone)

    before = rows(kept)
    out = stages["line_dedup"](spark, kept, SF).persist()
    want = test_line_dedup.brute([(d, before[d].text) for d in sorted(before)])
    got = rows(out)
    assert out.columns == columns
    assert {d: r.text for d, r in got.items()} == {d: t for d, t in want.items() if any(words(x) for x in t.split("\n")) or not words(before[d].text)}
    assert all(r.n_chars == len(r.text) for r in got.values())

    one = stages["minhash"](spark, out, SF).persist()
    classes = test_minhash.brute([(d, r.text) for d, r in got.items()])
    assert one.columns == columns and set(rows(one)) == {d for d, c in classes.items() if d == c}

    left = rows(one)
    clean = stages["decontamination"](spark, one, SF).persist()
    hits = test_decontaminate.brute([(d, words(r.text)) for d, r in left.items()],
                                    [(r.item_id, words(r.text)) for r in table(spark, "benchmark", SF).collect()])
    assert clean.columns == columns and set(rows(clean)) == left.keys() - {d for d, _ in hits}

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = rows(stages["bpe"](spark, clean, SF))
    for d, r in rows(clean).items():
        ids = own.encode(r.text, add_special_tokens=False).ids
        assert last[d].n_tokens == len(ids) and last[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert last.keys() == rows(clean).keys()
    assert {tuple(r) for r in entry.queries()["pipeline"](spark, SF).collect()} == {tuple(r) for r in last.values()}


def test_stages_on_odd_tables(spark):
    frame = table(spark, "documents").limit(0)
    rows = spark.createDataFrame([(1, None, "en", None, None), (2, "", None, "s", 0), (None, "a b", "en", "s", 3), (3, "a b", "en", "s", 3)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        assert stage(spark, frame, "/root/testdata/sf0.001").count() == 0
        assert {r.doc_id for r in stage(spark, rows, "/root/testdata/sf0.001").collect()} >= {1, 2}, name


@pytest.mark.parametrize("name", dict(P.STAGES))
def test_tasks_get_texts_in_small_batches(spark, name):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(20, numPartitions=1).selectExpr("id as doc_id", "repeat('some words ', 100000) as text")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    try:
        for own in (None, "2097152"):
            spark.conf.set(key, own) if own else spark.conf.unset(key)
            dict(P.STAGES)[name](spark, table(spark, "documents").limit(0), "/root/testdata/sf0.001")
            taken = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
            assert sum(taken) > 20e6 and max(taken) < (4 if own else 6) * 1e6
    finally:
        spark.conf.unset(key)


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
