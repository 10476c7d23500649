import random

import numpy as np

from lotscope.llm import queries, toxicity
from lotscope.plans.lineage import new_folder
from tests.llm.helpers import docs, table

BAD = "grumpf zwack blork".split()


def corpus(n, seed=0):
    rng, rows, labels = random.Random(seed), [], []
    names = [f"word{i}" for i in range(4000)]
    for d in range(n):
        w = rng.choices(names, k=rng.randint(3, 200))
        toxic, low = rng.random() < 0.15, rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", "en", "er", "ig"]))
        rows.append((d, " ".join(x + "###" * low for x in w)))
        labels.append((d, 0 if low else 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1500)
    truth = {d: t for d, _, t in labels}
    known = spark.createDataFrame(labels[:1000], "doc_id long, quality int, toxic int")
    links = toxicity.fit_chain(docs(spark, *rows), known, queries.TOXIC_CHAIN, new_folder(spark, "t"))
    assert [l.name for l in links] == ["low_quality", "toxic"] and len(links[1].dense) == len(links[0].dense) + 1
    got = {r.doc_id: r for r in toxicity.score(docs(spark, *rows), links).collect()}
    held = range(1000, 1500)
    assert sum(got[d].toxic == bool(truth[d]) for d in held) >= 0.99 * len(held)
    assert sum((got[d].p_low_quality > 0.5) == (labels[d][1] == 0) for d in held) >= 0.99 * len(held)
    assert not any(got[d].toxic for d in held if not truth[d])


def test_query_agrees_with_labels(spark):
    got = {r.doc_id: r.toxic for r in queries.op5_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = table(spark, "labels", "/root/testdata/sf0.01").collect()
    assert len(got) == table(spark, "documents", "/root/testdata/sf0.01").count()
    assert not any(got[r.doc_id] for r in labels if not r.toxic)
    assert sum(got[r.doc_id] for r in labels if r.toxic) >= 0.6 * sum(r.toxic for r in labels)


def test_without_labels_and_odd_rows(spark):
    rows = docs(spark, (1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), toxic="x", p_toxic=1)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (9, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        links = toxicity.fit_chain(rows, labels, queries.TOXIC_CHAIN, new_folder(spark, "t"))
        got = toxicity.score(rows, links).collect()
        assert len(got) == 5 and not any(r.toxic for r in got)
    assert toxicity.score(rows.limit(0), links).count() == 0


def test_training_is_logistic_regression():
    rng = np.random.default_rng(1)
    dense = rng.normal(size=(400, 2))
    truth = (dense @ [2.0, -1.0] + 0.5 > 0).astype(float)
    w, v, b = toxicity._train(np.zeros(0, int), np.zeros(0, int), 0, dense, truth)
    assert ((dense @ v + b > 0) == truth).mean() > 0.98


def test_sample_is_bounded_and_takes_near_copies_once(spark):
    rows = [(d, f"same words in every copy of this text {'x' * (d % 2)}") for d in range(100)] + [(200 + d, f"text {d} alone {d} here {d} ok") for d in range(400)]
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in rows], "doc_id long, quality int, toxic int")
    sample = toxicity.sample_rows(docs(spark, *rows), labels, queries.TOXIC_CHAIN, max_rows=10_000)
    assert sample.count() == 402 or sample.count() == 401
    assert toxicity.sample_rows(docs(spark, *rows), labels, queries.TOXIC_CHAIN, max_rows=50).count() < 100
