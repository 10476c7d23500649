import itertools
import math
import random

from lotscope.llm import decontaminate as D
from lotscope.llm import queries
from tests.llm.helpers import docs, prose, table, words


def brute(texts, items):
    found = set()
    for k, b in items:
        n = min(D.WINDOW, len(b))
        need = math.ceil(D.SIMILARITY * n - 1e-9)
        if len(b) < D.LEAST_WORDS:
            continue
        at = {}
        for i, w in enumerate(b):
            at.setdefault(w, []).append(i)
        for d, t in texts:
            diagonals = {}
            for p, w in enumerate(t):
                for q in at.get(w, ()):
                    diagonals.setdefault(p - q, set()).add(q)
            if any(sum(q in same for q in range(s, s + n)) >= need for same in diagonals.values() if len(same) >= need
                   for s in range(len(b) - n + 1)):
                found.add((d, k))
    return found


def test_masks_hit_every_window():
    for n in range(D.LEAST_WORDS, D.WINDOW + 1):
        wrong = n - math.ceil(D.SIMILARITY * n - 1e-9)
        for bad in itertools.combinations(range(n), wrong):
            assert any(all(s + p not in bad for p in mask) for mask in D.MASKS for s in range(n - mask[-1]))


def test_query_against_brute_force(spark):
    texts = [(r.doc_id, words(r.text)) for r in table(spark, "documents").collect()]
    items = [(r.item_id, words(r.text)) for r in table(spark, "benchmark").collect()]
    got = queries.op3_decontamination(spark, "/root/testdata/sf0.001").select("doc_id", "item_id").collect()
    assert {tuple(r) for r in got} == brute(texts, items) and len(got) > 0


def test_substitutions_blocks_and_edges(spark):
    rng = random.Random(1)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(n))) for k, n in enumerate((7, 8, 10, 13, 30, 45))] + [(9, None)]
    rows = []
    for n in range(120):
        k, text = rng.choice(items[:-1])
        w = text.split()
        for j in rng.sample(range(len(w)), rng.randint(0, 5) if len(w) > 5 else 0):
            w[j] = f"s{n}x{j}"
        rows.append((n, prose(rng.randint(0, 9), n) + " " + " ".join(w[rng.randint(0, 2):]) + " " + prose(rng.randint(0, 4), n + 500)))
    rows += [(500, None), (501, ""), (None, items[4][1]), (7, items[3][1]), (7, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([(d, words(t)) for d, t in rows], [(k, words(t)) for k, t in items])
    for block in (500_000, 20):
        got = D.overlaps(docs(spark, *rows, overlaps="x"), bench, block_words=block).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, o.item_id) for r in got for o in r.overlaps} == want
    here = [r for r in got if r.doc_id is None][0].overlaps[0]
    assert (here.first_word, here.last_word, here.share) == (0, 29, 1.0)
    assert D.overlaps(docs(spark, *rows), bench.limit(0)).filter("size(overlaps) > 0").count() == 0
    assert D.overlaps(docs(spark, *rows).limit(0), bench).count() == 0


def test_short_items_match_as_wholes(spark):
    items = docs(spark, (1, "alpha beta gamma delta epsilon zeta eta"), (2, "one two three four five"), (3, "one two three four"), (4, "One, two: three four FIVE")).withColumnRenamed("doc_id", "item_id")
    rows = docs(spark, (1, "x alpha beta gamma delta epsilon zeta eta y"), (2, "alpha beta gamma delta epsilon zeta"), (3, "so one two three four five"),
                (4, "one two three four"), (5, "five"), (6, None), (7, "one two three"), (8, "four five"))
    got = {r.doc_id: sorted((o.item_id, o.first_word, o.last_word, o.share) for o in r.overlaps) for r in D.overlaps(rows, items).collect()}
    assert got == {1: [(1, 1, 7, 1.0)], 2: [], 3: [(2, 1, 5, 1.0), (4, 1, 5, 1.0)], 4: [], 5: [], 6: [], 7: [], 8: []}
