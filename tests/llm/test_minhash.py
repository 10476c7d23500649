import collections
import random

import numpy as np

from lotscope.llm import minhash, queries
from lotscope.llm.components import components
from tests.llm.helpers import docs, prose, table, words


def brute(rows):
    """Class of every id by all pairs."""
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = collections.defaultdict(list)
    for d in sorted(sets):
        for e, k in collections.Counter(e for s in sets[d] for e in lists[s]).items():
            if k >= 0.8 * (len(sets[d]) + len(sets[e]) - k) - 1e-9:
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            lists[s].append(d)
    return {d: find(d) for d in sets}


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    got = queries.op4_minhash(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows) and len(got) == len(rows)
    assert {r.class_id for r in got} == {r.doc_id for r in got if r.first}


def test_groups_chains_and_odd_rows(spark):
    rng, rows = random.Random(2), []
    base = prose(60, 1).split()
    for n in range(60):  # a hot group of near copies
        w = list(base)
        for j in rng.sample(range(60), rng.randint(0, 2)):
            w[j] = f"e{n}x{j}"
        rows.append((n, " ".join(w)))
    chain = prose(100, 2).split()
    for n in range(12):  # each like the next one, the ends unlike each other
        chain[n * 8] = f"c{n}"
        rows.append((100 + n, " ".join(chain)))
    shared = prose(50, 3)
    rows += [(200 + n, shared + " " + prose(30, 50 + n)) for n in range(20)]  # a common passage is no copy
    rows += [(300, "one two"), (301, "One, two!"), (302, "two one"), (303, "..."), (304, ""), (305, None)]
    want = brute([r for r in rows if r[1]])
    got = minhash.near_duplicates(docs(spark, *rows, (None, rows[0][1]), rows[0], node="x", class_id=1)).collect()
    assert len(got) == len(rows) + 2
    mine = {r.doc_id: r.class_id for r in got}
    assert mine.pop(None) is None and mine == want | {304: 304, 305: 305}
    assert sum(r.first for r in got if r.class_id == 0) == 2  # a row that is repeated whole
    assert minhash.near_duplicates(docs(spark, *rows).limit(0)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    names = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    x, y = rng.uniform(0.1, 4, 60), rng.uniform(0.1, 4, 60)
    x[:10] = 0
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    sig = minhash.signatures(np.concatenate([names, names]), np.repeat([0, 1], 60), 3, 4000, np.concatenate([x, y]))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03 and not sig[2].any()
    plain = minhash.signatures(np.concatenate([names[:50], names[10:]]), np.repeat([0, 1], 50), 2, 4000)
    assert abs((plain[0] == plain[1]).mean() - 40 / 60) < 0.03


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}
    assert len(got) == 44 and components(spark.createDataFrame([], "a long, b long")).count() == 0
