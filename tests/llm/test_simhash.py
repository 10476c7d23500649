import random
import re

import numpy as np
import pytest
import xxhash

from lotscope.llm import queries, simhash
from tests.llm.helpers import docs, prose, table


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in re.split("[ \t\n\x0b\x0c\r]+", lower) if w]
    runs = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, radius=3):
    """Least member of the component of each of the distinct points."""
    points = np.unique(points)
    root = np.arange(len(points))
    near = [np.flatnonzero(np.bitwise_count(points ^ p) <= radius) for p in points]
    changed = True
    while changed:
        new = np.array([root[n].min() for n in near], np.int64)
        new = new[new]
        changed = (new != root).any()
        root = new
    return dict(zip(points.tolist(), points[root].tolist()))


def linked(points, a, b):
    """Components that links leave."""
    root = {p: p for p in np.unique(points).tolist()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for x, y in zip(a.tolist(), b.tolist()):
        x, y = sorted((find(x), find(y)))
        root[y] = x
    return {p: find(p) for p in root}


def cloud(n, seed, balls=(), fixed=0):
    """Random points, balls of points around some of them, and points that share the lower half."""
    chance = np.random.default_rng(seed)
    points = [chance.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + chance.integers(0, 2, n, dtype=np.uint64)]
    for size, flips in balls:
        masks = np.bitwise_or.reduce(np.uint64(1) << chance.integers(0, 64, (size, flips), dtype=np.uint64), axis=1)
        points.append(points[0][0] ^ masks)
        points.append(chance.choice(points[0], size) ^ masks)
    points.append((chance.integers(0, 1 << 32, fixed, dtype=np.uint64) << np.uint64(32)) | np.uint64(12345))
    return np.unique(np.concatenate(points))


CLOUDS = [cloud(3000, 1, ((300, 2), (300, 3))), cloud(500, 2, ((2500, 6),)), cloud(100, 3, (), 3000), cloud(2, 4, ((1500, 3),)), cloud(0, 5)]


@pytest.mark.parametrize("points", CLOUDS, ids=range(len(CLOUDS)))
@pytest.mark.parametrize("radius", [3, 2, 4])
def test_trees_find_all_components(points, radius):
    want = brute_components(points, radius)
    found = []
    for half in simhash.HALVES:
        nodes = simhash.fit_tree(points[::3], len(points), half, radius, shard=200)
        for _, some in simhash.route(nodes, points):
            found.append(simhash.shard_links(points[some], half, radius, leaf=50))
    a, b = map(np.concatenate, zip(*found))
    assert (np.bitwise_count(a ^ b) <= radius).all()
    assert linked(points, a, b) == want
    assert len(a) <= 60 * max(1, len(points))  # no group expands into its pairs


def test_a_tree_skips_most_comparisons():
    points = cloud(20000, 6)
    pairs = sum(len(s) ** 2 for half in simhash.HALVES
                for _, s in simhash.route(simhash.fit_tree(points[:4000], len(points), half, shard=100), points))
    assert pairs < 0.15 * len(points) ** 2


def test_fingerprints(spark):
    texts = [None, "", " \n\t", "a", "A b", "one two three", "One  two\x0bthree\x0cfour", "\x1ca b\x85c d é日 😀 İ K ſ", "x y z " * 2000,
             "no-break space joins words here", prose(700, 3)]
    got = {r.doc_id: r.fp & (2 ** 64 - 1) for r in simhash.fingerprints(docs(spark, *enumerate(texts), fp=3, least="x")).collect()}
    assert got == {d: brute_fingerprint(t) for d, t in enumerate(texts)}


def test_components_of_documents(spark):
    chance = random.Random(7)
    base = prose(900, 1).split()
    rows = [(100 + i, " ".join(base)) for i in range(40)]
    for i in range(60):
        words = list(base)
        words[chance.randrange(900)] = f"changed{i}"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, prose(50, 100 + i)) for i in range(60)] + [(9, None), (8, ""), (7, " \n"), (None, "lost words"), (None, None), (100, " ".join(base))]
    got = simhash.near_components(docs(spark, *rows, fp=1, component_id=2))
    assert got.columns == ["doc_id", "fp", "component_id"]
    points = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    root, least = brute_components(points), {}
    for (d, _), p in zip(rows, points.tolist()):
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    want = [(d, p, least.get(root[p])) for (d, _), p in zip(rows, points.tolist())]
    key = lambda r: (r[0] is None, r)
    assert sorted([(r[0], r[1] & (2 ** 64 - 1), r[2]) for r in got.collect()], key=str) == sorted(want, key=str)
    assert simhash.near_components(docs(spark, (1, "a")).limit(0)).count() == 0


def test_query_against_brute_force(spark):
    rows = table(spark, "documents").collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    root, least = brute_components(np.array(list(prints.values()), np.uint64)), {}
    for d in sorted(prints, reverse=True):
        least[root[prints[d]]] = d
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op11_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: (f"{p:016x}", least[root[p]]) for d, p in prints.items()}
