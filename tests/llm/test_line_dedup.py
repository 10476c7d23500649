import random

import numpy as np
import pyarrow as pa

from lotscope.llm import line_dedup as L
from lotscope.llm import queries
from tests.llm.helpers import docs, prose, table, words


def brute(rows):
    """Texts without lines that any earlier line is like, rows in order."""
    seen, out = [], {}
    for d, t in rows:
        lines, left = (t or "").split("\n"), []
        for line in lines:
            s = frozenset(words(line))
            if s and any(len(s & e) >= 0.8 * len(s | e) - 1e-9 for e in seen):
                seen.append(s)
                continue
            if s:
                seen.append(s)
            left.append(line)
        out[d] = "\n".join(left)
    return out


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").orderBy("doc_id").collect()]
    got = queries.op10_line_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.text for r in got} == brute(rows) and len(got) == len(rows)


def variants(n, size, seed, edits):
    rng, base = random.Random(seed), prose(size, seed).split()
    for k in range(n):
        w = list(base)
        for j in rng.sample(range(size), rng.randint(0, edits)):
            w[j] = f"v{seed}e{k}x{j}"
        yield " ".join(w)


def random_rows(seed=0):
    rng = random.Random(seed)
    lines = [*variants(40, 30, 1, 3), *variants(30, 9, 2, 1), *variants(10, 250, 3, 30), *variants(6, 5, 4, 1)]
    common = [f"c{i}" for i in range(25)]
    lines += [" ".join(rng.sample(common, rng.randint(1, 12))) for _ in range(250)]  # frequent words only
    rng.shuffle(lines)
    lines += ["", "  ", "...", "One two", "two ONE", "one"]
    return [(d, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 6)))) for d in range(150)]


def test_random_lines(spark):
    rows = random_rows()
    got = {r.doc_id: r for r in L.dedup_lines(docs(spark, *rows, n_lines="x", kept=1, text_hash=2)).collect()}
    want = brute(rows)
    assert {d: r.text for d, r in got.items()} == want
    for d, text in rows:
        lines = text.split("\n")
        had, left = (sum(bool(words(x)) for x in t.split("\n")) for t in (text, want[d]))
        assert (got[d].n_lines, got[d].n_removed, got[d].lost_all) == (len(lines), had - left, had > 0 and not left)


def test_short_reach_loses_nothing(spark):
    rows = random_rows(1)
    narrow = docs(spark, *rows).selectExpr("doc_id", "text", "xxhash64(text) as text_hash")
    from pyspark.sql import functions as F

    fields = ("doc_id", "line", "place", "text_hash", "size", "parity", "prefix")
    sets = L.line_sets(narrow, L.rarity(narrow), 0.8).groupBy("k1", "k2").agg(F.min(F.struct(*fields)).alias("r")).select("r.*").persist()
    far, near = ({r.later for r in L.near_matches(narrow, sets, 0.8, *how).collect()} for how in ((10 ** 6, 10 ** 6), (2, 1)))
    assert far == near and far


def test_cut_lists_lose_nothing(spark):
    rows = random_rows(2)
    rows += [(None, "\n".join(variants(20, 30, 1, 2))), (7, rows[7][1] + "\n" + "\n".join(variants(20, 30, 1, 2)))]
    narrow = docs(spark, *rows).selectExpr("doc_id", "text", "xxhash64(text) as text_hash")
    from pyspark.sql import functions as F

    fields = ("doc_id", "line", "place", "text_hash", "size", "parity", "prefix")
    for similarity in (0.8, 0.6):
        sets = L.line_sets(narrow, L.rarity(narrow), similarity).groupBy("k1", "k2").agg(F.min(F.struct(*fields)).alias("r")).select("r.*").persist()
        whole, cut, fine = ({r.later for r in L.near_matches(narrow, sets, similarity, *how).collect()}
                            for how in ((10 ** 6, 10 ** 6), (2, 1, 4, 1 << 10), (1, 1, 1, 2, 1)))
        assert whole == cut == fine and whole


def test_lists_across_batches():
    rng = np.random.default_rng(0)
    n = 400
    x = {"token": np.sort(rng.integers(0, 12, n)), "place": np.arange(n), "size": np.full(n, 10), "at": np.zeros(n, np.int64),
         "parity": rng.integers(0, 3, n)}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in x.items()})

    def run(step, reach, enough):
        found, left = set(), set()
        for b in L._compare_lists(0.8, reach, enough)(iter(batch.slice(i, step) for i in range(0, n, step))):
            for e, l in zip(*(b.column(i).to_pylist() for i in (0, 1))):
                found.add((e, l)) if e is not None else left.add(l)
        return found, left

    whole = run(n, n, n)
    assert whole[0] == {(j, i) for i in range(n) for j in range(i) if x["token"][i] == x["token"][j]
                        and int(x["parity"][i] ^ x["parity"][j]).bit_count() <= 2} and not whole[1]
    for step, reach in ((7, 3), (1, 5), (50, 2)):
        found, left = run(step, reach, n)
        assert found <= whole[0] and {l for _, l in whole[0] - found} <= left
        first = {t: int(np.argmax(x["token"] == t)) for t in set(x["token"].tolist())}
        assert found == {(j, i) for j, i in whole[0] if j - first[int(x["token"][i])] < reach}


def test_odd_rows(spark):
    long = "\n".join(prose(20, k) for k in range(300))
    rows = [(1, None), (2, ""), (3, "a b c d e\nA b, c d e"), (None, "a b c d e\nx"), (4, long), (5, long), (6, "q r s"), (6, "q r s"), (6, "q r t")]
    got = sorted(((r.doc_id or 0), r.text, r.n_removed, r.lost_all) for r in L.dedup_lines(docs(spark, *rows)).collect() if r.doc_id != 4 and r.text is not None)
    # a row without an id comes first; repeated rows are one document
    assert got == [(0, "a b c d e\nx", 0, False), (2, "", 0, False), (3, "", 2, True), (5, "", 300, True),
                   (6, "q r s", 0, False), (6, "q r s", 0, False), (6, "q r t", 0, False)]
    assert L.dedup_lines(docs(spark, *rows).limit(0)).count() == 0


def test_line_numbers():
    from lotscope.llm.words import hash_words

    texts = ["a\n\nb", "", "\n", "c\nd\n", None, "e"]
    w = hash_words(pa.array(texts))
    line, row, number = L._line_of_words(w)
    assert list(zip(row.tolist(), number.tolist())) == [(0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2), (4, 0), (5, 0)]
    assert [(row[i], number[i]) for i in line] == [(0, 0), (0, 2), (3, 0), (3, 1), (5, 0)]


def test_short_lines_at_lower_similarities(spark):
    rows = docs(spark, (1, "a b c d\nx y"), (2, "a b c\nx"), (3, "x y z\np q"))
    kept = lambda s: {r.doc_id: r.text for r in L.dedup_lines(rows, similarity=s).collect()}
    assert kept(0.7) == {1: "a b c d\nx y", 2: "x", 3: "x y z\np q"}
    assert kept(0.5) == {1: "a b c d\nx y", 2: "", 3: "p q"}
    assert kept(0.8) == {r.doc_id: r.text for r in rows.collect()}


def test_runs_of_common_words_lose_nothing(spark):
    rows = random_rows(3) + [(None, "\n".join(variants(20, 30, 1, 2)))]
    narrow = docs(spark, *rows).selectExpr("doc_id", "text", "xxhash64(text) as text_hash")
    from pyspark.sql import functions as F

    fields = ("doc_id", "line", "place", "text_hash", "size", "parity", "prefix")
    levels = L.rarity(narrow)
    for similarity in (0.8, 0.5):
        found, longest = [], []
        for short in (99, 1, -9):  # single words, runs of some, runs of four
            sets = L.line_sets(narrow, levels, similarity, short).groupBy("k1", "k2").agg(F.min(F.struct(*fields)).alias("r")).select("r.*").persist()
            found.append({r.later for r in L.near_matches(narrow, sets, similarity, 10 ** 6, 10 ** 6).collect()})
            keys = np.unique([k & (1 << 48) - 1 for r in sets.collect() for k in r.prefix], return_counts=True)[1]
            longest.append(int(keys.max()))
        assert found[0] == found[1] == found[2] and found[0]
        assert similarity < 0.8 or longest[2] < longest[0]


def test_unlike_sets_of_many_words_are_told_apart_by_sketch(spark):
    rng = random.Random(5)
    some = [f"w{i}" for i in range(600)]
    near = [f"w{i}" for i in range(200)]
    lines = [" ".join(rng.sample(some, 150)) for _ in range(60)] + [" ".join(near), " ".join([*near[:190], *some[590:]])]
    narrow = docs(spark, (1, "\n".join(lines))).selectExpr("doc_id", "text", "xxhash64(text) as text_hash")
    batch = L.line_sets(narrow, L.rarity(narrow), 0.8).orderBy("line").toArrow().combine_chunks().to_batches()[0]
    first = np.arange(batch.num_rows)
    x = L._columns(L._posting_batch(batch, first, first.astype(np.uint64), np.zeros(len(first), np.int32)))
    i, j = np.triu_indices(batch.num_rows, 1)
    pairs = {(int(a), int(b)) for a, b in zip(i, j) if L._may_match(x, np.array([a]), np.array([b]), 0.8)[0]}
    assert pairs == {(60, 61)}


def test_rarity_keeps_small_counts_exact(spark):
    from lotscope.llm.words import hash_words

    times = [1, 2, 3, 16, 5000]
    narrow = docs(spark, *((d, " ".join(f"word{n}" for n in times if d < n)) for d in range(max(times)))).repartition(3)
    at = (hash_words(pa.array([" ".join(f"word{n}" for n in times)])).hashes & np.uint64(L.COUNTERS - 1)).astype(np.int64)
    levels = L.rarity(narrow)
    assert levels[at].tolist() == [1, 2, 2, 5, 13] and np.count_nonzero(levels) == len(times)


def test_postings_are_packed_in_pieces(spark):
    sets = (spark.range(40_000, numPartitions=1).selectExpr("id as doc_id", "0 as line", "id as place", "20 as size", "array(id) as parity",
                                                            "transform(sequence(1, 15), i -> cast(id * 15 + i as bigint)) as prefix"))
    packed = L._postings(sets, np.full(1 << 13, 2, np.uint8), np.zeros(1 << 13, np.uint8), L.LONG, L.PART, 1)
    sizes = [r.n for r in packed.selectExpr("length(postings) as n").collect()]
    assert sum(sizes) == 600_000 * L._RECORD.itemsize and max(sizes) <= 200_000 * L._RECORD.itemsize
