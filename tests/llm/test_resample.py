import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotscope.llm import queries, resample
from tests.compare import check
from tests.llm.helpers import docs, prose

TEXTS = [None, "", "--- !", "Alpha beta", "É日 alpha-beta a1 B2", "x " * 500, "alpha " * 25, prose(30, 1), prose(30, 1), "İK ſ z"]


def brute_features(text, order=1):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return len(ws), [" ".join(ws[i:i + n]) for n in range(1, order + 1) for i in range(len(ws) - n + 1)]


def brute(rows, target, percent, order=1, buckets=10_000, seed=2024, least=20):
    bucket = lambda g: crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in rows for g in brute_features(t, order)[1])
    t = Counter(bucket(g) for x in target for g in brute_features(x, order)[1])
    ss, tt = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (ss + buckets) / ((s[b] + 1.0) * (tt + buckets))))
    out = []
    for d, text in rows:
        n, found = brute_features(text, order)
        w = sum(gain(bucket(g)) for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(found), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for i, r in enumerate(fit[:percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_resample(spark, order):
    rows = [*enumerate(TEXTS), (None, prose(40, 2)), *((100 + i, prose(15 + i % 20, i, "alpha beta "[i % 11:])) for i in range(80))]
    target = docs(spark, *enumerate(["alpha beta gamma", None, "Alpha x x1"]))
    got = resample.resample(docs(spark, *rows, n_words="z", rank=1, times=2, start=3), target, 25, order=order)
    assert result(got) == brute(rows, ["alpha beta gamma", None, "Alpha x x1"], 25, order)


def test_repeated_rows_share_the_cutoff(spark):
    rows = [(7, prose(30, 1))] * 40 + [(8 + i, prose(30, i)) for i in range(20)]
    got = result(resample.resample(docs(spark, *rows), docs(spark, (1, "w1x2 w1x3")), 30))
    assert got == brute(rows, ["w1x2 w1x3"], 30)


def test_empty_tables_and_empty_draws(spark):
    none = docs(spark, (1, "a")).limit(0)
    assert resample.resample(none, docs(spark, (1, "a")), 10).count() == 0
    assert [r.rank for r in resample.resample(docs(spark, (1, "a b"), (2, None)), none, 50).collect()] == [None, None]
    assert sorted(r.rank for r in resample.resample(docs(spark, (1, prose(30)), (2, prose(30))), none, 100).collect()) == [1, 2]


def test_a_bracket_that_misses_is_widened(spark):
    rows = spark.range(20000).select((F.xxhash64("id") % 5000).alias("score")).cache()
    values = sorted((r.score for r in rows.collect()), reverse=True)
    for wanted in (1, 2000, 19999, 20000):
        for margin, accuracy in ((0.002, 10000), (0.00001, 20)):
            b = resample.bracket(rows, wanted, 20000, margin, accuracy)
            assert b.low <= values[wanted - 1] <= b.high and b.above < wanted <= b.upto
            assert b.above == sum(v > b.high for v in values) and b.upto == sum(v >= b.low for v in values)
    assert resample.bracket(rows, 2000, 20000, 0.00001, 20).rounds > 1
    good = resample.bracket(rows, 2000, 20000)
    assert good.rounds == 1 and good.upto - good.above < 400


def test_very_long_text(spark):
    rows = [(1, "word " * 400_000), (2, "w" * 2_000_000), (3, prose(30))]
    assert result(resample.resample(docs(spark, *rows), docs(spark, (1, "word")), 100)) == brute(rows, ["word"], 100)


def test_query_against_sql(spark):
    text, _, ok = check(spark, "/root/testdata/sf0.001", queries.op12_resample, queries.SQL["op12_resample"])
    assert ok, text
