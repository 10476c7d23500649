"""Shared plans against brute force, with limits low enough that the large-group paths run."""
import math
import random
import statistics
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from lotscope.operators import grading, marks as mk, ranking, vectors
from lotscope.plans import order_stats as st
from lotscope.plans import prefix, spatial


def cloud(seed, jobs=3, n=40, grid=0, hot=0):
    rnd = random.Random(seed)
    rows = []
    for job in range(jobs):
        for i in range(n + (hot if job == 0 else 0)):
            x, y = rnd.uniform(0, 300), rnd.uniform(0, 200)
            if grid:
                x, y = round(x / grid) * grid, round(y / grid) * grid
            rows.append((job, i, float(x), float(y), float(rnd.choice([8, 10, 12, 30])), round(rnd.random(), 2), rnd.random()))
    return rows


COLS = "job int, i bigint, x double, y double, r double, fill double, confidence double"


def greedy(a, b, limit):
    pairs = sorted((math.hypot(p[2] - q[2], p[3] - q[3]), p[1], q[1]) for p in a for q in b)
    ui, uj, out = set(), set(), set()
    for d, i, j in pairs:
        if (limit is None or d <= limit) and i not in ui and j not in uj:
            ui.add(i), uj.add(j), out.add((i, j))
    return out


@pytest.mark.parametrize("limit, grid, small", [(60.0, 0, 64), (None, 0, 64), (60.0, 0, 4), (None, 0, 4), (None, 50, 4)])
def test_match_points(spark, limit, grid, small):
    a, b = cloud(1, grid=grid), cloud(2, n=30, grid=grid)
    got = spatial.match_points(spark.createDataFrame(a, COLS), spark.createDataFrame(b, COLS).withColumnRenamed("i", "j"), limit, small).collect()
    for job in range(3):
        want = greedy([r for r in a if r[0] == job], [r for r in b if r[0] == job], limit)
        assert {(r.i, r.j) for r in got if r.job == job} == want


@pytest.mark.parametrize("small, grid", [(64, 0), (4, 0), (4, 40)])
def test_nearest(spark, small, grid):
    a = cloud(3, grid=grid)
    df = spark.createDataFrame(a, COLS)
    got = {(r.job, r.i): r.nn for r in spatial.nearest(df, df, self_join=True, small=small).collect()}
    want = {(p[0], p[1]): min(math.hypot(p[2] - q[2], p[3] - q[3]) for q in a if q[0] == p[0] and q[1] != p[1]) for p in a}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("small, grid", [(200, 0), (4, 0), (4, 25)])
def test_suppress(spark, small, grid):
    a = cloud(4, grid=grid, hot=60)
    want = set()
    for job in range(3):
        kept = []
        for p in sorted((r for r in a if r[0] == job), key=lambda r: (-r[4], r[1])):
            if all((p[2] - k[2]) ** 2 + (p[3] - k[3]) ** 2 >= 30.0 ** 2 for k in kept):
                kept.append(p)
        want |= {(job, k[1]) for k in kept}
    got = spatial.suppress(spark.createDataFrame(a, COLS), "r", 30.0, small)
    assert {(r.job, r.i) for r in got.collect()} == want


@pytest.mark.parametrize("small", [256, 4])
def test_collapse_concentric(spark, small):
    a = cloud(5, n=60, grid=6, jobs=2)
    a += [(0, 900 + k, 60.0, 60.0, 30.0, 0.5 + k / 100, 0.0) for k in range(5)]
    want = set()
    for job in range(2):
        kept = []
        for c in sorted((r for r in a if r[0] == job), key=lambda r: (-r[4], r[2], r[3], r[1])):
            hit = next((n for n, k in enumerate(kept) if math.hypot(c[2] - k[2], c[3] - k[3]) < 0.35 * max(c[4], k[4])), None)
            if hit is None:
                kept.append(c)
            elif c[5] > kept[hit][5]:
                kept[hit] = c
        want |= {(job, k[1]) for k in kept}
    assert {(r.job, r.i) for r in mk.collapse_concentric(spark.createDataFrame(a, COLS), small).collect()} == want


def merged(prim, prop, floor=0.2):
    """A page's primary marks and accepted proposals, one proposal after the other."""
    cohort = list(prim)
    for c in prop:
        d = lambda k: math.hypot(c[2] - k[2], c[3] - k[3])
        if c[5] < floor or any(d(k) < 0.7 * min(c[4], k[4]) for k in cohort) or any(k[4] > 0 and d(k) < 0.85 * k[4] for k in cohort):
            continue
        if len(cohort) >= 2:
            med = statistics.median(k[4] for k in cohort)
            if med > 0 and not 0.7 * med <= c[4] <= 1.3 * med:
                continue
        cohort.append(c)
    return cohort


@pytest.mark.parametrize("n_prim", [15, 1, 0])
def test_merge_and_veto(spark, n_prim):
    prim, prop = cloud(6, n=max(n_prim, 1)), cloud(7, n=40, hot=80)
    prim = [r for r in prim if n_prim or r[0] == 2]
    want, vetoes = set(), {}
    for job in range(3):
        p = [r for r in prim if r[0] == job]
        med = statistics.median(r[4] for r in p) if len(p) >= 2 else None
        for c in (r for r in prop if r[0] == job):
            inside = any(math.hypot(c[2] - k[2], c[3] - k[3]) < 0.85 * k[4] for k in p)
            vetoes[job, c[1]] = "center" if inside else None if med is None or 0.7 * med <= c[4] <= 1.3 * med else "radius"
        want |= {(job, k[1], k[2]) for k in merged(p, [r for r in prop if r[0] == job])}
    a, b = spark.createDataFrame(prim, COLS), spark.createDataFrame(prop, COLS)
    assert {(r.job, r.i): r.veto for r in mk.veto_proposals(b, a).collect()} == vetoes
    got = [(r.job, r.i, r.x) for r in mk.merge_marks(a, b, 0.2).collect()]
    assert set(got) == want and len(got) == len(want)


def test_the_median_moves_while_proposals_come_in(spark):
    page = lambda *rs: spark.createDataFrame([(1, i, 100.0 * i, 0.0, float(r), 1.0, 0.9) for i, r in rs], COLS)
    assert [r.i for r in mk.merge_marks(page((0, 10)), page((1, 10), (2, 40)), 0.2).orderBy("i").collect()] == [0, 1]
    assert [r.i for r in mk.merge_marks(page((0, 10)), page((1, 40), (2, 30), (3, 33)), 0.2).orderBy("i").collect()] == [0, 1, 2, 3]


@settings(deadline=None, max_examples=300)
@given(st_.lists(st_.tuples(st_.sampled_from([-1.0, 0.0, 2.5, 3.0, 7.0, 8.25]) | st_.floats(-50, 50), st_.integers(1, 4)), min_size=1, max_size=40))
def test_running_median(steps):
    from lotscope.plans.folds import RunningMedian

    run, all_ = RunningMedian(), []
    for value, times in steps:
        run.add(value, times)
        all_ += [value] * times
        assert run.median() == statistics.median(all_)


def test_pages_without_a_radius_match_at_any_length(spark):
    a = [(1, 0, 0.0, 0.0, 0.0, 0.1, 0.9), (1, 1, 500.0, 0.0, 0.0, 0.1, 0.9), (2, 0, 0.0, 0.0, 10.0, 0.1, 0.9), (3, 0, 0.0, 0.0, 10.0, 0.1, 0.9)]
    b = [(1, 5, 400.0, 0.0, 0.0, 0.1, 0.9), (2, 5, 400.0, 0.0, 0.0, 0.1, 0.9), (4, 0, 1.0, 1.0, 5.0, 0.1, 0.9)]
    da, db = spark.createDataFrame(a, COLS), spark.createDataFrame(b, COLS)
    for small in (256, 0):
        limit = mk.median_radius(da).where("median_r > 0").select("job", F.col("median_r").alias("limit"))
        got = {(r.job, r.i, r.j) for r in spatial.match_points(da, db.withColumnRenamed("i", "j"), limit, small).collect()}
        assert got == {(1, 1, 5)}
    plan = {tuple(r) for r in mk.reconcile(da, db).select("job", "action", "i", "j").collect()}
    assert plan == {(1, "covered", 1, 5), (2, "swapped", 0, 5), (4, "recovered", None, 0)}
    got = {r.job: (r.n_agree, r.only_marks, r.only_readings) for r in mk.agreement_summary(da, db).collect()}
    assert got == {1: (1, None, 0), 2: (0, 1, 1), 3: (0, None, 0), 4: (0, None, 1)}


def test_reconcile_and_summary(spark):
    a, b = cloud(8, n=8), cloud(9, n=12)
    plan, sums = set(), {}
    for job in range(3):
        p, q = [r for r in a if r[0] == job], [r for r in b if r[0] == job]
        links = greedy(p, q, statistics.median(r[4] for r in p))
        plan |= {(job, "covered", i, j) for i, j in links}
        free_p = [r for r in p if r[1] not in {i for i, _ in links}]
        free_q = [r for r in q if r[1] not in {j for _, j in links}]
        far = sorted(((min(math.hypot(r[2] - k[2], r[3] - k[3]) for k in p), r[1], r[6]) for r in free_q), reverse=True)
        need = max(0, len(q) - len(p))
        plan |= {(job, "recovered", None, j) for _, j, _ in far[:need]}
        spare = [j for _, j, conf in far[need:] if conf >= 0.7]
        for n, k in enumerate(sorted((r for r in free_p if r[5] < 0.5), key=lambda r: (r[5], r[1]))):
            plan.add((job, "swapped", k[1], spare[n]) if n < len(spare) else (job, "dropped", k[1], None))
        sums[job] = (len(links), len(p) - len(links), len(q) - len(links))
    da, db = spark.createDataFrame(a, COLS), spark.createDataFrame(b, COLS)
    assert {tuple(r) for r in mk.reconcile(da, db).select("job", "action", "i", "j").collect()} == plan
    assert {r.job: (r.n_agree, r.only_marks, r.only_readings) for r in mk.agreement_summary(da, db).collect()} == sums


def test_associate_and_labels(spark):
    a, b = cloud(10, n=9), cloud(11, n=7, jobs=2)
    da, db = spark.createDataFrame(a, COLS), spark.createDataFrame(b, COLS)
    links = mk.associate(da, db).cache()
    for r in links.collect():
        assert r.anchored == (r.d <= 0.75 * r.r)
    rows = mk.build_labels(da.withColumn("source", F.lit("hough")), links, db, part_size=4).collect()
    circles = {}
    for r in rows:
        assert len(r.circles) <= 4
        circles.setdefault(r.job, []).extend(r.circles)
    assert sorted(c.i for c in circles[0]) == list(range(9)) and sum(c.reader_backed for c in circles[0]) == 7
    assert all(c.reader_backed is None for c in circles[2])


def test_labels_of_a_page_whose_readings_cover_nothing(spark):
    a, b = cloud(10, n=4, jobs=1), cloud(11, n=4, jobs=1)
    da, db = spark.createDataFrame(a, COLS), spark.createDataFrame(b, COLS)
    links = mk.associate(da, db).limit(0)
    flags = [c.reader_backed for r in mk.build_labels(da.withColumn("source", F.lit("hough")), links, db).collect() for c in r.circles]
    assert flags == [False] * 4


def test_order_stats(spark):
    rnd = random.Random(1)
    vals = [(g, rnd.choice([0.0, -3.5, 7.0, rnd.uniform(-1e3, 1e6)])) for g in "aab" for _ in range(150)] + [("c", 5.0)] * 40 + [("d", 1.0)]
    df = spark.createDataFrame(vals, "g string, v double")
    ranks = {**st.median_ranks("m"), **st.exclusive_quartile_ranks("q1", 1), **st.exclusive_quartile_ranks("q3", 3)}
    for r in st.order_stats(df, ["g"], F.col("v"), ranks).select("g", "n", st.median_of("m").alias("m"), st.exclusive_quartile("q1", 1).alias("q1"),
                                                                st.exclusive_quartile("q3", 3).alias("q3")).collect():
        v = [x for g, x in vals if g == r.g]
        assert r.n == len(v) and r.m == pytest.approx(statistics.median(v))
        if len(v) >= 4:
            q = statistics.quantiles(v, n=4)
            assert (r.q1, r.q3) == pytest.approx((q[0], q[2]))


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_running_and_numbering(spark, keys):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), i, rnd.randint(0, 9)) for i in rnd.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    out = prefix.running(prefix.number_rows(df, keys, [F.asc("i")], F.floor(F.col("i") / 7), "rn"), keys, [F.asc("i")], F.floor(F.col("i") / 7),
                         {"total": (F.col("v"), "sum"), "top": (F.col("v"), "max")})
    state = {}
    got = {r.i: (r.rn, r.total, r.top) for r in out.collect()}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        k = g if keys else 0
        n, t, m = state.get(k, (0, 0, -1))
        state[k] = (n + 1, t + v, max(m, v))
        assert got[i] == state[k]


def test_tripwire_and_streaks_across_blocks(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.random() < 0.5) for i in sorted(rnd.sample(range(3000), 300))]
    out = prefix.rolling(spark.createDataFrame(rows, "seq int, bad boolean"), [F.asc("seq")], F.floor(F.col("seq") / 11), 20,
                         {"s": F.sum(F.col("bad").cast("int"))}, chunk=32)
    got = {r.seq: (r.rn, r.s) for r in out.collect()}
    for n, (seq, _) in enumerate(rows):
        assert got[seq] == (n + 1, sum(b for _, b in rows[max(0, n - 19):n + 1]))
    streak, want = 0, {}
    for seq, bad in rows:
        streak = streak + 1 if bad else 0
        want[seq] = streak
    df = spark.createDataFrame(rows, "seq int, failed boolean")
    assert {r.seq: r.streak for r in grading.streaks(df, "seq", block_width=13).collect()} == want


def test_blocked_similarity(spark):
    rnd = np.random.default_rng(4)
    bank, asked = rnd.normal(size=(60, 8)), rnd.normal(size=(25, 8))
    b = spark.createDataFrame([(i, int(i % 4), [float(x) for x in v]) for i, v in enumerate(bank)], "ref_id bigint, year int, embedding array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "q bigint, embedding array<double>")
    got = {(r.q, r.year): (r.sim, r.ref_id) for r in vectors.best_sims(q, b, ["year"], block=10).collect()}
    sims = np.round(asked @ bank.T, vectors.DIGITS)
    for i in range(25):
        for y in range(4):
            best = max(range(y, 60, 4), key=lambda k: (sims[i, k], -k))
            assert got[i, y] == (pytest.approx(sims[i, best]), best)


def test_masked_segment_maxima(spark):
    """Years and wanted groups per query, ties, blocks of both sides, own vectors and missing vectors."""
    rnd = np.random.default_rng(9)
    bank = [(i, int(1990 + i % 6), f"k{i % 4}", f"p{i}", [float(x) for x in rnd.integers(-3, 4, 5)]) for i in range(80)]
    asked = [(i, bank[i][4] if i % 3 else [float(x) for x in rnd.integers(-3, 4, 5)],
              None if i % 4 == 0 else [] if i % 4 == 1 else [1990 + i % 6, 1992, 2050]) for i in range(30)] + [(99, None, None)]
    b = spark.createDataFrame(bank + [(500, 1991, "k0", "x", None)], "ref_id bigint, year int, key string, phrase string, embedding array<float>")
    q = spark.createDataFrame(asked, "q bigint, embedding array<float>, years array<int>")

    def brute(groups, allowed):
        out = {}
        for i, v, years in asked:
            for r in bank:
                g = tuple(r[{"year": 1, "key": 2}[c]] for c in groups)
                if v is not None and r[0] != i and allowed(i, years, g):
                    out[(i, *g)] = max(out.get((i, *g), (-1e9, 0, "")), (sum(x * y for x, y in zip(v, r[4])), -r[0], r[3]))
        return {k: (s, -r, p) for k, (s, r, p) in out.items()}

    in_years = lambda i, years, g: years is None or g[0] in years
    for block in (7, 4096):
        got = vectors.best_sims(q, b, ["year"], exclude_same=True, block=block, payload=("phrase",)).collect()
        assert {(r.q, r.year): (r.sim, r.ref_id, r.phrase) for r in got} == brute(["year"], in_years) and len(got) == len(brute(["year"], in_years))
        wanted = spark.createDataFrame([(i, 1990 + k % 8, f"k{k % 3}") for i in range(0, 30, 2) for k in range(i, i + 5)], "q bigint, year int, key string")
        names = {(r.q, r.year, r.key) for r in wanted.collect()}
        got = vectors.best_sims(vectors.asking(q, wanted, ["year", "key"]), b, ["year", "key"], exclude_same=True, block=block).collect()
        want = brute(["year", "key"], lambda i, years, g: (i, *g) in names)
        assert {(r.q, r.year, r.key): (r.sim, r.ref_id) for r in got} == {k: v[:2] for k, v in want.items()}
        everything = vectors.best_sims(q.drop("years"), b, [], exclude_same=True, block=block).collect()
        assert {(r.q,): (r.sim, r.ref_id) for r in everything} == {k: v[:2] for k, v in brute([], lambda *_: True).items()}
    assert vectors.best_sims(q.limit(0), b, ["year"]).count() == 0 and vectors.best_sims(q, b.limit(0), ["year"]).count() == 0


def test_picks_under_a_restriction(spark):
    """Text alone adds a year; a query without an image year has no candidates; at most eight years."""
    image = spark.createDataFrame([(1, 1990 + i, 0.9 - i / 100) for i in range(7)], "q bigint, year int, sim double")
    text = spark.createDataFrame([(1, 1996 + i, 0.3 - i / 100, "p", "t") for i in range(6)] + [(2, 1990, 0.5, "p", "t")],
                                 "q bigint, year int, sim double, phrase string, type string")
    got = {(r.q, r.pick): (r.year, round(r.image_score, 2)) for r in ranking.pick_years(image, text).collect()}
    assert got == {(1, 1 + i): (1990 + i, round(0.9 - i / 100, 2)) for i in range(5)} | {(1, 6): (1996, 0.84), (1, 7): (1997, 0.0), (1, 8): (1998, 0.0)}


def test_worker_watch_matches_a_plain_loop(spark):
    import __spark_entry__ as entry
    folder = "/root/testdata/sf0.001"
    got = {r.worker: (r.n, r.streak, r.max_streak) for r in entry.queries()["x10_tripwire_stream"](spark, folder).collect()}
    want = {}
    for r in sorted(spark.read.parquet(f"{folder}/events.parquet").select("event_id", "user_id", "event_type").collect()):
        w = zlib.crc32(f"k{r.user_id}".encode()) % 4
        n, s, m = want.get(w, (0, 0, 0))
        s = s + 1 if r.event_type in ("error", "signup", "click") else 0
        want[w] = (n + 1, s, max(m, s))
    assert got == want


def test_ordered_code_follows_the_order(spark):
    rnd = random.Random(5)
    vals = [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf")]
    vals += [math.ldexp(1.0, e) for e in range(-1070, 1024, 13)] + [math.nextafter(math.ldexp(1.0, e), s) for e in range(-1020, 1023, 7) for s in (0, math.inf)]
    vals += [rnd.uniform(0, 1) * 10 ** rnd.randint(-300, 300) for _ in range(2000)] + [0.7 + i * 1e-16 for i in range(200)]
    vals = sorted({s * v for v in vals for s in (1, -1)})
    rows = spark.createDataFrame([(v,) for v in vals + [float("nan")]], "v double").select("v", st.ordered_code(F.col("v")).alias("c")).collect()
    codes = [r.c for r in sorted(rows, key=lambda r: (math.isnan(r.v), r.v))]
    assert codes == sorted(codes) and len(set(codes)) > 0.9 * len(codes)


def test_order_stats_of_values_that_differ_late(spark):
    """A million values that agree in three digits; no bucket that is ranked holds more than a sliver of them."""
    df = spark.range(1_000_000).select((0.7001 + (F.col("id") * 7919 % 1_000_003) * 8e-10).alias("v"))
    r = st.order_stats(df, [], F.col("v"), {"a": F.lit(1), "m": F.col("n") / 2, "z": F.col("n")}).first()
    want = np.sort(0.7001 + (np.arange(1_000_000) * 7919 % 1_000_003) * 8e-10)
    assert (r.n, r.a, r.m, r.z) == (1_000_000, want[0], want[499_999], want[-1])
    fine = df.groupBy(F.shiftright(st.ordered_code(F.col("v")), 20)).count().agg(F.max("count")).first()[0]
    assert fine < 100


@pytest.mark.parametrize("rare, block", [(64, 1024), (3, 5), (0, 1000), (1000, 7)])
def test_most_shared(spark, rare, block):
    from lotscope.plans.overlap import most_shared
    rnd = random.Random(6)
    words = [f"w{min(int(rnd.expovariate(0.2)), 40)}" for _ in range(300)]
    draw = lambda ids: [(i, 1990 + rnd.choice([0, 0, 0, 1, 2]), sorted(set(rnd.choice(words) for _ in range(rnd.randint(0, 14))))) for i in ids]
    pool, asked = draw(range(90)), draw(range(1000, 1040))
    made = lambda rows: spark.createDataFrame(rows, "idx bigint, year int, toks array<string>")

    def brute(a, b, k):
        for i, y, toks in a:
            found = sorted((-len(set(toks) & set(t)), j) for j, z, t in b if z != y and set(toks) & set(t))
            yield from ((i, j, -s, r + 1) for r, (s, j) in enumerate(found[:k]))
    df = made(pool)
    assert sorted(map(tuple, most_shared(df, df, 3, rare, block).collect())) == sorted(brute(pool, pool, 3))
    assert sorted(map(tuple, most_shared(df, made(asked), 4, rare, block).collect())) == sorted(brute(asked, pool, 4))
    assert most_shared(made([]), made(asked), 4, rare, block).count() == 0
def test_a_bank_passes_every_query_block_once(spark):
    """One shuffle and no partial maxima, however many references there are; a group without a name is one group."""
    rnd = np.random.default_rng(3)
    bank = [(i, None if i % 3 == 0 else i % 3, [float(x) for x in rnd.integers(-3, 4, 4)]) for i in range(3000)]
    b = spark.createDataFrame(bank, "ref_id bigint, year int, embedding array<float>")
    q = b.where("ref_id < 700").select(F.col("ref_id").alias("q"), "embedding")
    out = vectors.best_sims(q, b, ["year"], exclude_same=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    sims = np.array([v for *_, v in bank])[:700] @ np.array([v for *_, v in bank]).T
    np.fill_diagonal(sims, -np.inf)
    for r in (got := out.collect()):
        place = [i for i in range(3000) if bank[i][1] == r.year]
        best = sims[r.q, place]
        assert (r.sim, r.ref_id) == (best.max(), place[int(best.argmax())])
    assert len(got) == 2100


def test_vectors_are_copied_a_few_times(spark, monkeypatch):
    """Copies of a bank and its queries in the shuffle: a few in banks of like groups, one part where a group is large."""
    def copies(b):
        q = spark.range(8000).select(F.col("id").alias("q"), F.array(F.lit(1.0)).alias("embedding"))
        out = vectors.best_sims(q, b, ["year"])
        parts, part = vectors.part_of(b, ["year"])
        loads = sorted(r["count"] for r in b.groupBy(part.alias("p")).count().collect())
        return parts, out.rdd.getNumPartitions(), loads

    ref = lambda n: spark.range(n).select(F.col("id").alias("ref_id"), "id", F.array(F.lit(1.0)).alias("embedding"))
    even, hot = ref(1200).withColumn("year", F.col("id") % 12), ref(1200).withColumn("year", F.greatest(F.col("id") - 900, F.lit(0)) % 7)
    many = ref(3000).withColumn("year", F.when(F.col("id") % 50 != 0, F.col("id") % 900))
    assert copies(even)[:2] == (6, 24) and copies(hot)[:2] == (1, 24)
    parts, tasks, loads = copies(many)
    assert tasks == 24 and parts > 1 and len(loads) == parts and sum(loads) == 3000 and loads[-1] < 2 * loads[0]
    monkeypatch.setattr(vectors, "CELLS", 1)  # one group of a chunk at a time
    q = many.where("ref_id % 10 = 0").select(F.col("ref_id").alias("q"), F.array(F.sin("ref_id")).alias("embedding"))
    refs = many.withColumn("embedding", F.array(F.cos("ref_id")))
    got = {(r.q, r.year): (r.sim, r.ref_id) for r in vectors.best_sims(q, refs, ["year"], exclude_same=True).collect()}
    want = {}
    for i in range(0, 3000, 10):
        for k in range(3000):
            g, s = (i, k % 900 if k % 50 else None), round(math.sin(i) * math.cos(k), vectors.DIGITS)
            if k != i and (g not in want or s > want[g][0]):
                want[g] = s, k
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}


def test_folded_pages_equal_those_on_many_tasks(spark):
    """Bands, layout, holes, links, plans and labels of ordinary pages, folded in one stage, and as larger pages get them."""
    rnd = random.Random(12)
    rows = []
    for job in range(30):
        n = rnd.choice([0, 1, 2, 5, 9, 30])
        grid = [(rnd.randint(0, 1) + 90.0 * (k % 4), 80.0 * (k // 4) + rnd.randint(0, 1)) for k in range(n) if rnd.random() < 0.8 or k % 4 in (0, 3)]
        rows += [(job, i, x, y, 0.0 if job % 7 == 0 else 20.0 + rnd.random(), rnd.random(), rnd.random(), "s") for i, (x, y) in enumerate(grid)]
    a = spark.createDataFrame(rows, "job bigint, i bigint, x double, y double, r double, fill double, confidence double, source string")
    read = [(j, i, x + rnd.randint(-9, 9), y + rnd.randint(-30, 30), r, f, None if i % 5 == 0 else cf) for j, i, x, y, r, f, cf, _ in rows if rnd.random() < 0.7]
    read += [(j, 100 + k, 500.0 * k, 5.0, 9.0, 0.1, 0.9) for j in (1, 2, 40) for k in range(4)]
    b = spark.createDataFrame(read, "job bigint, i bigint, x double, y double, r double, fill double, confidence double")
    r = lambda v: round(v, 9) if isinstance(v, float) else v
    for run in (lambda n: mk.banded(a, "x", small=n), lambda n: mk.layout(a, small=n), lambda n: mk.grid_holes(a, small=n), lambda n: mk.covered(a, b, small=n),
                lambda n: mk.reconcile(a, b, small=n).select("job", "action", "i", "j"), lambda n: mk.label_pages(a, b, 4, small=n)):
        folded, spread = run(256), run(0)
        assert folded.count() and sorted(folded.columns) == sorted(spread.columns)
        got, want = [sorted((tuple(map(r, row)) for row in df.select(*folded.columns).collect()), key=str) for df in (folded, spread)]
        assert got == want


def test_crops_are_read_once_for_tops_and_resolution(spark):
    import __spark_entry__ as entry
    from lotscope.bindings import Tables
    from lotscope.operators import decide
    folder = "/root/testdata/sf0.001"
    plan = entry.queries()["p12_staging_candidates"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" not in plan  # scores were read when the crops were written
    t = Tables(spark, folder)
    rows = decide.read_crops(t.view("v_cand"), t.view("v_reading"))
    for got, want in ((decide.lead(rows), decide.crop_tops(t.view("v_cand"))), (rows.where("agrees").select("job", "crop", "rank"), decide.agreeing(
            decide.ranked_candidates(t.view("v_cand")), t.view("v_reading")).select("job", "crop", "rank"))):
        assert got.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_rerank_multiplies_the_image_bank_twice(spark, monkeypatch):
    """Once for all years, once for the entities that candidates ask for; the third pass is the text bank's."""
    from lotscope.queries import load

    banks, plain = [], vectors.best_sims
    monkeypatch.setattr(vectors, "best_sims", lambda q, bank, *a, **b: banks.append(bank.columns) or plain(q, bank, *a, **b))
    load()[0]["w6_rerank"](spark, "/root/testdata/sf0.001")
    assert ["key" in b for b in banks].count(True) == 2 and len(banks) == 3


@pytest.mark.parametrize("length, block", [(1.0, 4096), (1.0, 16), (1e20, 4096), (1e-3, 4096)])
def test_rivals_closer_than_single_precision(spark, length, block):
    """References that differ in the tenth digit, copies, shifts, and vectors too long for single precision."""
    rnd = np.random.default_rng(21)
    base = rnd.normal(size=(6, 7))
    bank = length * np.concatenate([base[rnd.integers(0, 6, 150)] + 1e-9 * rnd.normal(size=(150, 7)), base, base])
    asked, shift = np.concatenate([base, rnd.normal(size=(20, 7))]) * (1.0 if length > 1 else 1.0 / length), np.where(np.arange(162) % 5 == 0, 1e-10, 0.0)
    b = spark.createDataFrame([(i, i % 3, float(shift[i]), [float(x) for x in v]) for i, v in enumerate(bank)], "ref_id bigint, year int, shift double, embedding array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "q bigint, embedding array<double>")
    sims = np.round(np.array([[np.einsum("i,i->", v, r) for r in bank] for v in asked]) + shift, vectors.DIGITS)
    got = {(r.q, r.year): (r.sim, r.ref_id) for r in vectors.best_sims(q, b, ["year"], block=block).collect()}
    assert len(got) == 26 * 3
    for (i, y), (sim, ref) in got.items():
        best = max(range(y, 162, 3), key=lambda k: (sims[i, k], -k))
        assert sim == pytest.approx(sims[i, best], rel=1e-14, abs=2e-12) and sims[i, ref] == pytest.approx(sims[i, best], rel=1e-14, abs=2e-12)
        if length <= 1:
            assert ref == best


def test_quality_and_spacing_of_folded_pages(spark):
    """One shuffle for ordinary pages; the same values as by brute force and as larger pages get them."""
    rows = [r for seed, n, grid in ((31, 1, 0), (32, 2, 0), (33, 60, 0), (34, 60, 25)) for r in cloud(seed, jobs=1, n=n, grid=grid)]
    rows = [(job, i, *rest) for job, page in enumerate((rows[:1], rows[1:3], rows[3:63], rows[63:])) for i, (_, _, *rest) in enumerate(page)]
    rows += [(7, 0, None, 1.0, 10.0, 0.5, 0.1), (7, 1, 5.0, 1.0, 12.0, None, 0.1), (8, 0, 1.0, 1.0, 10.0, None, 0.1), (9, 0, 1.0, 1.0, 0.0, 0.5, 0.1),
             (9, 1, 9.0, 1.0, None, 0.5, 0.1)]
    df, (w, h) = spark.createDataFrame(rows, COLS), (800.0, 600.0)
    score, radius = mk.mark_set_score(df, w, h), mk.spacing_radius(df, w, h)
    for out in (score, radius):
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want_score, want_radius = {}, {}
    for job in range(10):
        page = [r for r in rows if r[0] == job]
        if not page:
            continue
        at = [(r[2], r[3]) for r in page if r[2] is not None]
        nn = [min(math.hypot(x - u, y - v) for j, (u, v) in enumerate(at) if j != i) for i, (x, y) in enumerate(at)] if len(at) > 1 else []
        tile = math.sqrt(w * h / len(page)) * 0.42
        want_radius[job] = max(tile * 0.6, min(0.5 * statistics.median(nn), tile * 1.8)) if nn else tile
        sizes, fills = [r[4] for r in page if r[4]], [r[5] for r in page if r[5] is not None]
        if not sizes:
            continue
        even = lambda v: max(0.0, 1.0 - statistics.pstdev(v) / statistics.fmean(v)) if v and statistics.fmean(v) > 0 else 0.0
        cover = len(page) * math.pi * statistics.median(sizes) ** 2 / (w * h)
        tent = cover / 0.4 if cover <= 0.4 else max(0.0, 1.0 - (cover - 0.4) / 0.6)
        want_score[job] = (len(page), 0.4 * statistics.fmean(fills) + 0.3 * (even(nn) if len(page) > 1 else 0.5) + 0.2 * even(sizes) + 0.1 * tent if fills else None)
    values = lambda got: {job: pytest.approx(v, abs=1e-9) for job, v in got.items()}
    for small in (256, 4, 1):
        got = {r.job: (r.n, r.score) for r in mk.mark_set_score(df, w, h, small).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want_score.items()}
        assert {k: v[1] for k, v in got.items()} == values({k: v[1] for k, v in want_score.items()})
        assert {r.job: r.radius for r in mk.spacing_radius(df, w, h, small).collect()} == values(want_radius)
