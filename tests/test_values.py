"""Value tests on tiny inputs."""
import pytest
from pyspark.sql import functions as F

from lotscope.functions import geometry as geo
from lotscope.functions import numbers as nm
from lotscope.functions import text as tx
from lotscope.operators import decide, filters, history, market, records, rules
from lotscope.plans.lineage import new_folder
from lotscope.sources import listings, logs, readings, sinks


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("title, years", [("1980's pins", list(range(1980, 1990))), ("90s lot", list(range(1990, 2000))),
                                          ("'00s", list(range(2000, 2010))), ("1990 button", []), (None, [])])
def test_decades(spark, title, years):
    assert one(spark, tx.extract_decades, title) == years


@pytest.mark.parametrize("title, n", [("Lot of 54 buttons", 54), ("(12) buttons", 12), ("lot of 12 — 40 buttons", 40),
                                      ("1982 Pitt Pin", None), ("200+ pinbacks", 200), ("set of 0", None), (None, None)])
def test_lot_count(spark, title, n):
    assert one(spark, tx.extract_lot_count, title) == n


def test_years_and_keys(spark):
    assert one(spark, tx.extract_years, "1979, 1986 and $21,982 and 31990") == [1979, 1986]
    assert one(spark, tx.normalize_key, "I-Oh_Was É!") == "ioh_wasé"
    assert one(spark, tx.basic_norm, "I-Oh_Was É!") == "iohwasé"
    assert one(spark, tx.normalize_text, " Sam / 1979 PSU Lot! ") == "sam  1979 psu lot"
    assert one(spark, tx.tokenize, "I-O-Wasn’t Éclair foo_bar 9") == ["i", "o", "wasnt", "9"]


@pytest.mark.parametrize("text, price", [("$1.50", 1.5), ("1,200", 0.0), ("", 0.0), (None, 0.0)])
def test_price(spark, text, price):
    assert one(spark, tx.parse_price, text) == price


def test_reply(spark):
    assert tuple(one(spark, tx.parse_price_source, "$1,025.00 | Fair | 35")) == (1025.0, "Fair", 35)
    assert tuple(one(spark, tx.parse_price_source, "25 Fair")) == (None, "", None)
    assert tuple(one(spark, tx.parse_confirmation, "go 12 citizens")) == (12, "Citizens")
    assert one(spark, tx.amount_needed, "3.0") == 0 and one(spark, tx.amount_needed, "3") == 3


@pytest.mark.parametrize("v, y", [("1984", 1984), ("'97", 1997), ("’19", 2019), ("83", 1983), ("90", None), ("36", None),
                                  ("1984.0", 1984), ("2077", None), ("junk", None), ("-5", None)])
def test_printed_year(spark, v, y):
    assert one(spark, nm.parse_printed_year, v) == y


@pytest.mark.parametrize("overall, gap, plain, guarded", [(0.86, None, True, False), (0.91, None, True, True), (0.83, 0.2, True, True),
                                                         (0.5, 0.13, True, True), (0.86, float("nan"), True, False), (0.5, float("nan"), False, False)])
def test_confirmed(spark, overall, gap, plain, guarded):
    row = spark.createDataFrame([(overall, gap)], "o double, g double").select(
        nm.is_confirmed(F.col("o"), F.col("g")).alias("p"), nm.is_confirmed_guarded(F.col("o"), F.col("g")).alias("q")).first()
    assert (row.p, row.q) == (plain, guarded)


def test_blend_penalty_and_null_clamp(spark):
    row = spark.range(1).select(nm.blend(F.lit(0.8), nm.norm_sim(F.lit(0.10)), F.lit(0.01)).alias("weak"),
                                nm.blend(F.lit(0.8), nm.norm_sim(F.lit(0.40)), F.lit(0.01)).alias("strong"),
                                nm.blend(F.lit(1.2), F.lit(1.0), F.lit(None).cast("double")).alias("open"),
                                nm.clamp(F.lit(None).cast("double"), -1.0, 1.0).alias("none")).first()
    assert row.weak == pytest.approx(0.8 * 0.5 * 0.7 + 0.01) and row.strong == 1.0 and row.open > 1.0 and row.none is None


def record(item, title, asking, counts, seller="s", **more):
    return {"item_id": item, "title": title, "asking": asking, "year_counts": counts, "seller": seller, **more}


def test_cost_per_unit(spark):
    rows = [record("1", "1979 lot", 18.0, {"1979": 9}, title_count=9), record("2", "1979 lot", 9.0, {"1979": 3}, title_count=3),
            record("3", "mixed", 50.0, {"1979": 1, "1986": 1})]
    log = spark.createDataFrame(rows, logs.SCAN_LOG)
    cost = market.cost_per_unit(log).collect()
    assert [(r.year, r.n, r.median, r.supply, r.p25) for r in cost] == [("1979", 2, 2.5, 3, None)]
    assert [r.year for r in market.no_comp_years(log).collect()] == ["1986"]
    assert market.cost_per_unit(log, min_comps=3).count() == 0


def test_old_records_are_derived(spark):
    rows = [record("1", "old", 10.0, None, top_matches=[("1979", "a", 0.9), ("1979", "b", 0.5)])]
    d = records.derive_listing(spark.createDataFrame(rows, logs.SCAN_LOG)).first()
    assert (d.unit_count, d.single_year, d.year_counts) == (2, "1979", {"1979": 2})


def test_master_fold(spark):
    cols = "seq bigint, item_id string, seller string, title string, asking double, buying_format string, observed_at string, source string"
    rows = [(1, "v1|9", "Sam", "1979 PSU Lot", 5.0, "auction", "2026-01-02", "hunt"), (2, "backfill|x", "sam", "1979 psu lot!", None, "unknown", "2026-05-01", "backfill"),
            (3, "backfill|y", "Al", "other", None, "unknown", "2026-05-01", "backfill")]
    out = {r.item_id: r for r in history.build_master(spark.createDataFrame(rows, cols)).collect()}
    assert (out["v1|9"].times_seen, out["v1|9"].sources, len(out)) == (2, "backfill;hunt", 2)


def test_merge_is_idempotent(spark):
    df = lambda rows: spark.createDataFrame(rows, "item_id string, seq int")
    base, adds = df([("x", 1), ("x", 2), (None, 3)]), df([("x", 4), ("y", 5), ("y", 6)])
    merged = history.merge_new(base, adds)
    assert sorted(r.seq for r in merged.collect()) == [1, 2, 3, 5]
    assert history.merge_new(merged, adds).count() == 4


def test_merge_keeps_rows_without_an_id(spark):
    df = lambda rows: spark.createDataFrame(rows, "item_id string, seq int")
    merged = history.merge_new(df([("", 1)]), df([("", 2), ("", 3), ("x", 4), (None, 5), ("x", 6)]))
    assert sorted(r.seq for r in merged.collect()) == [1, 2, 3, 4, 5]


def test_canonical_rows_of_repeated_and_missing_ids(spark):
    rows = [("a", "1979 lot of 9", 18.0), ("a", "1979 lot of 9", 18.0), ("a", "x", None), (None, "y", 0.0), ("", "z", 1.0)]
    out = history.canonicalize(spark.createDataFrame(rows, "item_id string, title string, asking double")).collect()
    assert len(out) == 5 and sorted(r.item_id for r in out) == ["", "", "a", "a", "a"]
    first = [r for r in out if r.title.startswith("1979")][0]
    assert (first.years, first.title_count, first.has_price, first.currency, first.source, first.buying_format) == (["1979"], 9, True, "USD", "scan", "unknown")
    assert history.build_master(history.canonicalize(spark.createDataFrame(rows, "item_id string, title string, asking double"))).count() == 3


def test_needed_line_is_a_scan_record(spark):
    line = [(1, "2026-05-29T16:40:00Z", ">>> TITLE: [needed 0.86 1979 Bag The Aggies] [sellerA] 1979 lot of 9 pins")]
    r = logs.parse_title_lines(spark.createDataFrame(line, "seq int, ts string, payload string"), "src").first()
    assert r.needed_hit and r.alerted and r.best_needed.asDict() == {"year": "1979", "slogan": "Bag The Aggies", "overall": 0.86}
    assert (r.year_counts, r.title_count, r.title_years, r.asking, r.source) == ({"1979": 1}, 9, [1979], None, "src")
    assert r.item_id.startswith("backfill|") and [m.year for m in r.top_matches] == ["1979"]


@pytest.mark.parametrize("v, n", [("99999999999", -1), ("NaN", -1), ("inf", -1), ("2.5", 2), ("x", -1), ("-3", -3), (None, -1)])
def test_loose_int_never_fails(spark, v, n):
    assert spark.createDataFrame([(v,)], "v string").select(nm.loose_int(F.col("v"), F.lit(-1)).alias("n")).first().n == n


def test_recovered_lines(spark):
    lines = [(1, ">>> TITLE: [low-conf 0.55] [Bob] 1979 Lot"), (2, ">>> TITLE: [needed 0.61 1979 Beat Pitt] [Bob] 1979 lot"),
             (3, ">>> TITLE: [needed 0.80 1979 Beat [Pitt]] [bob] 1979 lot"), (4, ">>> TITLE: [confirmed-not-needed 0.9] [b] x")]
    parsed = logs.parse_title_lines(spark.createDataFrame(lines, "seq int, payload string"), "t")
    best = history.dedup_best(parsed).collect()
    assert [(r.kind, r.best_score, r.slogan) for r in best] == [("needed", 0.8, "Beat [Pitt]")]


def test_rules(spark):
    sheet = spark.createDataFrame([(1, "1979", "We Are Number One", "$4.00", "", "", "2"), (2, "1979", "we are #number one", "$9", "", "", ""),
                                   (3, " 1979", "We Are Number One ", "$5.00", "", "", "3.0"), (4, "", "x", "", "", "", "")],
                                  ["seq", " Year", "SLOGAN", "Max Price Single", "Max Price Year", "Notes", "Amount Needed"])
    table = rules.load_rules(sheet)
    assert table.count() == 2
    asked = spark.createDataFrame([(1979, "We Are Number One!"), (1979, "we are #number one"), (1980, "x")], "year int, slogan string")
    got = {(r.year, r.slogan): (r.max_price_single, r.amount_needed) for r in rules.lookup_rule(asked, table).collect()}
    assert got == {(1979, "We Are Number One!"): ("$5.00", 0), (1979, "we are #number one"): ("$9", 0), (1980, "x"): ("", 0)}
    with pytest.raises(ValueError):
        rules.load_rules(sheet.drop("Notes"))


def test_crawl_cutoff(spark):
    seen = spark.createDataFrame([("a", "2026-06-01", 1), ("b", "2026-06-01", 2), ("c", "2026-06-21", 1)], "item_id string, first_seen string, times int")
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "item_id string")
    assert sorted(r.item_id for r in filters.crawl_unseen(items, seen).collect()) == ["a", "d"]


def test_peers_match_a_plain_join(spark):
    words = ["lion", "pitt", "beat", "roar", "blue", "a"]
    rows = [(i, 1970 + i % 6, " ".join(words[j] for j in range(6) if (i >> j) & 1) + (" one two three four five six" if i % 9 == 0 else "")) for i in range(1, 64)]
    tok = {i: set(p.split()) - {"a"} for i, _, p in rows}
    want = set()
    for i, y, _ in rows:
        near = sorted(((-len(tok[i] & tok[j]), j) for j, z, _ in rows if z != y and tok[i] & tok[j]))[:4]
        want |= {(i, j, -s) for s, j in near}
    got = rules.slogan_peers(spark.createDataFrame(rows, "idx int, year int, phrase string"), k=4)
    assert {(r.idx, r.peer, r.shared) for r in got.collect()} == want


@pytest.mark.parametrize("conf, flagged, anchored, auto", [(0.92, False, True, True), (0.40, False, True, False), (0.92, True, True, False),
                                                          (None, False, True, True), (0.92, False, False, False)])
def test_pass1_gate(spark, conf, flagged, anchored, auto):
    cands = spark.createDataFrame([(1, 0, "Beat Pitt", 1979, "F", 0.9, None, 1, 1, 1.0, 1)],
                                  "job int, crop int, slogan string, year int, type string, overall double, game_year int, k1 int, k2 int, k3 double, k4 int")
    reads = spark.createDataFrame([(1, 0, "beat pitt!", conf, flagged, anchored, None)],
                                  "job int, crop int, slogan string, confidence double, flagged boolean, anchored boolean, printed_year int")
    row = decide.resolve(cands, reads).first()
    assert (row.source, row.auto, row.year) == ("gemini_auto", auto, 1979)


def test_printed_year_beats_majority(spark):
    c = "job int, crop int, slogan string, year int, type string, overall double, game_year int, k1 int, k2 int, k3 double, k4 int"
    cand = lambda crop, s, y, o, g=None: (1, crop, s, y, "F", o, g, 1, 1, 1.0, 1)
    cands = spark.createDataFrame([cand(0, "a", 1990, .9), cand(1, "b", 1990, .9), cand(2, "t", 1971, .9), cand(2, "t", 1978, .8, 1979), cand(3, "t", 1971, .9), cand(3, "t", 1989, .5)], c)
    read = lambda crop, s, p=None: (1, crop, s, 0.9, False, True, p)
    reads = spark.createDataFrame([read(0, "a"), read(1, "b"), read(2, "t", 1979), read(3, "t")], "job int, crop int, slogan string, confidence double, flagged boolean, anchored boolean, printed_year int")
    got = {r.crop: (r.source, r.year) for r in decide.resolve(cands, reads).collect()}
    assert got[2] == ("gemini_printed_year", 1978) and got[3] == ("gemini_majority", 1989)


def test_classify(spark):
    tops = spark.createDataFrame([(1, 0, 1, "a", "F", 0.70, None), (1, 1, 1, "b", "F", 0.50, None), (1, 2, 1, "c", "F", 0.90, None)],
                                 "job int, crop int, year int, slogan string, type string, overall double, gap double")
    none = spark.createDataFrame([], "job int, crop int, year int, slogan string, auto boolean, source string")
    got = {r.crop: r.label for r in decide.classify(tops, none, F.lit(False)).collect()}
    assert got == {0: "review", 1: "ignored", 2: "confirmed"}


def test_payload_fallbacks(spark):
    page = spark.createDataFrame([('{"itemSummaries":[{"itemId":"a","price":{"value":"x"},"thumbnailImages":[{"imageUrl":"t"}]},{"itemId":""}]}',), ("junk",)], "payload string")
    row = listings.flatten_listings_a(page).collect()
    assert [(r.item_id, r.current_price, r.gallery_url, r.buying_options) for r in row] == [("a", 0.0, "t", [])]


@pytest.mark.parametrize("raw, n", [('{"detected_slogans":[{"slogan":"A"}]}', 1), ('{"response":"```json\\n{\\"detected_slogans\\":[{\\"slogan\\":\\"A\\"}]}\\n```"}', 1),
                                    ('{"response":{"text":"said\\n{\\"total_button_count\\":1,\\"detected_slogans\\":[{\\"slogan\\":\\"A\\"},{\\"slogan\\":\\"B\\"}]}"}}', 2), ("oops", 0), ('{"response":{}}', 0)])
def test_reading_shapes(spark, raw, n):
    assert readings.parse_readings(spark.createDataFrame([(raw,)], "raw string"), "raw", []).count() == n


def test_logs_and_flat_cells(spark):
    path = new_folder(spark, "log")
    sinks.append_scan_log(spark.createDataFrame([record("1", "t", 1.0, {"1979": 1})], logs.SCAN_LOG), path)
    sinks.append_scan_log(spark.createDataFrame([("2",)], "item_id string"), path)
    assert logs.read_scan_log(spark, path).count() == 2
    flat = sinks.flat_cells(spark.createDataFrame([(1, None, (True, None), [1])], "a int, b string, det struct<w:boolean,m:string>, top array<int>")).first()
    assert flat.asDict() == {"a": "1", "b": "", "det_w": "TRUE", "det_m": "", "top_json": "[1]"}


def test_gate_and_grid(spark):
    r = spark.range(1).select(geo.gate(F.lit(.8), F.lit(.9), F.lit(6), F.lit(2), F.lit(3), F.lit(None).cast("string")).alias("a"),
                              geo.gate(F.lit(.8), F.lit(.9), F.lit(6), F.lit(2), F.lit(3), F.lit("sweep_fallback")).alias("b"),
                              geo.gate(F.lit(None).cast("double"), F.lit(.9), F.lit(6), F.lit(2), F.lit(3), F.lit(None).cast("string")).alias("c"),
                              geo.grid_consistent(F.lit(3), F.lit(2), F.lit(3)).alias("d"), geo.infer_grid(F.lit(12), F.lit(600.0), F.lit(800.0)).alias("g")).first()
    assert (r.a, r.b, r.c, r.d, tuple(r.g)) == ("auto", "suggest", "manual", False, (3, 4))


def test_money_rounds_the_exact_value(spark):
    values = [0.0, 0.005, 0.015, 0.125, 0.375, 1.005, 2.675, 1514.165, 99.995, 0.995, 1e9 + 0.125, 1e-9] + [k / 1000 for k in range(5, 20000, 10)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", nm.money(F.col("v")).alias("m")).collect()
    assert [r.m for r in rows] == [f"${r.v:.2f}" for r in rows]


def test_twins_by_another_name(spark):
    from lotscope.operators import rules
    cat = spark.createDataFrame([("Go State", "a"), ("Go State!", "a"), ("Go State", "b")], "slogan string, type string")
    name = F.concat_ws(" ", "slogan", "type")
    fams = rules.twin_registry(cat.withColumn("slogan", name))
    rows = spark.createDataFrame([("GO STATE", "a"), ("go state", "b"), (None, "a")], "slogan string, type string")
    assert [r.is_twin for r in rules.twin_guard(rows, fams, name).orderBy("type", "slogan").collect()] == [False, True, False]


def test_a_log_is_compressed_and_goes_on_from_a_plain_one(spark):
    path = new_folder(spark, "log")
    rows = spark.range(2000).select(F.col("id").cast("string").alias("item_id"), F.lit("Lot of 12 pins").alias("title"), F.lit(2.5).alias("asking"),
                                    F.expr("array(named_struct('year', '1979', 'slogan', 'Beat ' || id, 'overall', id / 7.0D))").alias("top_matches"))
    rows.where("item_id < 5").write.json(path)
    sinks.append_scan_log(rows.where("item_id >= 5"), path)
    sinks.append_scan_log(logs.read_scan_log(spark, path), path)
    log = logs.read_scan_log(spark, path).select(F.to_json(F.struct("*")).alias("line"))
    assert log.count() == 4000 and log.groupBy("line").count().where("count = 2").count() == 2000
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    assert size * 4 < log.select(F.sum(F.length("line"))).first()[0]
