import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lotscope.llm import pii, queries
from tests.llm.helpers import docs, prose, table

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute(text):
    found = []
    for kind, (name, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            sum_ = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1]))
            if (kind == 1 and any(int(p) > 255 for p in m[0].split(".")) or kind == 2 and not (14 <= len(digits) <= 19 and sum_ % 10 == 0)
                    or kind == 3 and not 10 <= len(digits) <= 15):
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_values_against_brute_force():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "x@y", ".", "-", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "256.1.1.1", "001.2.3.4", "+49 (30) 1234567",
             "+1", "é", " ", "\n", "12", "%", "_", "5", "0", "user@mail.example.com"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.find_values(text) == brute(text), text
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "1." * 50_000, "+1(" * 50_000):  # linear on hostile texts
        pii.find_values(text)


def test_query_against_brute_force(spark):
    got = queries.op9_pii(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in table(spark, "documents", "/root/testdata/sf0.01").collect()}
    assert len(got) == len(texts)
    for r in got:
        spans = brute(texts[r.doc_id])
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) - {""} <= set(r.spans.split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[1] == i for s in spans) for i in range(4)]


def telling_rows():
    """A nickname that stands only near one address, a common word, and a name near many addresses."""
    rows = [(d, f"{prose(15, d)} please write to zorblax the common boss at zed@mail.example.com today {prose(5, 100 + d)}") for d in range(4)]
    rows += [(10 + d, f"{prose(12, 200 + d)} the common boss common writes user{d}@mail.example.com please today {prose(4, 300 + d)}") for d in range(40)]
    return rows + [(60 + d, prose(30, 400 + d) + " please write to the common at today") for d in range(40)]


def test_terms_that_give_an_entity_away(spark):
    rows = telling_rows()
    odd = [(None, rows[0][1]), (0, rows[0][1]), (80, None), (81, "")]
    got = pii.spans(docs(spark, *rows, *odd, spans="x", terms=1)).collect()
    assert len(got) == len(rows) + 4
    texts = dict(rows)
    for r in got:
        here = {texts[r.doc_id][t.start:t.end] for t in r.terms} if r.doc_id in texts else None
        if r.doc_id is not None and r.doc_id < 4:
            assert here == {"zorblax"}
        elif r.doc_id is not None:
            assert not here
    assert pii.spans(docs(spark, *rows).limit(0)).count() == 0


def test_ratio_is_the_definition(spark):
    import math

    rows = telling_rows()
    frame = docs(spark, *rows).selectExpr("doc_id", "text", "xxhash64(doc_id, text) as row_key", "xxhash64(text) as text_hash")
    got = pii.disclosures(frame, pii.find(frame), disclosure=0.0)
    ratios = {round(r.ratio, 6) for r in got.filter("entity = '0:zed@mail.example.com'").collect()}
    n = len(rows)
    ratio = lambda df: math.log2(n * 4 / (df * 4)) / math.log2(n / 4)
    assert round(ratio(4), 6) in ratios and round(ratio(44), 6) in ratios  # zorblax; boss


def test_sanitise(spark):
    rows = telling_rows()
    frame = docs(spark, *rows, (90, None))
    got = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert "write to [TERM] the common boss at [EMAIL] today" in got[0] and got[90] is None and got[60] == dict(rows)[60]
    assert "to  the common boss at  today" in {r.doc_id: r.text for r in pii.sanitise(frame, generalise=False).collect()}[0]


def test_terms_far_from_their_value(spark):
    letters = [(d, f"Zorblax writes {prose(40, d)} yours zed@mail.example.com") for d in range(4)]
    others = [(10 + d, prose(30, 100 + d)) for d in range(60)]
    again = [(4, f"Zorblax writes {prose(30, 90)} yours zed@mail.example.com {prose(30, 91)} zorblax")]
    got = {r.doc_id: r.text for r in pii.sanitise(docs(spark, *letters, *again, *others)).collect()}
    for d, text in (*letters, *again):
        assert got[d] == text.replace("Zorblax writes", "[TERM] [TERM]").replace("yours zed@mail.example.com", "[TERM] [EMAIL]").replace("zorblax", "[TERM]")
    assert all(got[d] == text for d, text in others)
    alone = [(80, f"{prose(20, 95)} zorblax {prose(20, 96)}")]  # a text without the value
    more = [(200 + d, f"Zorblax writes {prose(30, 400 + d)} yours zed@mail.example.com") for d in range(40)]
    got = {r.doc_id: r.text for r in pii.sanitise(docs(spark, *letters, *again, *others, *alone, *more)).collect()}
    assert got[80] == alone[0][1].replace("zorblax", "[TERM]")


def test_no_text_stops_the_job(spark):
    zeros = "1.2.3." + "0" * 5000
    assert pii.find_values(zeros) == [(0, 1, len(zeros))] and pii.find_values("1.2.3." + "0" * 5000 + "255")[0][1] == 1
    assert pii.find_values("1.2.3." + "9" * 5000) == []
    crowd = " ".join(f"user{i}@mail.example.com" for i in range(10_000))
    rows = [(1, zeros), (2, crowd + " first"), (3, crowd + " second"), (4, "1.2.3.4 " * 100_000), (5, "zorblax")]
    got = {r.doc_id: (len(r.spans), len(r.terms)) for r in pii.spans(docs(spark, *rows)).collect()}
    assert {d: n for d, (n, _) in got.items()} == {1: 1, 2: 10_000, 3: 10_000, 4: 100_000, 5: 0}


def test_sanitise_keeps_columns_of_any_name(spark):
    rows = docs(spark, (1, "mail a@b.example.com now"), spans="s", row_key=7, ROW_KEY_0=8)
    got = pii.sanitise(rows).first().asDict()
    assert got == {"doc_id": 1, "text": "mail [EMAIL] now", "spans": "s", "row_key": 7, "ROW_KEY_0": 8}


def test_frequent_terms_are_left_out_wherever_they_are_counted(spark):
    rows = docs(spark, *((d, f"common {'often ' * (d % 3 == 0)}w{d % 40} w{d % 40}") for d in range(240)), (500, "common w1 w1"), (501, "common w1 w1"))
    rows = rows.withColumn("text_hash", F.xxhash64("text")).repartition(3)
    texts = {r.doc_id: set(r.text.split()) for r in rows.dropDuplicates(["text"]).collect()}
    counts = Counter(w for ws in texts.values() for w in ws)
    names = dict(zip(counts, pii._hashes(" ".join(counts), [(m.start(), m.end()) for m in re.finditer(r"\S+", " ".join(counts))]).view("int64").tolist()))
    terms = spark.createDataFrame([(h,) for h in names.values()], "term bigint")
    for limit in (1, 5, 30, 200, float("inf")):
        got = {r.term: r.n_texts for r in pii.term_counts(rows, terms.withColumn("most", F.lit(float(limit)))).collect()}
        assert got == {names[w]: n for w, n in counts.items() if n <= limit}
        lists = pii.terms_of(rows, rows.select("text_hash").distinct(), limit).collect()
        left = Counter(t for r in lists for t in r.terms)
        assert len(lists) == len(texts) and all(left[names[w]] == n for w, n in counts.items() if n <= limit)


def test_texts_without_copies_are_counted_in_their_task(spark):
    """A row per term and task, however many texts; a text with copies counts once wherever they stand."""
    texts = [f"w{i} common{i % 5} of{i % 2}" for i in range(400)] + ["twin common1 of0"] * 6
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("text_hash", F.xxhash64("text")).repartition(4)
    words = ["common0", "common1", "of0"]
    names = dict(zip(words, pii._hashes(" ".join(words), [(0, 7), (8, 15), (16, 19)]).view("int64").tolist()))
    terms = spark.createDataFrame([(h, 1e9) for h in names.values()], "term bigint, most double")
    assert pii.tasks_counts(rows, terms).where("text_hash is null").count() <= 3 * 4
    assert pii.tasks_counts(rows, terms).count() <= 3 * 4 + 2 * 6 + 12
    assert {r.term: r.n_texts for r in pii.term_counts(rows, terms).collect()} == {names["common0"]: 80, names["common1"]: 81, names["of0"]: 201}
