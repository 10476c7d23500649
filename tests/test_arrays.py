"""The reader of JSON arrays against the parser, with files cut into many small byte ranges."""
import json
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from lotscope.plans.lineage import new_folder
from lotscope.sources import arrays, logs

PARTS = ["plain", "a } b", "{", "}{", '"', '\\', '\\"}', "\n", "[1,2]", "é{ü}", "", "}]", "x" * 50]


@pytest.fixture
def small_ranges(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "700"), spark.conf.set(names[1], "0")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def write(folder, name, text):
    path = pathlib.Path(folder.removeprefix("file:"))
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text, encoding="utf-8")


def entry(rnd, i):
    text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 6)))
    e = {"i": i, "timestamp": str(i), "textPayload": text}
    if rnd.random() < 0.4:
        e["more"] = {"a" + text: {"b": [{}, {"c": text}]}}
    return e


@pytest.mark.parametrize("indent", [None, 2])
def test_many_ranges_give_what_the_parser_gives(spark, small_ranges, indent):
    rnd, folder = random.Random(7), new_folder(spark, "arrays")
    want = []
    for f in range(3):
        rows = [entry(rnd, 1000 * f + i) for i in range(150 if f else 1)]
        write(folder, f"f{f}.json", json.dumps(rows, indent=indent, ensure_ascii=f == 1) + "\n" * f)
        want += rows
    write(folder, "empty.json", "[]"), write(folder, "nothing.json", "")
    elements = arrays.array_elements(spark, folder)
    assert spark.read.option("lineSep", "}").text(folder).rdd.getNumPartitions() > 20
    got = sorted((json.loads(r.value) for r in elements.collect()), key=lambda e: e["i"])
    assert got == want
    lines = {(r.ts, r.payload) for r in logs.read_log_lines(spark, folder, "json").collect()}
    assert lines == {(e["timestamp"], e["textPayload"]) for e in want}
    plain = spark.read.schema("i int, textPayload string").json(folder, multiLine=True).where("i is not null")
    mine = arrays.read_json_array(spark, folder, "i int, textPayload string")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, plain.collect()))


def test_other_elements_and_a_cut_file(spark):
    folder = new_folder(spark, "arrays")
    write(folder, "a.json", '[1, "}", null, {"i": 1}, ["x"], {"i": 2}, {"i": "no"}, {"i": 3')
    assert sorted(str(r.i) for r in arrays.read_json_array(spark, folder, "i int").collect()) == ["1", "2", "None"]
    write(folder, "b.json", '[{"timestamp": null}]')
    assert ("", "") in {tuple(r) for r in logs.read_log_lines(spark, folder, "json").select("ts", F.coalesce("payload", F.lit("?"))).collect()}
