"""Personal data: values found by pattern, and terms that give them away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. A protected entity is one such value. How strongly
a term reveals an entity is estimated from co-occurrence over the whole corpus: pointwise mutual information between
"the term stands in the text" and "the entity stands in the text", against the information the entity itself carries.
A term discloses an entity if that ratio reaches DISCLOSURE and at least LEAST_TEXTS different texts bear it out.
Disclosing terms are removed like the values themselves, or generalised to their kind, wherever they stand.

All words outside of values are candidates in texts whose entities stand in LEAST_TEXTS texts. Terms that these texts
already hold too often, or too seldom, are dropped from the texts' lists of terms before pairs are made; only the rest is
counted over the corpus.
Equal texts count once. Rows are told apart by a hash of id and text; repeated rows share their spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.llm.line_dedup import in_filter, wanted_filter
from lotscope.llm.words import as_text, distinct, hash_words, slices
from lotscope.plans.lineage import new_folder

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSURE, LEAST_TEXTS = 0.9, 2
#: Terms of texts that a task holds before it passes them on.
HELD_TERMS = 1 << 22
#: Numbers of texts by which terms are told apart when they are counted.
BOUNDS = (8, 64, 512)

_LOCAL = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match never begins inside a run of digits
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"(?:[0-9A-Za-z_]|[^\x00-\x7f])+")


def luhn(digits: str) -> bool:
    """The check of card numbers: every second digit from the right counts double."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def find_values(text: str) -> list[tuple[int, int, int]]:
    """Start, kind (index into KINDS) and end of every value, in order; ends are exclusive."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m.group().split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _value(text: str, start: int, kind: int, end: int) -> str:
    value = text[start:end].lower()
    return f"{kind}:{value if kind < 2 else _NOT_DIGIT.sub('', value)}"


def _terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Start and end of every word that stands in no value."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    begins, ends = [w[0] for w in words], [w[1] for w in words]
    inside = set()
    for start, _, end in spans:
        inside.update(range(bisect_right(ends, start), bisect_left(begins, end)))
    return [w for i, w in enumerate(words) if i not in inside]


def _hashes(text: str, places: list[tuple[int, int]]) -> np.ndarray:
    return hash_words(pa.array([text[s:e] for s, e in places], pa.large_string())).hashes


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, row_key, text_hash): values, and the different entities they are."""
    schema = "doc_id bigint, row_key bigint, text_hash bigint, spans array<struct<start:int,kind:int,end:int>>, entities array<string>"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text"):
            spans, entities = [], []
            for text in as_text(batch.column("text")).to_pylist():
                found = find_values(text)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                entities.append(sorted({_value(text, *v) for v in found}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), batch.column("text_hash"), pa.array(spans, span_type),
                 pa.array(entities, pa.list_(pa.string()))], ["doc_id", "row_key", "text_hash", "spans", "entities"])

    return docs.select("doc_id", "text", "row_key", "text_hash").mapInArrow(run, schema)


def terms_of(docs: DataFrame, texts: DataFrame, limit: float = float("inf")) -> DataFrame:
    """Different terms outside of values in each of ``texts`` (column text_hash, unique): text_hash, terms. A row a text.

    Terms that stand in more than ``limit`` different texts are of no use to the caller. Those that do so among the texts
    that a task holds at a time (HELD_TERMS) are left out at once, so frequent words are never shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted_filter(texts.select(F.col("text_hash").alias("place"))))

    def flush(keys: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        _, first = np.unique(np.array(keys, np.int64), return_index=True)
        flat = np.concatenate([np.zeros(0, np.int64), *(found[i] for i in first)])
        values, counts = np.unique(flat, return_counts=True)
        keep = counts[np.searchsorted(values, flat)] <= limit if len(flat) else np.zeros(0, bool)
        row = np.repeat(np.arange(len(first)), [len(found[i]) for i in first])[keep]
        ends = np.searchsorted(row, np.arange(len(first) + 1))
        return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in first], pa.int64()),
                                           pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[keep]))], ["text_hash", "terms"])

    def run(batches: Iterator[pa.RecordBatch]):
        table, keys, found, held = shared.value, [], [], 0
        for batch in slices(batches, "text"):
            hashes = batch.column("text_hash").to_numpy()
            rows = np.flatnonzero(in_filter(table, hashes.view(np.uint64)))
            for row, text in zip(rows, as_text(batch.column("text").take(pa.array(rows))).to_pylist(), strict=True):
                keys.append(int(hashes[row]))
                found.append(distinct(_hashes(text, _terms(text, find_values(text)))).view(np.int64))
                held += len(found[-1])
            if held >= HELD_TERMS:
                yield flush(keys, found)
                keys, found, held = [], [], 0
        yield flush(keys, found)

    held = docs.select("text", "text_hash").mapInArrow(run, "text_hash bigint, terms array<bigint>")
    return held.join(texts.select("text_hash"), "text_hash", "left_semi").dropDuplicates(["text_hash"])


def _only(held: DataFrame, terms: DataFrame) -> DataFrame:
    """Of the terms of ``held`` (text_hash, terms) those in ``terms`` (term and its counts): a row per text and term."""
    shared = held.sparkSession.sparkContext.broadcast(wanted_filter(terms.select(F.col("term").alias("place"))))

    def run(batches: Iterator[pa.RecordBatch]):
        table = shared.value
        for batch in batches:
            lists = batch.column("terms")
            flat = lists.flatten().to_numpy()
            keep = in_filter(table, flat.view(np.uint64))
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[keep]
            yield pa.RecordBatch.from_arrays([batch.column("text_hash").take(pa.array(row)), pa.array(flat[keep])], ["text_hash", "term"])

    return held.mapInArrow(run, "text_hash bigint, term bigint").join(terms, "term")


def places_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Every place outside of values where one of ``terms`` (column term, unique) stands: row_key, start, end."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted_filter(terms.select(F.col("term").alias("place"))))

    def run(batches: Iterator[pa.RecordBatch]):
        table = shared.value
        for batch in slices(batches, "text"):
            words = hash_words(batch.column("text"))
            rows = np.unique(words.rows[in_filter(table, words.hashes)])
            keys = batch.column("row_key").to_numpy()
            for row, text in zip(rows, as_text(batch.column("text").take(pa.array(rows))).to_pylist(), strict=True):
                places = np.array(_terms(text, find_values(text)), np.int32).reshape(-1, 2)
                hashes = _hashes(text, places.tolist())
                keep = in_filter(table, hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(keep.sum()), keys[row])), pa.array(hashes[keep].view(np.int64)), pa.array(places[keep, 0]),
                     pa.array(places[keep, 1])], ["row_key", "term", "start", "end"])

    placed = docs.select("text", "row_key").mapInArrow(run, "row_key bigint, term bigint, start int, end int")
    return placed.join(terms.select("term"), "term", "left_semi").select("row_key", "start", "end")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Number of different texts that hold each of ``terms`` (term, unique, and ``most``): term, n_texts; none for terms of
    more than ``most`` texts."""
    held = tasks_counts(docs, terms).groupBy("term", "text_hash").agg(F.sum("n").alias("n"), F.bool_or("out").alias("out"))
    counted = held.groupBy("term").agg(F.sum(F.when(F.col("text_hash").isNull(), F.col("n")).otherwise(1)).alias("n_texts"), F.bool_or("out").alias("out"))
    return counted.filter(~F.col("out")).join(terms, "term").filter(F.col("n_texts") <= F.col("most")).select("term", "n_texts")


def tasks_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """What tasks find of ``terms``: text_hash, term, n, out; ``n`` texts without copies, or the one that is named.

    Terms are told apart by the least of BOUNDS that is not below ``most``, with a filter each. A term that more different
    texts hold among those that a task has at a time (HELD_TERMS) is passed on once and is out. Texts that stand in one row
    are counted there, a row per term; only texts with copies are passed on by name, and those that the filter of copies
    takes in by mistake.
    """
    bounds = np.array([*BOUNDS, np.inf])
    level = sum(((F.col("most") > b).cast("int") for b in BOUNDS), F.lit(0))
    places = terms.select(F.col("term").alias("place"), level.alias("level"))
    shared = docs.sparkSession.sparkContext.broadcast([wanted_filter(places.filter(F.col("level") == i)) for i in range(len(bounds))])
    copied = docs.groupBy(F.col("text_hash").alias("place")).count().filter("count > 1").select("place")
    copies = docs.sparkSession.sparkContext.broadcast(wanted_filter(copied))

    def levels(hashes: np.ndarray) -> np.ndarray:
        """Number of the last filter that a hash is in, or -1."""
        out = np.full(len(hashes), -1)
        for i, table in enumerate(shared.value):
            out[in_filter(table, hashes)] = i
        return out

    def flush(texts: list[np.ndarray], found: list[np.ndarray]) -> pa.RecordBatch:
        text, term = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (texts, found))
        order = np.lexsort((text, term))
        text, term = text[order], term[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
        text, term = text[new], term[new]
        some, counts = np.unique(term, return_counts=True)
        out = counts > bounds[levels(some.view(np.uint64))]
        frequent = np.repeat(out, counts)
        named = ~frequent & in_filter(copies.value, text.view(np.uint64))
        alone = np.bincount(np.repeat(np.arange(len(some)), counts)[~frequent & ~named], minlength=len(some))
        told = out | (alone > 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.zeros(int(told.sum()), np.int64), text[named]]), mask=np.repeat([True, False], [told.sum(), named.sum()])),
             pa.array(np.concatenate([some[told], term[named]])), pa.array(np.concatenate([alone[told], np.ones(int(named.sum()), np.int64)])),
             pa.array(np.concatenate([out[told], np.zeros(int(named.sum()), bool)]))], ["text_hash", "term", "n", "out"])

    def run(batches: Iterator[pa.RecordBatch]):
        texts, found, held = [], [], 0
        for batch in slices(batches, "text"):
            words = hash_words(batch.column("text"))
            keep = levels(words.hashes) >= 0
            texts.append(batch.column("text_hash").to_numpy()[words.rows[keep]])
            found.append(words.hashes[keep].view(np.int64))
            held += len(found[-1])
            if held >= HELD_TERMS:
                yield flush(texts, found)
                texts, found, held = [], [], 0
        yield flush(texts, found)

    return docs.select("text", "text_hash").mapInArrow(run, "text_hash bigint, term bigint, n bigint, out boolean")


def disclosures(docs: DataFrame, found: DataFrame, disclosure: float = DISCLOSURE, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """Pairs of entity and term of which the term discloses the entity, with the ratio.

    A term stands in at least as many texts as it has among those with entities, and with an entity in at most as many as
    the entity has; terms and pairs that these bounds rule out are dropped before they are paired or counted.
    """
    spark = docs.sparkSession
    total = max(1, docs.select(F.countDistinct("text_hash")).first()[0])
    held = found.select("text_hash", F.explode("entities").alias("entity")).distinct()
    entities = held.groupBy("entity").agg(F.count("*").alias("n_entity")).filter((F.col("n_entity") >= least_texts) & (F.col("n_entity") < total))
    folder = new_folder(spark, "pii")
    held.join(entities, "entity").write.parquet(folder + "/held")
    held = spark.read.parquet(folder + "/held")
    def ratio(n_joint: Column) -> Column:
        shared = F.log2(F.lit(total) * n_joint / (F.greatest(F.col("n_texts"), n_joint) * F.col("n_entity")))
        return shared / F.log2(F.lit(total) / F.col("n_entity"))

    most = held.agg(F.max("n_entity")).first()[0] or 1
    # a pair's ratio is at most that of n_joint = n_entity, for which n_texts may be n_entity * (total / n_entity) ** (1 - disclosure);
    # that grows with n_entity if disclosure is 0 or more
    limit = most * (total / most) ** (1 - disclosure) * (1 + 1e-9)
    terms_of(docs, held.select("text_hash").distinct(), limit).write.parquet(folder + "/terms")
    terms = spark.read.parquet(folder + "/terms")
    known = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_texts"))
    known.filter((F.col("n_texts") >= least_texts) & (F.col("n_texts") <= limit)).write.parquet(folder + "/known")
    pairs = _only(terms, spark.read.parquet(folder + "/known")).join(held, "text_hash").filter(ratio(F.least("n_texts", "n_entity")) >= disclosure - 1e-9)
    joint = (pairs.groupBy("entity", "term").agg(F.count("*").alias("n_joint"), F.first("n_entity").alias("n_entity"), F.first("n_texts").alias("n_texts"))
             .filter((F.col("n_joint") >= least_texts) & (ratio(F.col("n_joint")) >= disclosure)).drop("n_texts"))
    joint.write.parquet(folder + "/joint")
    joint = spark.read.parquet(folder + "/joint")
    # the ratio of a pair is high enough as long as n_texts is not above this
    most = F.col("n_joint") * F.pow(F.lit(total) / F.col("n_entity"), F.lit(1 - disclosure)) * (1 + 1e-9)
    counted = term_counts(docs, joint.groupBy("term").agg(F.max(most).alias("most")))
    return joint.join(counted, "term").withColumn("ratio", ratio(F.col("n_joint"))).filter(F.col("ratio") >= disclosure).select("entity", "term", "ratio")


def spans(docs: DataFrame, disclosure: float = DISCLOSURE, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id``, ``row_key``, ``spans`` (values) and ``terms`` (disclosing words).

    Both are arrays of (start, kind, end) in order, in code points, with exclusive ends. A null text counts as empty and
    has none. ``row_key`` is the hash of id and text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "text")).withColumn("text_hash", F.xxhash64("text"))
    folder = new_folder(spark, "pii")
    find(docs).write.parquet(folder)
    found = spark.read.parquet(folder)
    telling = disclosures(docs, found, disclosure, least_texts)
    telling.select("term").distinct().write.parquet(folder + "-telling")
    terms = (places_of(docs, spark.read.parquet(folder + "-telling"))
             .select("row_key", F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end").alias("t"))
             .groupBy("row_key").agg(F.sort_array(F.collect_set("t")).alias("terms")))
    return (found.select("doc_id", "row_key", "spans").join(terms, "row_key", "left")
            .withColumn("terms", F.coalesce("terms", F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)"))))


def sanitise(docs: DataFrame, generalise: bool = True) -> DataFrame:
    """``docs`` with values and disclosing terms of ``text`` replaced by their kind in brackets, or taken out.

    Spans that overlap are replaced as one, named after the first. A null text stays null; other columns stay.
    """
    names = list(docs.columns)
    row_key, here = (next(n for n in (f"{kind}_{i}" for i in range(len(names) + 1)) if n.lower() not in {c.lower() for c in names}) for kind in ("row_key", "spans"))
    found = spans(docs).select(F.col("row_key").alias(row_key), F.concat("spans", "terms").alias(here)).dropDuplicates([row_key])
    keyed = docs.withColumn(row_key, F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit(""))))
    joined = keyed.join(found, row_key, "left").select(*names, here)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text"):
            texts = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column(here).to_pylist()):
                out, at = [], 0
                for s in sorted(found or (), key=lambda s: (s["start"], s["kind"])):
                    if s["start"] >= at:
                        out += [text[at:s["start"]], f"[{KINDS[s['kind']].upper()}]" if generalise else ""]
                    at = max(at, s["end"])
                texts.append(None if text is None else "".join(out) + text[at:])
            made = {"text": pa.array(texts, batch.column("text").type)}
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in names], names)

    return joined.mapInArrow(run, schema)
