"""Importance resampling of documents towards a target distribution.

A document is a bag of hashed features: runs of words, each in one of a fixed number of buckets. Two counts per bucket,
over the corpus and over the target, give every bucket a gain in whole thousandths, the logarithm of how much likelier
the target uses it. A document's weight is its mean gain; Gumbel noise from a hash of its id turns the best scores into
a sample without replacement. The arrays of counts and gains have one entry a bucket; a task adds up its documents and
scores them by looking gains up in the array.

The cutoff score is found without sorting the scores: a mergeable quantile sketch names a bracket of scores that should
hold it, exact counts of the rows above and inside say whether it does, and else the bracket is widened. Only rows of
the bracket are sorted. Rows that are equal in all columns are one row with a number, so repeated rows make no hot key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.llm.tables import through_table
from lotscope.llm.words import as_text, slices
from lotscope.plans.lineage import new_folder

BUCKETS = 10_000
#: Accuracy of the quantile sketch, and how far to each side of the wanted share the first bracket reaches.
ACCURACY, MARGIN = 10_000, 0.002
_KEYS = ["doc_id", "n_features", "weight", "score"]
#: Letters A-Z in lower case; every ASCII character that no word holds becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: bytes, order: int) -> tuple[int, np.ndarray]:
    """Number of words of a text, and the CRC-32 of each of its runs of 1 to ``order`` words joined by a space."""
    words = text.translate(_FOLD).split()
    found = list(map(crc32, words))
    for n in range(2, order + 1):
        found += [crc32(b" ".join(words[i:i + n])) for i in range(len(words) - n + 1)]
    return len(words), np.array(found, np.uint32)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in slices(batches, "text"):
        yield batch, [t.as_buffer().to_pybytes() for t in as_text(batch.column("text")).cast(pa.large_binary())]


def bucket_counts(texts: DataFrame, order: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket, as one array of ``buckets`` integers. Null texts have none."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for _, texts in _texts(batches):
            found = np.concatenate([features(t, order)[1] for t in texts])
            total += np.bincount(found % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # at most one row a bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier the target uses each bucket, with one added to every count."""
    n, total, wanted = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (total + n) / ((float(s) + 1) * (wanted + n))))
                     for s, t in zip(corpus, target)], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(docs: DataFrame, gains: np.ndarray, order: int = 1, seed: int = 2024) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of every row of ``docs`` (doc_id, text).

    Other columns are left out. A null or empty text has no features and the weight zero; a null id draws its noise as
    the empty text would.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches):
        table = shared.value
        for batch, texts in _texts(batches):
            words, number, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, t in enumerate(texts):
                words[i], found = features(t, order)
                number[i] = len(found)
                weight[i] = int(table[found % np.uint32(len(table))].sum()) // len(found) if len(found) else 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words, number, weight))], names)

    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    return made.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _sequence() -> list[Column]:
    """Order of the draw: best score first, then smaller id (rows without an id last); the rest makes it total."""
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]


def in_order(rows: DataFrame, path: str) -> DataFrame:
    """Rows with a number ``times`` each, and ``start``, how often rows before them occur in all.

    The rows are range-partitioned and sorted once, written to ``path``, and numbered inside each part; one sum per part
    crosses parts.
    """
    def number(batches):
        total = 0
        for batch in batches:
            times = batch.column("times").to_numpy()
            ends = total + np.cumsum(times)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - times)], [*batch.schema.names, "start"])
            total = int(ends[-1]) if len(ends) else total

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    parts = rows.repartitionByRange(*_sequence()).sortWithinPartitions(*_sequence()).mapInArrow(number, f"{kinds}, start bigint")
    parts = through_table(parts.withColumn("part", F.spark_partition_id()), path)
    sums = sorted((r.part, r.n) for r in parts.groupBy("part").agg(F.sum("times").alias("n")).collect())  # one row a task
    before = dict(zip((p for p, _ in sums), accumulate((n for _, n in sums), initial=0)))
    if not before:
        return parts.drop("part")
    offsets = rows.sparkSession.createDataFrame(list(before.items()), "part int, before bigint")
    return parts.join(offsets, "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")


class Bracket(NamedTuple):
    """Scores from ``low`` to ``high``, the rows above it, and those above or inside; ``rounds`` counts the tries."""
    low: int
    high: int
    above: int
    upto: int
    rounds: int


def bracket(scored: DataFrame, wanted: int, total: int, margin: float = MARGIN, accuracy: int = ACCURACY) -> Bracket:
    """Scores between which the ``wanted``-th best of ``total`` rows lies (1 <= wanted <= total), by exact counts.

    The sketch only proposes; a bracket that misses is widened fourfold until it holds the cutoff, at last to all scores.
    """
    rounds = 0
    while True:
        rounds += 1
        at = 1 - wanted / total
        low, high = max(0.0, at - margin), min(1.0, at + margin)
        if margin < 1:
            low, high = scored.agg(F.percentile_approx("score", F.array(F.lit(low), F.lit(high)), accuracy)).first()[0]
        else:
            low, high = scored.agg(F.min("score"), F.max("score")).first()
        above, upto = scored.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score") >= low)).first()
        if above < wanted <= upto:
            return Bracket(low, high, above, upto, rounds)
        margin *= 4


def draw(scored: DataFrame, percent: int, least_words: int = 20, margin: float = MARGIN, accuracy: int = ACCURACY) -> DataFrame:
    """Rows of ``scores`` with their ``rank`` in the draw; undrawn rows have none.

    Of the N rows of at least ``least_words`` words, floor(percent * N / 100) of the highest scores are drawn; ties go
    to the smaller id. Of rows that are equal in all columns, any may be the one that is drawn.
    """
    folder = new_folder(scored.sparkSession, "resample")
    fit = scored.filter(F.col("n_words") >= least_words)
    total = fit.count()
    wanted = percent * total // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    found = bracket(fit, wanted, total, margin, accuracy)
    inside = fit.filter(F.col("score").between(found.low, found.high)).groupBy(*_KEYS).agg(F.count("*").alias("times"))
    left = wanted - found.above
    last = in_order(inside, f"{folder}/bracket").filter(f"start < {left} and start + times >= {left}").first()
    # drawn: all that stands before the last row in order, and as many of that row as are left
    doc, weight, number = (F.col(c) for c in ("doc_id", "weight", "n_features"))
    same = F.col("score") == last.score
    later_id = (doc > last.doc_id) | doc.isNull() if last.doc_id is not None else F.lit(False)
    same_id = doc.eqNullSafe(F.lit(last.doc_id).cast("bigint"))
    later = later_id | (same_id & ((weight > last.weight) | ((weight == last.weight) & (number > last.n_features))))
    chosen = fit.filter((F.col("score") > last.score) | (same & ~F.coalesce(later, F.lit(False))))
    chosen = in_order(chosen.groupBy(*_KEYS).agg(F.count("*").alias("times")), f"{folder}/chosen")
    chosen = chosen.withColumn("times", F.least("times", F.lit(wanted) - F.col("start")))
    # undrawn copies of a drawn row keep their place in the result
    copies = scored.groupBy(*_KEYS, "n_words").agg(F.count("*").alias("all"))
    joined = copies.join(chosen, [F.equal_null(copies[c], chosen[c]) for c in _KEYS] + [copies["n_words"] >= least_words], "left")
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("all")))
    out = joined.select(*(copies[c] for c in _KEYS), "start", "times", each.alias("copy"))
    return out.select(*_KEYS, F.when(F.col("copy") <= F.col("times"), F.col("start") + F.col("copy")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int, order: int = 1, buckets: int = BUCKETS, seed: int = 2024,
             least_words: int = 20) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn).

    ``target`` (text) is the distribution to draw towards. Empty tables count as texts without features.
    """
    gains = bucket_gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets))
    scored = through_table(scores(docs, gains, order, seed), f"{new_folder(docs.sparkSession, 'resample')}/scores")
    return draw(scored, percent, least_words)
