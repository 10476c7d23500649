"""Toxicity by a chain of linear classifiers.

The categories form a chain. Each is predicted by a logistic model over signs of the text and the probabilities of all
earlier categories; while a model is trained, those probabilities come from models that have not seen the row (out of
fold). Signs are words, and beginnings of words for inflected and compound forms, that stand in significantly more
texts of the category than chance allows, and a few shares of characters.

Training takes a bounded sample: about ``max_rows`` labelled rows by a hash of the id, of which near copies (equal least
shingle hash) count once, so that a much copied text does not make its words suspicious. Scoring takes every document,
in whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.llm.tables import small_batches
from lotscope.llm.words import as_text, buffers, group_starts, hash_words, mix, prefix_hashes, shingle_hashes, slices

#: Bound of the training sample in labelled rows, and of the signs a category may have.
MAX_ROWS, MAX_SIGNS = 20_000, 20_000
PREFIXES = (4, 5, 6, 7, 8)
FOLDS = 4
_SHARES = ("symbols", "capitals", "shouts", "bars", "digits")


class Link(NamedTuple):
    """One category: its signs (sorted hashes) with weights, the weights of shares and earlier categories, and the bias."""
    name: str
    signs: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    bias: float


def _signs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, sign) of a column of texts, ordered by row."""
    words = hash_words(column)
    hashes, rows = [words.hashes], [words.rows]
    for some, made in prefix_hashes(words, PREFIXES):
        hashes.append(made)
        rows.append(words.rows[some])
    hashes, rows = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    first = np.ones(len(rows), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return rows[first], hashes[first]


def _shares(column: pa.Array) -> np.ndarray:
    """Shares of kinds of characters among the bytes of each text; zero for empty texts."""
    offsets, data = buffers(as_text(column))
    kinds = np.zeros(256, np.uint8)
    for i, letters in enumerate((b"#*$%&<>", bytes(range(65, 91)), b"!", b"|", b"0123456789"), 1):
        kinds[list(letters)] = i
    kind = kinds[data[offsets[0]:offsets[-1]]]
    at = offsets - offsets[0]
    out = np.zeros((len(column), len(_SHARES)))
    for i in range(len(_SHARES)):
        sums = np.concatenate([[0], np.cumsum(kind == i + 1)])
        out[:, i] = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, np.diff(at))
    return out


def _look_up(signs: np.ndarray, table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are signs, and the index of each in ``signs``; ``table`` marks the signs' highest 16 bits."""
    maybe = np.flatnonzero(table[hashes >> np.uint64(48)])
    index = np.searchsorted(signs, hashes[maybe])
    index[index == len(signs)] = 0
    found = signs[index] == hashes[maybe] if len(signs) else np.zeros(0, bool)
    return maybe[found], index[found]


def _marks(signs: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 16, bool)
    table[signs >> np.uint64(48)] = True
    return table


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train(rows: np.ndarray, index: np.ndarray, width: int, dense: np.ndarray, truth: np.ndarray, steps: int = 300):
    """Logistic regression by accelerated gradient steps over sparse signs and dense columns: weights, weights, bias."""
    n = len(truth)
    per_row = np.bincount(rows, minlength=n) + (dense ** 2).sum(1) + 1
    rate = 4 / (per_row.mean() * 2 + 1e-9) if n else 0
    w, v, bias = np.zeros(width), np.zeros(dense.shape[1]), 0.0
    w0, v0, bias0 = w, v, bias
    for step in range(steps if n else 0):
        turn = step / (step + 3)
        wy, vy, by = w + turn * (w - w0), v + turn * (v - v0), bias + turn * (bias - bias0)
        gap = _sigmoid(np.bincount(rows, wy[index], minlength=n) + dense @ vy + by) - truth
        w0, v0, bias0 = w, v, bias
        w = wy - rate * (np.bincount(index, gap[rows], minlength=width) / n + 1e-5 * wy)
        v = vy - rate * (dense.T @ gap / n + 1e-5 * vy)
        bias = by - rate * gap.mean()
    return w, v, bias


def sample_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_rows: int = MAX_ROWS) -> DataFrame:
    """The training sample: id, text and 0/1 truth per category (null where the label is unknown)."""
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        *(F.max(F.expr(c).cast("double")).alias(f"y_{k}") for k, c in categories.items()))
    share = min(1.0, max_rows / max(1, labels.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
    # bounded by max_rows
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    truths = [f"y_{k}" for k in categories]
    names = ["doc_id", "text", *truths]

    def least(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text", 1 << 20):
            hashes, at = shingle_hashes(hash_words(batch.column("text")), 5)
            out = np.full(batch.num_rows, np.iinfo(np.uint64).max)
            np.minimum.at(out, at, mix(hashes))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out.view(np.int64))], [*names, "least"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema), "least bigint"])
    return (rows.select(*names).mapInArrow(least, schema).groupBy("least")
            .agg(F.min(F.struct("doc_id", *truths, "text")).alias("r")).select("r.*"))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], folder: str,
              max_rows: int = MAX_ROWS) -> list[Link]:
    """Train the chain for ``categories`` (name -> condition over ``labels``), in their order.

    ``folder`` is a new path in a shared folder; the sample is written there. Labels of unknown ids, null ids and null
    values are left out; without labelled rows of both kinds a category gets a model that answers zero.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample_rows(docs, labels, categories, max_rows).write.parquet(folder)
    sample = spark.read.parquet(folder)
    names = list(categories)
    counts = _count_signs(sample, names)
    data = None
    links: list[Link] = []
    chosen = {k: _choose(counts, sample, k) for k in names}
    data = _design(sample, names, chosen)
    earlier = np.zeros((len(data["fold"]), 0))
    for k in names:
        truth, (rows, index) = data["truth"][k], data["signs"][k]
        known = ~np.isnan(truth)
        dense = np.hstack([data["shares"], earlier])
        out_of_fold = np.zeros(len(truth))
        fit = lambda keep: _fit_rows(rows, index, len(chosen[k]), dense, truth, keep)
        for fold in range(FOLDS if k != names[-1] else 0):
            w, v, b = fit(known & (data["fold"] != fold))
            here = data["fold"] == fold
            z = np.bincount(rows, w[index], minlength=len(truth)) + dense @ v + b
            out_of_fold[here] = _sigmoid(z)[here]
        w, v, b = fit(known)
        links.append(Link(k, chosen[k], w, v, b))
        earlier = np.hstack([earlier, out_of_fold[:, None]])
    return links


def _fit_rows(rows, index, width, dense, truth, keep):
    if not keep.any() or truth[keep].min() == truth[keep].max():
        return np.zeros(width), np.zeros(dense.shape[1]), -30.0
    place = np.cumsum(keep) - 1
    here = keep[rows]
    return _train(place[rows[here]], index[here], width, dense[keep], truth[keep])


def _count_signs(sample: DataFrame, names: list[str]) -> DataFrame:
    """Per sign: the sampled texts that have it, and those of each category."""
    truths = [f"y_{k}" for k in names]

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text", 1 << 20):
            rows, hashes = _signs(batch.column("text"))
            order = np.argsort(hashes, kind="stable")
            hashes, rows = hashes[order], rows[order]
            at = group_starts(hashes)
            sums = lambda x: pa.array(np.add.reduceat(x[rows], at) if len(at) else np.zeros(0))
            made = [np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in truths]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), sums(np.ones(batch.num_rows)), *map(sums, made)],
                                             ["sign", "n", *truths])

    made = sample.mapInArrow(count, ", ".join(["sign bigint", "n double", *(f"`{t}` double" for t in truths)]))
    return made.groupBy("sign").agg(F.sum("n").alias("n"), *(F.sum(t).alias(t) for t in truths)).filter("n >= 4").persist()


def _choose(counts: DataFrame, sample: DataFrame, name: str, alpha: float = 0.01) -> np.ndarray:
    """Signs that stand in significantly more texts of the category (likelihood ratio, Bonferroni bound), sorted."""
    y = f"y_{name}"
    total, ones = sample.agg(F.count(y), F.sum(y)).first()
    if not ones or ones == total:
        return np.zeros(0, np.uint64)
    rate = ones / total
    bound = 2 * np.log(max(1, counts.count()) / alpha)
    n, a = F.col("n"), F.least(F.col(y), F.col("n"))
    part = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    best = (counts.withColumn("gain", 2 * (part(a, rate) + part(n - a, 1 - rate)))
            .filter((F.col("gain") > bound) & (a > n * rate)).orderBy(F.desc("gain"), "sign").limit(MAX_SIGNS).select("sign"))
    return np.sort(np.array([r.sign for r in best.collect()], np.int64).view(np.uint64))


def _design(sample: DataFrame, names: list[str], chosen: dict[str, np.ndarray]) -> dict:
    """The sample's signs, shares, truths and folds, on the driver: at most MAX_ROWS rows of a few signs."""
    tables = {k: _marks(v) for k, v in chosen.items()}
    schema = ", ".join(["doc_id bigint", *(f"`{c}` double" for c in _SHARES), *(f"`y_{k}` double" for k in names),
                        *(f"`s_{k}` array<int>" for k in names)])

    def make(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text", 1 << 20):
            rows, hashes = _signs(batch.column("text"))
            lists = []
            for k in names:
                at, index = _look_up(chosen[k], tables[k], hashes)
                sizes = np.bincount(rows[at], minlength=batch.num_rows)
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                                      pa.array(index.astype(np.int32))))
            shares = _shares(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(shares[:, i]) for i in range(len(_SHARES))),
                 *(batch.column(f"y_{k}") for k in names), *lists],
                ["doc_id", *_SHARES, *(f"y_{k}" for k in names), *(f"s_{k}" for k in names)])

    got = sample.mapInArrow(make, schema).toArrow().sort_by("doc_id").combine_chunks()
    column = lambda c: got.column(c).combine_chunks() if got.num_rows else got.column(c)
    out = {"truth": {k: got.column(f"y_{k}").to_pandas().to_numpy(float) for k in names}, "signs": {}}
    out["shares"] = np.stack([got.column(c).to_numpy() for c in _SHARES], 1) if got.num_rows else np.zeros((0, len(_SHARES)))
    ids = got.column("doc_id").to_numpy().astype(np.int64).view(np.uint64)
    out["fold"] = (mix(ids) % np.uint64(FOLDS)).astype(int)
    for k in names:
        lists = got.column(f"s_{k}").to_pylist()
        sizes = [len(x) for x in lists]
        out["signs"][k] = (np.repeat(np.arange(len(lists)), sizes), np.array([i for x in lists for i in x], np.int64))
    return out


def score(docs: DataFrame, links: list[Link], threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with ``p_<category>`` for every category of the chain and a boolean named after the last one.

    The boolean is true where the last probability reaches ``threshold``. A null text counts as empty; an empty text
    shows no signs. Columns of ``docs`` with the new names are replaced; rows and other columns stay.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(links)
    names = [f"p_{link.name}" for link in links]
    last = links[-1].name
    kept = [c for c in docs.columns if c not in {*names, last}]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept),
                        *(f"`{c}` double" for c in names), f"`{last}` boolean"])

    def run(batches: Iterator[pa.RecordBatch]):
        chain = [(link, _marks(link.signs)) for link in shared.value]
        for batch in slices(batches, text, 1 << 20):
            column, n = batch.column(text), batch.num_rows
            words = hash_words(column)
            parts = [(words.rows, words.hashes), *((words.rows[some], made) for some, made in prefix_hashes(words, PREFIXES))]
            shares, found = _shares(column), []
            for link, table in chain:
                z = np.full(n, link.bias)
                rows, index = [], []
                for at_rows, hashes in parts:
                    at, i = _look_up(link.signs, table, hashes)
                    rows.append(at_rows[at])
                    index.append(i)
                pairs = np.unique(np.concatenate(rows).astype(np.int64) * (len(link.signs) + 1) + np.concatenate(index))
                rows, index = pairs // (len(link.signs) + 1), pairs % (len(link.signs) + 1)
                z += np.bincount(rows, link.weights[index], minlength=n)
                z += np.hstack([shares, *(p[:, None] for p in found)]) @ link.dense
                found.append(_sigmoid(z))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, found), pa.array(found[-1] >= threshold)],
                                             [*kept, *names, last])

    return docs.mapInArrow(run, schema)
