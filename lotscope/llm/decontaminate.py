"""Benchmark decontamination by spaced seeds.

A mask picks four words out of a few that follow each other and ignores the rest. Every window of a benchmark item and
of a document is hashed under every mask, so a substituted word at an ignored place changes nothing. Equal hashes are
hits; around each, words are compared one by one along the same alignment. A document holds a benchmark passage if
``WINDOW`` words in a row, or the whole of a shorter item, agree in at least ``similarity`` of their places. The masks
hit every such window, wherever its substitutions are. Items too short for that must stand in the document word by word.

The hashes of the benchmark are spread over tasks in blocks of about ``BLOCK_WORDS`` words, each a table of bounded size
that the documents pass by; documents are neither shuffled nor joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.llm.tables import small_batches
from lotscope.llm.words import hash_words, mix, slices

WINDOW, SIMILARITY = 13, 0.8
#: Items of fewer words than the first number are compared as wholes, word by word; those of fewer than the second are
#: no evidence, as any text may hold them, and match nothing.
LEAST_WORDS, EVIDENCE = 8, 5
# The places of a window that each mask looks at.
MASKS = ((0, 1, 2, 4), (0, 1, 4, 5))
BLOCK_WORDS = 500_000
_FACTORS = mix(np.arange(11, 15, dtype=np.uint64)) | np.uint64(1)


def seeds(hashes: np.ndarray, rows: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every whole window under one mask, and the index of its first word."""
    places = MASKS[mask]
    n = len(hashes) - places[-1]
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.full(n, np.uint64(mask + 1))
    for place, factor in zip(places, _FACTORS):
        acc += hashes[place:place + n] * factor
    start = np.flatnonzero(rows[:n] == rows[places[-1]:])
    return mix(acc[start]), start


def _whole(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, whichever rows they are in."""
    acc = np.full(max(0, len(hashes) - n + 1), np.uint64(n))
    for i in range(n if len(acc) else 0):
        acc = mix(acc + hashes[i:len(hashes) - n + 1 + i])
    return acc


class Block:
    """Words of some benchmark items and their seeds in order of hash."""

    def __init__(self, items: pa.Table):
        words = hash_words(items.column("text").combine_chunks() if items.num_rows else pa.array([], pa.string()))
        sizes = np.bincount(words.rows, minlength=items.num_rows)
        self.short = []  # length, hashes in order and items of those that are compared as wholes
        for n in range(EVIDENCE, LEAST_WORDS):
            some = np.flatnonzero(sizes == n)
            made = _whole(words.hashes, n)[np.searchsorted(words.rows, some)] if len(some) else np.zeros(0, np.uint64)
            order = np.argsort(made, kind="stable")
            self.short.append((n, made[order], some[order]))
        keep = sizes[words.rows] >= LEAST_WORDS
        self.hashes, self.items = words.hashes[keep], words.rows[keep]
        self.ids = items.column("item_id").combine_chunks() if items.num_rows else pa.array([], pa.int64())
        self.ends = np.searchsorted(self.items, np.arange(items.num_rows), "right")
        self.starts = np.searchsorted(self.items, np.arange(items.num_rows), "left")
        found = [seeds(self.hashes, self.items, m) for m in range(len(MASKS))]
        hashes, places = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.argsort(hashes, kind="stable")
        self.seeds, self.places = hashes[order], places[order]
        self.marks = np.zeros(1 << 22, bool)
        self.marks[self.seeds >> np.uint64(42)] = True

    def hits(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a word in the documents and one in the benchmark at which equal seeds begin."""
        mine, theirs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for mask in range(len(MASKS)):
            made, start = seeds(hashes, rows, mask)
            some = np.flatnonzero(self.marks[made >> np.uint64(42)])
            low, high = np.searchsorted(self.seeds, made[some], "left"), np.searchsorted(self.seeds, made[some], "right")
            count = high - low
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            mine.append(np.repeat(start[some], count))
            theirs.append(self.places[np.repeat(low, count) + nth])
        return np.concatenate(mine), np.concatenate(theirs)

    def overlaps(self, hashes: np.ndarray, rows: np.ndarray, n_rows: int, similarity: float):
        """Row, item, first and last word (within the row) and best share of equal words of all verified overlaps."""
        mine, theirs = self.hits(hashes, rows)
        ends = np.searchsorted(rows, np.arange(n_rows), "right")
        begins = np.searchsorted(rows, np.arange(n_rows), "left")
        out = []
        for at in range(0, len(mine), 100_000):
            out.append(self._verify(hashes, rows, begins, ends, mine[at:at + 100_000], theirs[at:at + 100_000], similarity))
        out += [self._wholes(hashes, rows, begins, *s) for s in self.short if len(s[1])]
        row, item, first, last, share = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        order = np.lexsort((item, row))
        row, item, first, last, share = row[order], item[order], first[order], last[order], share[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])])) if len(row) else []
        if not len(row):
            return row, item, first, last, share
        return (row[new], item[new], np.minimum.reduceat(first, new), np.maximum.reduceat(last, new), np.maximum.reduceat(share, new))

    def _wholes(self, hashes, rows, begins, n: int, made: np.ndarray, items: np.ndarray):
        """Where the documents hold items of ``n`` words whole."""
        mine = _whole(hashes, n)
        low, high = np.searchsorted(made, mine, "left"), np.searchsorted(made, mine, "right")
        inside = np.flatnonzero((high > low) & (rows[:len(mine)] == rows[n - 1:])) if len(mine) else np.zeros(0, np.int64)
        count = (high - low)[inside]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(inside, count)
        first = at - begins[rows[at]]
        return rows[at], items[np.repeat(low[inside], count) + nth], first, first + n - 1, np.ones(len(at))

    def _verify(self, hashes, rows, begins, ends, mine, theirs, similarity):
        item, row = self.items[theirs], rows[mine]
        size = self.ends[item] - self.starts[item]
        width = np.minimum(WINDOW, size)
        need = np.ceil(similarity * width - 1e-9).astype(np.int64)
        span = max(m[-1] for m in MASKS) + 1
        shift = np.arange(-(WINDOW - 1), WINDOW + span)  # all places of windows that hold the seed
        x, y = mine[:, None] + shift, theirs[:, None] + shift
        inside = (x >= begins[row][:, None]) & (x < ends[row][:, None]) & (y >= self.starts[item][:, None]) & (y < self.ends[item][:, None])
        in_item = (y >= self.starts[item][:, None]) & (y < self.ends[item][:, None])
        equal = inside & (hashes[np.clip(x, 0, len(hashes) - 1)] == self.hashes[np.clip(y, 0, len(self.hashes) - 1)])
        sums = np.concatenate([np.zeros((len(mine), 1), np.int64), np.cumsum(equal, 1)], 1)
        whole = np.concatenate([np.zeros((len(mine), 1), np.int64), np.cumsum(in_item, 1)], 1)
        start = np.arange(len(shift))
        stop = np.minimum(start + width[:, None], len(shift))
        take = lambda a: np.take_along_axis(a, stop, 1) - a[:, :-1]
        agree = np.where(take(whole) == width[:, None], take(sums), 0)  # windows lie within the item
        good = agree >= need[:, None]
        some = np.flatnonzero(good.any(1))
        good, agree = good[some], agree[some]
        first = good.argmax(1)
        last = good.shape[1] - 1 - good[:, ::-1].argmax(1)
        base = mine[some] - (WINDOW - 1) - begins[row[some]]
        length = ends[row[some]] - begins[row[some]]
        return (row[some], item[some], np.maximum(0, base + first), np.minimum(length, base + last + width[some]) - 1,
                agree.max(1) / width[some])


def overlaps(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``overlaps``: item_id, first_word, last_word and the best share of equal words of each item found.

    Null texts, on either side, hold nothing; repeated rows all get their overlaps; repeated items are reported each.
    A column of ``docs`` named ``overlaps`` is replaced.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-total * 5 // (4 * block_words)))
    spark = docs.sparkSession
    small_batches(spark)
    kept = [c for c in docs.columns if c != "overlaps"]
    out = docs.select(*kept).withColumn("overlaps", F.expr(
        "cast(array() as array<struct<item_id:bigint,first_word:int,last_word:int,share:double>>)"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for i in range(blocks):  # each of a bounded size; the documents pass all of them in one job
        shared = spark.sparkContext.broadcast(Block(items.filter(block == i).toArrow()))
        out = out.mapInArrow(_pass_by(shared, kept, similarity), schema)
    return out


def _pass_by(shared, kept: list[str], similarity: float):
    def run(batches: Iterator[pa.RecordBatch]):
        block = shared.value
        for batch in slices(batches, "text"):
            words = hash_words(batch.column("text"))
            row, item, first, last, share = block.overlaps(words.hashes, words.rows, batch.num_rows, similarity)
            new: dict[int, list] = {}
            for r, *rest in zip(row.tolist(), block.ids.take(pa.array(item)).to_pylist(), first.tolist(), last.tolist(), share.tolist()):
                new.setdefault(r, []).append(dict(zip(("item_id", "first_word", "last_word", "share"), rest)))
            before = batch.column("overlaps")
            lists = [old + new.get(i, []) for i, old in enumerate(before.to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lists, before.type)], [*kept, "overlaps"])

    return run
