"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification.

A document is a weighted set of word shingles. Over every element lies a half-plane of weight and rank in which darts
are thrown at random, one per unit of area on average, by hashes of the element alone. The darts that fall within an
element's weight, earliest rank first, each hit one coordinate of the signature, and a coordinate keeps its earliest
dart. Two sets agree on a coordinate with a probability that is their weighted Jaccard similarity. The darts needed
depend on the length of the signature, not on the weights.

Documents whose bands agree meet in buckets. A bucket compares its members with its first and last one only. Then
components are formed, and members outside the component of the bucket's first meet all members of other components. So
every two candidates are either compared or known to be linked already, while a group of thousands of near copies costs
two comparisons each. Before texts are compared, the size and a parity sketch of 1024 bits rule out most pairs that are
not similar enough, and none that is. Equal word sequences count as one document until the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.llm.components import components
from lotscope.llm.line_dedup import in_filter, wanted_filter
from lotscope.llm.words import Words, distinct, group_starts, hash_words, mix, shingle_hashes, slices
from lotscope.llm.tables import drop_table, small_batches, through_table
from lotscope.plans.lineage import new_folder

SHINGLE, SIMILARITY = 5, 0.8
#: 26 bands of 5 coordinates: two sets of similarity 0.8 share no band with a probability of 0.00003.
BANDS, PER_BAND = 26, 5
#: Bits of the parity sketch of a set of shingles, in words of 64.
PARITY = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 24)]))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def signatures(elements: np.ndarray, rows: np.ndarray, n_rows: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """DartMinHash signatures, one row of ``k`` dart hashes each; rows without elements keep zeros.

    ``weights`` are non-negative and best of the order of one; without them every element weighs one, and repeated
    elements count once.
    """
    out = np.zeros((n_rows, k), np.uint64)
    total = np.bincount(rows, weights, minlength=n_rows)
    darts = np.full(n_rows, k * (np.log(k) + 3))
    todo = total > 0
    while todo.any():
        here = todo[rows] if weights is None else todo[rows] & (weights > 0)
        _throw(elements[here], rows[here], None if weights is None else weights[here], darts / np.maximum(total, 1e-300), k, out, todo)
        darts *= 2  # some coordinate got no dart: throw up to twice the rank
    return out


def _throw(elements, rows, weights, limit, k, out, todo):
    """One round up to rank ``limit`` of each row; rows that fill all coordinates are written and no longer ``todo``."""
    wide = np.ones(len(rows), np.int64) if weights is None else np.ceil(weights).astype(np.int64)
    high = np.ceil(limit[rows]).astype(np.int64)
    cells = wide * high
    of = np.repeat(np.arange(len(rows)), cells)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    column, level = nth // high[of], nth % high[of]
    seed = mix(elements[of] + mix(column.astype(np.uint64) * np.uint64(2) + np.uint64(1)) + level.astype(np.uint64) * _ODD)
    number = np.searchsorted(_POISSON, _unit(seed), "right")
    cell = np.repeat(np.arange(len(of)), number)
    nth = np.arange(len(cell)) - np.repeat(np.cumsum(number) - number, number)
    dart = mix(seed[cell] + (nth + 1).astype(np.uint64) * _ODD)
    source = of[cell]
    rank = level[cell] + _unit(mix(dart ^ _ODD))
    keep = rank <= limit[rows[source]]
    if weights is not None:
        keep &= column[cell] + _unit(mix(dart + _ODD)) <= weights[source]
    dart, rank, at = dart[keep], rank[keep], rows[source][keep]
    slot = at * k + ((dart >> np.uint64(20)) % np.uint64(k)).astype(np.int64)
    best = np.full(len(out) * k, np.inf)
    np.minimum.at(best, slot, rank)
    won = rank == best[slot]
    ids = np.zeros(len(out) * k, np.uint64)
    ids[slot[won]] = dart[won]
    full = todo & np.isfinite(best.reshape(-1, k)).all(1)
    out[full] = ids.reshape(-1, k)[full]
    todo &= ~full


def _sequence_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the word sequence of every row; zero for rows without words."""
    n = len(words.offsets) - 1
    first = np.searchsorted(words.rows, np.arange(n))
    place = (np.arange(len(words.rows)) - first[words.rows]).astype(np.uint64)
    a, b = mix(words.hashes + place * _ODD), mix(words.hashes ^ mix(place + np.uint64(1)))
    out = np.zeros((2, n), np.uint64)
    at = group_starts(words.rows)
    if len(at):
        out[:, words.rows[at]] = np.add.reduceat(a, at), np.add.reduceat(b, at)
    return out[0], out[1]


def _parities(elements: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct elements of every row (at most 512 rows), and the parity of how many fall on each bit.

    Two sets differ in at least as many elements as their parities differ in bits.
    """
    packed = distinct((rows.astype(np.uint64) << np.uint64(55)) | (elements >> np.uint64(9)))
    row = (packed >> np.uint64(55)).astype(np.int64)
    bit = mix(packed & np.uint64((1 << 55) - 1)) % np.uint64(PARITY * 64)
    slot = row * PARITY + (bit >> np.uint64(6)).astype(np.int64)
    out = np.zeros(n_rows * PARITY, np.uint64)
    np.bitwise_xor.at(out, slot, np.uint64(1) << (bit & np.uint64(63)))
    return np.bincount(row, minlength=n_rows), out


def sketches(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, per_band: int = PER_BAND) -> DataFrame:
    """Node, id, word-sequence hashes, number of shingles, parity sketch and band hashes of every document that has words."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text", 1 << 20, 512):  # a short text takes as many darts as one of a thousand words
            words = hash_words(batch.column("text"))
            elements, rows = shingle_hashes(words, shingle)
            sig = signatures(elements, rows, batch.num_rows, bands * per_band).reshape(-1, bands, per_band)
            acc = np.tile(np.arange(bands, dtype=np.uint64), (batch.num_rows, 1))
            for i in range(per_band):
                acc = mix(acc * _ODD + sig[:, :, i])
            f1, f2 = _sequence_hashes(words)
            some = np.flatnonzero(np.bincount(words.rows, minlength=batch.num_rows))
            number, parity = _parities(elements, rows, batch.num_rows)
            listed = lambda x, n: pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * n),
                                                           pa.array(x.reshape(-1, n)[some].reshape(-1).view(np.int64)))
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(take), batch.column("doc_id").take(take), pa.array(f1[some].view(np.int64)),
                 pa.array(f2[some].view(np.int64)), pa.array(number[some].astype(np.int32)), listed(parity, PARITY), listed(acc, bands)],
                ["node", "doc_id", "f1", "f2", "n", "parity", "bands"])

    return docs.select("node", "doc_id", "text").mapInArrow(
        run, "node bigint, doc_id bigint, f1 bigint, f2 bigint, n int, parity array<bigint>, bands array<bigint>")


def _may_match(a: str, b: str, similarity: float):
    """Whether sizes and parity sketches of two structs allow the similarity; what it rules out is never similar."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = F.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
    differ = sum((F.bit_count(F.get(F.col(f"{a}.parity"), F.lit(i)).bitwiseXOR(F.get(F.col(f"{b}.parity"), F.lit(i)))) for i in range(PARITY)), F.lit(0))
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9) & (differ <= n + m - 2 * need)


def verify(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the ``pairs`` (a, b: nodes) whose sets of shingles have the Jaccard similarity asked for."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("place")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(wanted_filter(nodes))

    def sets(batches: Iterator[pa.RecordBatch]):
        table = shared.value
        for batch in slices(batches, "text"):
            node = batch.column("node").to_numpy().view(np.uint64)
            batch = batch.filter(pa.array(in_filter(table, node)))
            if not batch.num_rows:
                continue
            elements, rows = shingle_hashes(hash_words(batch.column("text")), shingle)
            order = np.argsort(rows, kind="stable")
            ends = np.searchsorted(rows[order], np.arange(batch.num_rows + 1))
            elements = elements[order]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([distinct(elements[i:j]).tobytes() for i, j in zip(ends, ends[1:])], pa.binary())],
                ["node", "shingles"])

    made = (docs.select("node", "text").mapInArrow(sets, "node bigint, shingles binary")
            .join(nodes.withColumnRenamed("place", "node"), "node", "left_semi").dropDuplicates(["node"]))
    both = pairs.join(made.toDF("b", "y"), "b").join(made.toDF("a", "x"), "a")

    def compare(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "x", 1 << 22):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                n, m = len(x) // 8, len(y) // 8
                if min(n, m) < similarity * max(n, m) - 1e-9:
                    keep.append(False)
                    continue
                union = len(distinct(np.frombuffer(x + y, np.uint64)))
                keep.append(n + m - union >= similarity * union - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS,
                    per_band: int = PER_BAND) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id``, ``node`` (a hash of the row), ``class_id`` and ``first``.

    ``class_id`` is the least doc_id of the documents that similarities of at least ``similarity`` connect; ``first`` is
    true for one row of each class, by doc_id and node (repeated rows share it). Null and empty texts, texts without
    words, and rows without an id are classes of their own. A text of fewer words than a shingle has one shingle.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("node", F.xxhash64("doc_id", "text"))
    folder = new_folder(docs.sparkSession, "near")
    known = docs.filter("doc_id is not null and text is not null")
    made = through_table(sketches(known, shingle, bands, per_band), f"{folder}/sketches")
    # one node per word sequence
    texts = made.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "node", "n", "parity", "bands")).alias("r"))
    texts = through_table(texts.select("f1", "f2", "r.*"), f"{folder}/texts")
    sketch = texts.select("node", F.struct("n", "parity").alias("s"))
    entries = texts.select(F.struct("doc_id", "node").alias("e"), F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.min("e").alias("lo"), F.max("e").alias("hi"), F.count("*").alias("n")).filter("n > 1")
    members = through_table(entries.join(buckets, "bucket").select(
        "bucket", F.col("e.node").alias("node"), F.col("lo.node").alias("first"), F.col("hi.node").alias("last"), "n"), f"{folder}/buckets")
    # every member of a bucket meets its first and its last document
    pairs = members.select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array("first", "last"))).alias("b")).filter("a <> b")
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = (pairs.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b").filter(_may_match("sa", "sb", similarity)).select("a", "b"))
    links = through_table(verify(known, through_table(pairs, f"{folder}/pairs"), shingle, similarity), f"{folder}/links")
    # what a bucket holds outside its first one's component meets the members of other components
    roots = components(links)
    several = members.filter("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = roots.select(F.col("node").alias("first"), F.col("root").alias("main"))
    several = several.join(main, "first", "left").withColumn("main", F.coalesce("main", "first")).filter("node not in (first, last)")
    several = several.join(sketch, "node")
    outside = several.filter("root <> main").select("bucket", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("s").alias("sa"))
    inside = several.select("bucket", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("main").alias("mb"), F.col("s").alias("sb"))
    more = outside.join(inside, (outside["bucket"] == inside["bucket"]) & (F.col("ra") != F.col("rb"))
                        & ((F.col("rb") == F.col("mb")) | (F.col("a") < F.col("b"))) & _may_match("sa", "sb", similarity))
    more = through_table(more.select("a", "b").distinct(), f"{folder}/more")
    if not more.isEmpty():
        roots = components(links.unionByName(through_table(verify(known, more, shingle, similarity), f"{folder}/more-links")))
    for name in ("buckets", "pairs", "more"):
        drop_table(docs.sparkSession, f"{folder}/{name}")
    classes = texts.join(roots, "node", "left").select("f1", "f2", "doc_id", "node", F.coalesce("root", "node").alias("root"))
    heads = classes.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("head"))
    classes = classes.join(heads, "root").select("f1", "f2", "head")
    found = made.select("node", "f1", "f2").distinct().join(classes, ["f1", "f2"]).select("node", "head")
    return (docs.select("doc_id", "node").join(found, "node", "left")
            .select("doc_id", "node", F.coalesce("head.doc_id", "doc_id").alias("class_id"),
                    F.coalesce(F.col("head.node") == F.col("node"), F.lit(True)).alias("first")))
