"""SimHash fingerprints of documents, and all pairs of fingerprints at a small Hamming distance by vantage-point trees.

A fingerprint has 64 bits; a bit is the majority among the hashes of a text's word shingles. Distinct fingerprints are
joined; how many documents share one plays no part.

Two fingerprints that differ in at most r bits differ in at most r // 2 bits of the lower or of the upper half. So the
pairs are looked for in two trees, one for each half: a node has a vantage point and a radius, measures the distance on
its half, and the triangle bound there is r // 2 instead of r. Fingerprints within the radius go inside, the others
outside, and those outside that are no further than the bound beyond the radius go inside as well. Then every pair that
a tree answers for meets in a leaf: where a node parts the two, the outer one lies within the bound. Where a node of
the tree cannot part its points by its half it measures all 64 bits, with the bound r.

A tree for routing is fitted on a bounded sample and shared with all tasks; its leaves are shards. A shard is held by
one task as an array of eight bytes a fingerprint, goes on with a tree of its own, and compares points of a leaf. Of a
leaf only the links that connect its components are returned, so a dense group never expands into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.llm.components import components
from lotscope.llm.tables import through_table
from lotscope.llm.words import as_text, slices
from lotscope.plans.lineage import new_folder

SHINGLE, RADIUS, SEED = 3, 3, 42
HALVES = (0x00000000FFFFFFFF, 0xFFFFFFFF00000000)
ALL = 0xFFFFFFFFFFFFFFFF
#: Fingerprints of a tree's sample at most, points of a shard that the routing tree aims at, and of a leaf in a shard.
SAMPLE, SHARD, LEAF = 1 << 17, 1 << 13, 384
#: A node must save this share of the comparisons of its points, or stays a leaf.
GAIN = 0.9
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
#: For every byte, eight lanes of a word that hold its bits.
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def shingles(text: bytes, n: int = SHINGLE) -> Iterator[bytes]:
    """Runs of ``n`` words of a text with A-Z in lower case, joined by a space; the whole of a shorter one, none of an empty one."""
    words = text.translate(_FOLD).split()
    if len(words) <= n:
        yield from [b" ".join(words)] if words else []
        return
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    for a, b in zip(starts[:len(words) - n + 1].tolist(), ends[n - 1:].tolist()):
        yield line[a:b]


def majority(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """For every row the bits that are set in over half of its hashes (``rows`` ascending); zero for rows without any."""
    out = np.zeros(n_rows, np.uint64)
    if not len(hashes):
        return out
    # eight counters in one word hold up to 255 hashes, so rows are cut into runs of 255
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    run = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]) | (place % 255 == 0))
    of, some = rows[run], np.bincount(rows, minlength=n_rows)
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    parts = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        lanes = np.add.reduceat(_LANES[parts[:, byte]], run).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        bits = (2 * ones > some[of[first], None]).astype(np.uint64) << np.arange(8, dtype=np.uint64)
        out[of[first]] |= bits.sum(1) << np.uint64(8 * byte)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a bigint) of every row of ``docs`` (doc_id, text); other columns are left out.

    A text without words, or null, has the fingerprint zero.
    """
    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in slices(batches, "text", 1 << 20):
            found = [np.fromiter((digest(s, seed) for s in shingles(t.as_buffer().to_pybytes(), shingle)), np.uint64)
                     for t in as_text(batch.column("text")).cast(pa.large_binary())]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            fp = majority(np.concatenate(found), rows, len(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


class Node(NamedTuple):
    """Points within ``radius`` of ``vantage`` on the bits of ``mask`` go inside, those up to ``bound`` further as well."""
    vantage: np.uint64
    mask: np.uint64
    bound: int
    radius: int
    inside: int  # number of the node, or the leaf number less than zero: ~leaf
    outside: int


def _split(points: np.ndarray, half: int, radius: int, chance: np.random.Generator) -> tuple | None:
    """Vantage point, mask, bound and radius that leave the fewest comparisons, or none if no node is worth it."""
    probe = points if len(points) <= 4096 else chance.choice(points, 4096, replace=False)
    n, best, out = len(probe), GAIN, None
    for mask, bound, tries in ((half, radius // 2, 6), (ALL, radius, 2)):
        mask = np.uint64(mask)
        for vantage in chance.choice(probe, min(tries, n), replace=False):
            upto = np.cumsum(np.bincount(np.bitwise_count((probe ^ vantage) & mask), minlength=65))
            inner, outer = upto[np.minimum(np.arange(65) + bound, 64)] / n, 1 - upto / n
            cost = np.where(outer > 0, inner ** 2 + outer ** 2, 2.0)
            at = int(np.argmin(cost))
            if cost[at] < best:
                best, out = cost[at], (vantage, mask, bound, at)
        if out is not None:
            break
    return out


def _parts(points: np.ndarray, node) -> tuple[np.ndarray, np.ndarray]:
    distance = np.bitwise_count((points ^ node[0]) & node[1])
    return distance <= node[3] + node[2], distance > node[3]


def fit_tree(sample: np.ndarray, total: int, half: int, radius: int = RADIUS, shard: int = SHARD) -> list[Node]:
    """A tree over a sample of ``total`` distinct fingerprints; a leaf should get about ``shard`` of them.

    An empty list is a tree of one leaf. The sample's size bounds the tree: no leaf has less than 16 points of it.
    """
    chance, nodes, leaves = np.random.default_rng(1), [], 0

    def grow(points: np.ndarray) -> int:
        nonlocal leaves
        found = _split(points, half, radius, chance) if len(points) >= 32 and len(points) * total > shard * len(sample) else None
        if found is None:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(None)
        inner, outer = _parts(points, found)
        nodes[at] = Node(*found, grow(points[inner]), grow(points[outer]))
        return at

    grow(sample)
    return nodes


def route(nodes: list[Node], points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Leaf numbers, and which of the points go there."""
    todo = [(0 if nodes else -1, np.arange(len(points)))]
    while todo:
        at, some = todo.pop()
        if at < 0:
            yield ~at, some
        elif len(some):
            inner, outer = _parts(points[some], nodes[at])
            todo += [(nodes[at].inside, some[inner]), (nodes[at].outside, some[outer])]


def _chains(points: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect the components of a leaf.

    Every point is compared with those that no link has reached yet, so a group of near copies is left after few steps.
    """
    rest = points
    while len(rest):
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            some = frontier[:max(1, (1 << 20) // len(rest))]
            frontier = frontier[len(some):]
            near = np.bitwise_count(some[:, None] ^ rest[None, :]) <= radius
            hit = near.any(0)
            if hit.any():
                new = rest[hit]
                yield some[np.argmax(near[:, hit], 0)], new
                frontier, rest = np.concatenate([frontier, new]), rest[~hit]


def _leaf_links(points: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``_chains``, after points that are close to no other one are left out in one step."""
    if len(points) <= 4 * LEAF:
        near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
        points = points[near.sum(1) > 1]
    yield from _chains(points, radius)


def shard_links(points: np.ndarray, half: int, radius: int = RADIUS, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Links between distinct points of a shard whose components are those of all pairs that the shard answers for."""
    chance, todo, found = np.random.default_rng(2), [points], []
    while todo:
        some = todo.pop()
        node = _split(some, half, radius, chance) if len(some) > leaf else None
        if node is None:
            found += list(_leaf_links(some, radius))
        else:
            inner, outer = _parts(some, node)
            todo += [some[inner], some[outer]]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(map(np.concatenate, zip(*found)))


def links(distinct: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (``fp``, bigint), each of at most ``radius`` differing bits.

    Their connected components are those of all pairs at that distance. ``sample`` bounds the fingerprints that the
    routing trees are fitted on; every fingerprint is routed. ``distinct`` should be a table.
    """
    spark, total = distinct.sparkSession, distinct.count()
    # about the wanted number, by hash: the same rows however the table is cut
    share = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.9 * sample / max(1, total)))
    taken = np.array([r.fp for r in distinct.filter(share).limit(sample).collect()], np.int64).view(np.uint64)
    trees = spark.sparkContext.broadcast([fit_tree(np.sort(taken), total, half, radius, shard) for half in HALVES])

    def send(batches):
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            for tree, nodes in enumerate(trees.value):
                for leaf, some in route(nodes, points):
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), 2 * leaf + tree)), pa.array(points[some].view(np.int64))], ["shard", "fp"])

    def meet(key, table):
        a, b = shard_links(table.column("fp").to_numpy().view(np.uint64), HALVES[key[0].as_py() % 2], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = distinct.select("fp").mapInArrow(send, "shard bigint, fp bigint")
    return routed.groupBy("shard").applyInArrow(meet, "a bigint, b bigint").distinct()


def near_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``docs`` (doc_id, text).

    Documents are linked where their fingerprints differ in at most ``radius`` bits; ``component_id`` is the least id
    that links reach, the own one included. Rows without an id take part and count for nothing in that minimum. Empty
    tables give empty results.
    """
    folder = new_folder(docs.sparkSession, "simhash")
    made = through_table(fingerprints(docs, shingle, seed), f"{folder}/fingerprints")
    distinct = through_table(made.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{folder}/distinct")
    found = through_table(links(distinct, radius), f"{folder}/links")
    roots = components(found).toDF("fp", "root")
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return made.join(placed.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
