"""Exact similarity against reference banks, reduced to per-group maxima inside the tasks.

Queries are cut into blocks by a hash of their ids, the bank into parts that hold whole groups and are alike in size; a
task has one block and one part. With few blocks and few parts a vector is copied a few times only; a bank that a large
group keeps from being cut evenly has fewer parts and meets more blocks. The part passes by the block once, in order of
its groups, so a task returns the final best reference per query and group, and neither the similarity matrix nor a
partial maximum ever leaves it. Products are made in single precision first; only references that its error leaves a
chance, a few for a query and group, are multiplied again in doubles, and those decide.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope import settings as S
from lotscope.plans.ranked import first_by, top_k

BLOCK = 1 << 18  # queries of a task at most
TASKS = 24  # query blocks times parts of the bank, until blocks would hold more than BLOCK queries
PARTS = (6, 4, 3, 2)  # parts of the bank, the first that cuts it evenly; there are TASKS / parts copies of the bank
UNEVEN = 1.2  # the largest part of the bank, as a multiple of the mean
HEAVY = 256  # groups that get their part by size, the others by hash
CELLS = 1 << 23  # maxima (query and group) that a task holds at a time
CHUNK = 2048  # references that a task multiplies at a time
STRIP = 256  # queries that a task multiplies at a time
DIGITS = 12  # similarities are rounded, so that summation order can never decide a rank
UNIT = 2.0 ** -24  # relative error of a single-precision operation
LONG = 1e30  # products of longer vectors are made in doubles from the start
DENSE = 16  # from one in so many pairs on, all pairs of a query are multiplied again


def best_sims(queries: DataFrame, bank: DataFrame, groups: list[str], exclude_same: bool = False, block: int = BLOCK,
              payload: tuple[str, ...] = (), n_queries: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Best similarity per query and bank group, with the reference that reached it (lowest id on ties).

    ``queries``: (q, embedding, and optionally ``years`` or ``wanted``). ``bank``: (ref_id, *groups, embedding, the
    ``payload`` columns of a winner to return, and optionally ``shift``, added to each similarity). ``exclude_same``
    leaves a query's own vector out. Result: (q, *groups, sim, ref_id, *payload).

    ``years`` (array<int>, null: all) restricts a query to groups of these years; ``wanted`` (an array of structs of the
    groups' columns) to the groups it names. Rows without a vector take no part. ``n_queries`` is how many queries there
    are at most; without it they are counted. ``sizes`` may name a plainer table with the groups of the bank's rows, for
    counting them; it decides about sizes of parts only.
    """
    in_parts = part_of(bank if sizes is None else sizes, groups)
    if "shift" not in bank.columns:
        bank = bank.withColumn("shift", F.lit(0.0))
    queries, bank = queries.where("embedding is not null"), bank.where("embedding is not null")
    n = queries.count() if n_queries is None else n_queries
    parts, part = in_parts
    blocks = max(1, math.ceil(n / block), min(TASKS // parts, math.ceil(n / STRIP)))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    masks = [c for c in ("years", "wanted") if c in queries.columns]
    q = queries.select(F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("qb"), each(parts).alias("part"), F.lit(False).alias("is_ref"), "q", "embedding", *masks)
    b = bank.select(each(blocks).alias("qb"), part.alias("part"), F.lit(True).alias("is_ref"), "ref_id", *groups, *payload, "shift", "embedding")
    fields = [("q", queries), *((g, bank) for g in groups), ("sim", None), ("ref_id", bank), *((p, bank) for p in payload)]
    schema = ", ".join(f"{n} {df.schema[n].dataType.simpleString() if df else 'double'}" for n, df in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _pass_by(batches, groups, payload, exclude_same, min(CHUNK, block)):
            yield from table.to_batches(10_000)

    both = q.unionByName(b, allowMissingColumns=True).repartitionById(blocks * parts, F.col("qb") * parts + F.col("part"))
    return both.sortWithinPartitions("is_ref", *groups, "ref_id").mapInArrow(run, schema)


def part_of(bank: DataFrame, groups: list[str]) -> tuple[int, F.Column]:
    """Into how many parts of whole groups a bank is cut, and the part of a row. The largest groups go to the emptiest
    part one by one, the rest by hash; only the sizes of the HEAVY largest groups are looked at one by one."""
    if not groups:
        return 1, F.lit(0)
    name = F.xxhash64(*groups)
    counts = bank.groupBy(name.alias("g")).agg(F.count(F.lit(1)).alias("n"))
    largest = sorted(((r.n, r.g) for r in counts.orderBy(F.desc("n"), "g").limit(HEAVY).collect()), reverse=True)
    rest = 0 if len(largest) < HEAVY else counts.agg(F.sum("n")).first()[0] - sum(n for n, _ in largest)
    total = rest + sum(n for n, _ in largest)
    for parts in PARTS:
        held, where = [rest / parts] * parts, {}
        for n, g in largest:
            where[g] = held.index(min(held))
            held[where[g]] += n
        if max(held) * parts <= UNEVEN * total:
            by_size = F.create_map(*[F.lit(x) for pair in where.items() for x in pair]) if where else None
            by_hash = F.pmod(name, F.lit(parts)).cast("int")
            return parts, by_hash if by_size is None else F.coalesce(by_size[name], by_hash)
    return 1, F.lit(0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = pa.concat_arrays([chunk.flatten() for chunk in column.chunks]).to_numpy(zero_copy_only=False)
    return (values if values.dtype == np.float32 else values.astype("float64")).reshape(len(column), -1)


def _pass_by(batches: Iterator[pa.RecordBatch], groups: list[str], payload: tuple[str, ...], exclude_same: bool, size: int) -> Iterator[pa.Table]:
    """Winners of one query block. Its queries come first, then the bank in order of groups and ids, ``size`` references
    at a time: a group is a segment of columns, and one that goes on in the next chunk is carried there."""
    names, refs = ["q", *groups, "sim", "ref_id", *payload], ["ref_id", *payload]
    asking, held, n_held, block = [], [], 0, None

    def chunks() -> Iterator[pa.Table]:
        nonlocal held, n_held
        for batch in batches:
            n_queries = batch.num_rows - pc.sum(batch.column("is_ref")).as_py() if batch.num_rows else 0
            if n_queries:
                asking.append(batch.slice(0, n_queries))
            for lo in range(n_queries, batch.num_rows, size):
                held.append(batch.slice(lo, size))
                n_held += held[-1].num_rows
                if n_held >= size:
                    yield pa.Table.from_batches(held).select([*groups, *refs, "shift", "embedding"])
                    held, n_held = [], 0
        if held:
            yield pa.Table.from_batches(held).select([*groups, *refs, "shift", "embedding"])

    open_head, open_best, open_refs = None, None, None  # the group that the last chunk ended in
    for chunk, starts in ((piece, starts) for chunk in chunks() if asking for piece, starts in _pieces(chunk, groups, CELLS // sum(b.num_rows for b in asking))):
        if block is None:
            left = pa.Table.from_batches(asking).combine_chunks()
            block = left.column("q"), _matrix(left.column("embedding")), _allowed(left, groups)
        q, vectors, allowed = block
        heads = list(zip(*(chunk.column(g).take(pa.array(starts)).to_pylist() for g in groups))) if groups else [()]
        asked = [allowed(head) for head in heads]
        best, first = _segment_maxima(q, vectors, chunk, starts, asked, exclude_same, open_best if heads[0] == open_head else None)
        winners = chunk.select(refs)
        if heads[0] == open_head:
            kept = open_best >= best[0]
            first[0] = np.where(kept, np.arange(len(q)), first[0] + len(q))
            first[1:] += len(q)
            best[0] = np.maximum(open_best, best[0])
            winners = pa.concat_tables([open_refs, winners])
        elif open_head is not None:
            yield _won(q, [open_head], open_best[None], np.arange(len(q))[None], open_refs, groups, chunk.schema).select(names)
        done = len(heads) - 1
        if done:
            yield _won(q, heads[:done], best[:done], first[:done], winners, groups, chunk.schema).select(names)
        open_head, open_best, open_refs = heads[-1], best[-1], winners.take(pa.array(first[-1]))
    if open_head is not None:
        yield _won(q, [open_head], open_best[None], np.arange(len(q))[None], open_refs, groups, chunk.schema).select(names)


def _pieces(chunk: pa.Table, groups: list[str], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A chunk in pieces of so many groups at most, with where a group begins in each."""
    starts, most = _segments(chunk, groups), max(1, most)
    for lo in range(0, len(starts), most):
        here = starts[lo:lo + most]
        end = starts[lo + most] if lo + most < len(starts) else chunk.num_rows
        yield chunk.slice(here[0], end - here[0]), here - here[0]


def _segments(chunk: pa.Table, groups: list[str]) -> np.ndarray:
    """Where a group begins among the rows of a chunk."""
    change = np.zeros(chunk.num_rows - 1, bool)
    for g in groups:
        col = chunk.column(g).combine_chunks()
        a, b = col.slice(1), col.slice(0, chunk.num_rows - 1)
        change |= pc.fill_null(pc.not_equal(a, b), pa.scalar(False)).to_numpy(zero_copy_only=False)
        change |= pc.not_equal(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(change) + 1])


def _segment_maxima(q: pa.ChunkedArray, vectors: np.ndarray, chunk: pa.Table, starts: np.ndarray, asked: list[np.ndarray | None],
                    exclude_same: bool, reached: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Rounded maximum of every segment and query (-inf: none) and the first row that reaches it. Only queries that ask
    for a segment of the chunk are multiplied. A maximum of the first segment that stays below what a query has
    ``reached`` in that group before may be left out."""
    n, sizes = len(vectors), np.diff([*starts, chunk.num_rows])
    best, first = np.full((len(starts), n), -np.inf), np.zeros((len(starts), n), np.int32)
    rows = np.arange(n) if any(a is None for a in asked) else np.flatnonzero(np.logical_or.reduce(asked))
    bank, shift, segment = _matrix(chunk.column("embedding")), chunk.column("shift").to_numpy(), np.repeat(np.arange(len(starts)), sizes)
    lengths = _lengths(vectors) * _lengths(bank).max()
    error = UNIT * ((bank.shape[1] + 16) * lengths + 3 * np.abs(shift).max())
    slack = 2.1 * error + 4 * 10.0 ** -DIGITS
    single = bool((lengths < LONG).all()) and np.abs(shift).max() < LONG
    kind = np.float32 if single else np.float64
    across, added = np.ascontiguousarray(bank.T, kind), shift.astype(kind)
    own, own_refs = _own_rows(q, chunk.column("ref_id")) if exclude_same else (np.zeros(0, int),) * 2
    place = np.searchsorted(rows, own)
    here = place < len(rows)
    here[here] = rows[place[here]] == own[here]
    place, own_refs = place[here], own_refs[here]
    for lo in range(0, len(rows), STRIP):
        at = rows[lo:lo + STRIP]
        found = vectors[at].astype(kind, copy=False) @ across
        if shift.any():
            found += added
        mine = slice(*np.searchsorted(place, [lo, lo + STRIP]))
        found[place[mine] - lo, own_refs[mine]] = -np.inf
        top = np.maximum.reduceat(found, starts, axis=1)
        best[:, at] = np.where(np.isnan(top), np.nan, -np.inf).T
        least = top - slack[at, None]
        open_ = np.isfinite(top)
        for s, mask in enumerate(asked):
            if mask is not None:
                open_[:, s] &= mask[at]
        if reached is not None:
            open_[:, 0] &= top[:, 0] >= reached[at] - slack[at]
        least[~open_] = np.inf
        some = np.flatnonzero(open_.any(axis=1))
        pair, ref = _at_least(found[some], np.repeat(least[some].astype(kind), sizes, axis=1))
        if not len(pair):
            continue
        query = at[some[pair]]
        if len(pair) * DENSE > len(some) * chunk.num_rows:
            sims = (vectors[at[some]].astype("float64") @ bank.T.astype("float64"))[pair, ref]
        else:
            sims = np.einsum("ij,ij->i", vectors[query].astype("float64"), bank[ref].astype("float64"))
        sims = np.round(sims + shift[ref], DIGITS)
        name = pair * len(starts) + segment[ref]
        begins = np.flatnonzero(np.diff(name, prepend=-1))
        reach = np.flatnonzero(sims == np.repeat(np.maximum.reduceat(sims, begins), np.diff([*begins, len(name)])))
        reach = reach[np.unique(name[reach], return_index=True)[1]]
        best[segment[ref[reach]], query[reach]], first[segment[ref[reach]], query[reach]] = sims[reach], ref[reach]
    return best, first


def _at_least(values: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the few values that reach their limits, in order. Eight comparisons are looked at together."""
    width = -(-values.shape[1] // 8) * 8
    marks = np.zeros((len(values), width), bool)
    np.greater_equal(values, limits, out=marks[:, :values.shape[1]])
    words = np.flatnonzero(marks.view(np.uint64))
    word, byte = np.nonzero(marks.reshape(-1, 8)[words])
    return np.divmod(words[word] * 8 + byte, width)


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype="float64"))


def _own_rows(q: pa.ChunkedArray, ref_ids: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a chunk that are a query's own vector: the numbers of the queries, in order, and the rows."""
    place, own = defaultdict(list), []
    among = np.flatnonzero(pc.is_in(q, value_set=ref_ids.combine_chunks()).to_numpy())
    for k, name in zip(among, q.take(pa.array(among)).to_pylist()):
        place[name].append(k)
    back = np.flatnonzero(pc.is_in(ref_ids, value_set=q.combine_chunks()).to_numpy())
    for row, name in zip(back, ref_ids.take(pa.array(back)).to_pylist()):
        own += [(k, row) for k in place[name]]
    return tuple(np.array(sorted(own), int).reshape(-1, 2).T)


def _won(q: pa.ChunkedArray, heads: list[tuple], best: np.ndarray, first: np.ndarray, winners: pa.Table, groups: list[str], schema: pa.Schema) -> pa.Table:
    """One row per query and group that has a reference."""
    segment, row = np.nonzero(np.isfinite(best))
    columns = {"q": q.take(pa.array(row)), "sim": pa.array(best[segment, row])}
    for g, values in zip(groups, zip(*heads)):
        columns[g] = pa.array(values, schema.field(g).type).take(pa.array(segment))
    taken = winners.take(pa.array(first[segment, row]))
    return pa.table(columns | {c: taken.column(c) for c in winners.column_names})


def _allowed(left: pa.Table, groups: list[str]) -> Callable[[tuple], np.ndarray | None]:
    """Which queries may match a group, by the group's values; None is all."""
    n, tests = left.num_rows, []

    def test(lists: pa.ListArray, named: list[pa.Array], free: np.ndarray, places: list[int]) -> Callable[[tuple], np.ndarray]:
        """Names are numbered and their queries sorted by number, so that a name finds its queries in one run."""
        numbers, known = np.zeros(len(named[0]), np.int64), []
        for values in named:
            coded = values.dictionary_encode(null_encoding="encode")
            known.append({v: k for k, v in enumerate(coded.dictionary.to_pylist())})
            numbers = numbers * len(known[-1]) + coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(numbers, kind="stable")
        numbers, rows = numbers[order], pc.list_parent_indices(lists).to_numpy()[order]

        def mask(head: tuple) -> np.ndarray:
            out, number = free.copy(), 0
            for at, codes in zip(places, known):
                if head[at] not in codes:
                    return out
                number = number * len(codes) + codes[head[at]]
            out[rows[slice(*np.searchsorted(numbers, [number, number + 1]))]] = True
            return out
        return mask

    if "years" in left.column_names and "year" in groups:
        lists = left.column("years").combine_chunks()
        tests.append(test(lists, [lists.flatten()], ~lists.is_valid().to_numpy(zero_copy_only=False), [groups.index("year")]))
    if "wanted" in left.column_names:
        lists = left.column("wanted").combine_chunks()
        tests.append(test(lists, [lists.flatten().field(g) for g in groups], np.zeros(n, bool), list(range(len(groups)))))
    return lambda head: np.logical_and.reduce([t(head) for t in tests]) if tests else None


def asking(queries: DataFrame, wanted: DataFrame, groups: list[str]) -> DataFrame:
    """``queries`` that ask for the groups listed in ``wanted`` (q, *groups), a bounded number each."""
    lists = wanted.select("q", *groups).distinct().groupBy("q").agg(F.collect_list(F.struct(*groups)).alias("wanted"))
    return queries.select("q", "embedding").join(lists, "q")


def nearest(sims: DataFrame) -> DataFrame:
    """The best reference of each query."""
    return first_by(sims, ["q"], [F.desc("sim"), F.asc("ref_id")])


def eras_of(year) -> "F.Column":
    """Eras that contain a year; a year may belong to two."""
    table = F.array(*[F.struct(F.lit(i).alias("era_no"), F.lit(e).alias("era"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
                      for i, (e, lo, hi) in enumerate(S.ERAS)])
    return F.filter(table, lambda e: (year >= e["lo"]) & (year <= e["hi"]))


def with_era(df: DataFrame) -> DataFrame:
    """One row per era containing the row's year (inclusive, overlapping)."""
    rows = df.withColumn("_e", F.explode(eras_of(F.col("year"))))
    return rows.withColumns({"era": F.col("_e.era"), "era_no": F.col("_e.era_no")}).drop("_e")


def mean_vector(df: DataFrame, keys: list[str]) -> DataFrame:
    """Component-wise mean per group: averaged map-side per dimension, then put back together."""
    parts = df.select(*keys, F.posexplode("embedding").alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def centroids(bank: DataFrame) -> DataFrame:
    """Unit mean vector per era: (era, era_no, centroid)."""
    means = mean_vector(with_era(bank), ["era", "era_no"])
    norm = F.sqrt(dot(F.col("mean"), F.col("mean")))
    return means.select("era", "era_no", norm.alias("_n"), "mean").select("era", "era_no", F.transform("mean", lambda x: x / F.col("_n")).alias("centroid"))


def guess_group(crops: DataFrame, cents: DataFrame, n: int = 5) -> DataFrame:
    """Era of a lot by majority of its first ``n`` crops; earliest vote breaks ties.

    ``crops``: (lot, crop_no, embedding). The centroids are one row of at most three vectors.
    """
    table = cents.groupBy(F.lit(1).alias("_one")).agg(F.array_sort(F.collect_list(F.struct("era_no", "era", "centroid"))).alias("_c"))
    sample = top_k(crops, ["lot"], [F.asc("crop_no")], n, "_r").withColumn("_one", F.lit(1))
    scored = sample.join(F.broadcast(table), "_one").withColumn("_s", F.transform("_c", lambda e: F.struct(
        F.round(dot(F.col("embedding"), e["centroid"]), 4).alias("sim"), (-e["era_no"]).alias("first"), e["era"].alias("era"))))
    votes = scored.select("lot", "crop_no", F.array_max("_s")["era"].alias("era")).groupBy("lot", "era").agg(
        F.count(F.lit(1)).alias("votes"), F.min("crop_no").alias("first_crop"))
    return first_by(votes, ["lot"], [F.desc("votes"), F.asc("first_crop")]).select("lot", "era", "votes")


def text_baseline(text_bank: DataFrame, image_bank: DataFrame) -> DataFrame:
    """Mean similarity of each text entry to the whole image bank. The mean of dot products is the dot product
    with the mean, so one vector stands for the bank."""
    mean = mean_vector(image_bank.withColumn("_one", F.lit(1)), ["_one"])
    return text_bank.withColumn("_one", F.lit(1)).join(F.broadcast(mean), "_one").select(
        "ref_id", F.round(dot(F.col("embedding"), F.col("mean")), DIGITS).alias("baseline"))
