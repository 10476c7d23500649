"""Line deduplication by an exact set-similarity join.

Lines are sets of words. A line goes if an earlier one, by document id and line number, has a Jaccard similarity of at
least ``similarity``, whether or not that one stays. The join is exact; hashes of 64 bits stand for words.

* Equal sets meet first: one row per set remains, with its earliest place.
* Words are ordered by rarity, counted over all documents in a table of fixed size. Any order that all lines share is
  right, so words that share a counter only cost time. A counter of one proves that no other line has the word.
* Two similar sets share a word among the first few of each (prefix), those words stand at places that leave room for
  the overlap (position), and their sizes are alike (length). A parity sketch of 64 bits, 256 for larger sets, bounds
  their difference.
* The first word that two sets share decides: what follows it in each must leave room for the overlap, so a word bounds
  the size of the sets that its set can meet there. Where a word is too common for a short list, the first two words that
  they share decide, or three, or four: how many follows from the words alone, so both sets stand in the same list.
  Sets of many words, of which there would be too many such runs, and those that can meet them, keep the shorter ones.
* A set meets a few sets before it in the lists of its prefix words; only a set that had more to compare and found nothing
  similar asks all earlier ones. So a group of thousands of variants of one line costs a few comparisons each, not one
  per pair, and no link to an earlier line is lost. Long lists are cut by size and hash into parts of bounded length: a
  set stands in one part and asks those whose sizes it can meet, block against block.
* What passes the filters is verified on the sets themselves.

Nulls and empty texts have no lines with words. Lines without words stay. Rows that agree in id and text are one
document; rows that share only the id, and rows without an id, are documents of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.llm.words import Words, as_text, distinct, group_starts, hash_words, mix, slices
from lotscope.llm.tables import drop_table, small_batches, through_table
from lotscope.plans.lineage import new_folder

SIMILARITY = 0.8
#: Counters of the rarity table (8 MiB), in segments that are summed apart, and bits of the filter of wanted lines (8 MiB).
COUNTERS, SEGMENT, FILTER_BITS = 1 << 23, 1 << 13, 1 << 26
#: A posting is compared with so many of the first in its list, until so many candidates are found; the rest comes later.
REACH, ENOUGH = 1 << 11, 2
#: Lists of more postings are cut by size; a part of one size is cut by hash to about so many postings.
LONG, PART = 1 << 11, 1 << 13
#: Of a part, a set is answered with so many of the closest candidates first; if none is similar, with all.
CLOSEST = 4
#: Words are joined by the next shared ones until a list is expected to have so many sets (its binary logarithm) or less,
#: in sets of at most so many words: to two, to three, to four.
SHORT, LARGEST = 11, (128, 48, 24)
#: Sets of so many words or more have the long sketch.
WIDE = 48
#: Counts in one byte, exact up to 16: sixteen to an octave.
_COUNTS = np.unique(np.round(2 ** (np.arange(640) / 16)).astype(np.int64))[:255]
_COUNTS = np.concatenate([[0], _COUNTS])
_LINES, _PAIRS = 1 << 11, 1 << 18  # lines sorted, pairs compared at once
_TOKEN = np.uint64((1 << 48) - 1)
_ANY_WORD = re.compile(r"[0-9A-Za-z_]|[^\x00-\x7f]")


def _line_of_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its line among all lines of the batch; for each line its row and its number there."""
    first, last = int(words.offsets[0]), int(words.offsets[-1])
    breaks = np.flatnonzero(words.data[first:last] == 10) + first
    starts = np.sort(np.concatenate([words.offsets[:-1], breaks + 1]), kind="stable")
    # a break at the very end of a row opens a last empty line of that row, before the next row's first line
    is_row = np.zeros(len(starts), bool)
    is_row[np.searchsorted(breaks, words.offsets[:-1], "left") + np.arange(len(words.offsets) - 1)] = True
    row = np.cumsum(is_row) - 1
    number = np.arange(len(starts)) - np.flatnonzero(is_row)[row]
    return np.searchsorted(starts, words.starts, "right") - 1, row, number


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Level of every counter: the bit length of the number of words that fell on it, over all documents, up to 31."""
    def count(batches: Iterator[pa.RecordBatch]):
        held = np.zeros(COUNTERS, np.uint32)
        for batch in slices(batches, text):
            words = hash_words(batch.column(text))
            np.add.at(held, (words.hashes & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
        parts = np.empty((COUNTERS // SEGMENT, SEGMENT), np.uint8)
        for part, counts in zip(parts, held.reshape(parts.shape)):  # a segment at a time: positions take eight bytes each
            part[:] = np.searchsorted(_COUNTS, counts, "right") - 1
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[i].tobytes() for i in some], pa.binary())],
                                         ["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = held.setdefault(segment, np.zeros(SEGMENT, np.int64))
                part += _COUNTS[np.frombuffer(counts, np.uint8)]
        levels = [np.minimum(31, np.frexp(p.astype(float))[1]).astype(np.uint8).tobytes() for p in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(levels, pa.binary())], ["segment", "levels"])

    summed = (docs.select(text).mapInArrow(count, "segment int, counts binary").repartition("segment")
              .mapInArrow(add, "segment int, levels binary"))
    out = np.zeros((COUNTERS // SEGMENT, SEGMENT), np.uint8)
    for row in summed.collect():  # COUNTERS bytes at most
        out[row.segment] = np.frombuffer(row.levels, np.uint8)
    return out.reshape(-1)


def _sets(column: pa.Array, levels: np.ndarray | None):
    """Sets of the lines of a batch, some lines at a time: row and number of each line, where each set starts, its words
    in order of rarity (level, then hash)."""
    words = hash_words(column)
    if not len(words.hashes):
        return
    line, row, number = _line_of_words(words)
    tokens = words.hashes & _TOKEN
    level = levels[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) if levels is not None else np.uint64(0)
    rest = tokens | (level << np.uint64(48))
    at = 0
    while at < len(line):
        end = int(np.searchsorted(line, line[at] + _LINES, "left"))
        packed = distinct(rest[at:end] | ((line[at:end] - line[at]).astype(np.uint64) << np.uint64(53)))
        own = (packed >> np.uint64(53)).astype(np.int64)
        starts = group_starts(own)
        lines = own[starts] + line[at]
        yield row[lines], number[lines], starts, packed & np.uint64((1 << 53) - 1)
        at = end


def _place(text_hash: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mix(mix(text_hash) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _keys(starts: np.ndarray, sizes: np.ndarray, packed: np.ndarray, similarity: float, top: int, short: int) -> tuple[np.ndarray, ...]:
    """Lists that sets stand in, in order of sets: the set, the key of 48 bits, and how many words of the set that come
    before are not shared.

    A key is the word that may be the first one shared, or the first few. ``top`` is the level of a word of all lines; a
    run of words is expected in as many lines as they have in common by chance.
    """
    need = np.ceil(similarity * sizes - 1e-9).astype(np.int64)
    room = sizes - need
    # one word more or less is the least that sets differ in: smaller ones are similar to themselves only
    row = np.flatnonzero(sizes >= (similarity / (1 - similarity) - 1e-9 if similarity < 1 else np.inf))
    last, key, expected = np.full(len(row), -1), np.zeros(len(row), np.uint64), np.full(len(row), top)
    made = []
    for depth, largest in enumerate((*LARGEST, 0), 1):
        more = np.maximum(np.minimum(room[row] + depth, sizes[row]) - last - 1, 0)
        at = np.repeat(last + 1, more) + _counted(more).astype(np.int64)
        row, key, expected = np.repeat(row, more), np.repeat(key, more), np.repeat(expected, more)
        word = packed[starts[row] + at]
        level = (word >> np.uint64(48)).astype(np.int64)
        some = np.flatnonzero(level > 1)  # no other line has the rest
        row, at, word, key = row[some], at[some], word[some] & _TOKEN, key[some]
        expected = expected[some] + level[some] - top
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + word) if depth > 1 else word
        n = sizes[row]
        on = (expected > short) & (n <= largest)
        # lists that a larger set does not leave, or behind which no shared word need follow, are kept too
        ends = ~on | (n >= similarity * largest - 1e-9) | (need[row] <= depth)
        made.append((row[ends], key[ends] & _TOKEN, at[ends] - depth + 1))
        row, last, key, expected = row[on], at[on], key[on], expected[on]
    row, key, at = (np.concatenate(x) for x in zip(*made))
    order = np.argsort(row, kind="stable")
    return row[order], key[order], at[order]


def line_sets(docs: DataFrame, levels: np.ndarray, similarity: float, short: int = SHORT) -> DataFrame:
    """One row per line with words: its place, the key and size of its set, its parity sketch, and the keys of its lists.

    The sketch is a word of 64 bits; for larger sets three of the four words of the long sketch follow, whose sum without
    carry the first one is. An entry of ``prefix`` is a key of 48 bits under a position of 16 (0xFFFF: too far to tell).
    Words that no other line has are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    top = int(levels.max())
    schema = ("doc_id bigint, text_hash bigint, line int, place bigint, k1 bigint, k2 bigint, size int, parity array<bigint>, "
              "prefix array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text"):
            text_hash = batch.column("text_hash").to_numpy().view(np.uint64)
            ids = batch.column("doc_id")
            for row, number, starts, packed in _sets(batch.column("text"), shared.value):
                sizes = np.diff(np.append(starts, len(packed)))
                tokens = packed & _TOKEN
                a, b = mix(tokens + np.uint64(1)), mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
                bit = np.uint64(1) << (a & np.uint64(63))
                quarter = (a >> np.uint64(6)) & np.uint64(3)
                sketch = np.stack([np.bitwise_xor.reduceat(bit if q == 0 else np.where(quarter == np.uint64(q), bit, np.uint64(0)), starts)
                                   for q in range(4)], axis=1)
                width = np.where(sizes >= WIDE, 4, 1)
                own, key, at = _keys(starts, sizes, packed, similarity, top, short)
                prefix = key | (np.minimum(at, 0xFFFF).astype(np.uint64) << np.uint64(48))
                col = lambda x: pa.array(x.view(np.int64))
                lists = lambda lengths, x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), col(x))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), col(text_hash[row]), pa.array(number.astype(np.int32)), col(_place(text_hash[row], number)),
                     col(np.add.reduceat(a, starts)), col(np.add.reduceat(b, starts)), pa.array(sizes.astype(np.int32)),
                     lists(width, sketch[np.arange(4) < width[:, None]]), lists(np.bincount(own, minlength=len(sizes)), prefix)],
                    ["doc_id", "text_hash", "line", "place", "k1", "k2", "size", "parity", "prefix"])

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, schema)


def _may_match(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Length, positional and parity filters between the i-th and j-th of some postings, for the first word they share."""
    n, m = x["size"][i].astype(np.int64), x["size"][j].astype(np.int64)
    need = np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9).astype(np.int64)
    p, q = x["at"][i].astype(np.int64), x["at"][j].astype(np.int64)
    differ = np.bitwise_count((x["parity"][i] ^ x["parity"][j]).view(np.uint64)).astype(np.int64)
    if _WORDS[0] in x:
        both = np.flatnonzero((np.minimum(n, m) >= WIDE) & (differ <= n + m - 2 * need))
        words = [(x[c][i[both]] ^ x[c][j[both]]).view(np.uint64) for c in ("parity", *_WORDS)]
        words[0] = words[0] ^ words[1] ^ words[2] ^ words[3]
        differ[both] = sum(np.bitwise_count(w).astype(np.int64) for w in words)
    return ((np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (differ <= n + m - 2 * need)
            & ((n - p >= need) | (p == 0xFFFF)) & ((m - q >= need) | (q == 0xFFFF)))


def wanted_filter(places: DataFrame) -> np.ndarray:
    """A bit per hash of a wanted place; FILTER_BITS in all, however many places there are."""
    word, bit = F.pmod(F.shiftrightunsigned("place", 6), F.lit(FILTER_BITS // 64)), F.expr("shiftleft(1L, int(place & 63))")
    got = places.select(word.cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_filter(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in a filter."""
    words = table[((hashes >> np.uint64(6)) % np.uint64(len(table))).astype(np.int64)]
    return ((words >> (hashes & np.uint64(63))) & np.uint64(1)).astype(bool)


def _words_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Sets of the wanted places: place and its sorted words as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted_filter(places))

    def run(batches: Iterator[pa.RecordBatch]):
        table = shared.value
        for batch in slices(batches, "text"):
            lines = pc.split_pattern(as_text(batch.column("text")), "\n")
            lengths = np.diff(lines.offsets.to_numpy())
            text_hash = np.repeat(batch.column("text_hash").to_numpy().view(np.uint64), lengths)
            place = _place(text_hash, _counted(lengths))
            some = np.flatnonzero(in_filter(table, place))
            for row, _, starts, packed in _sets(lines.flatten().take(pa.array(some)), None):
                ends = np.append(starts[1:], len(packed))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place[some[row]].view(np.int64)),
                     pa.array([packed[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())], ["place", "words"])

    made = docs.select("text", "text_hash").mapInArrow(run, "place bigint, words binary")
    return made.join(places, "place", "left_semi").dropDuplicates(["place"])


def verify(docs: DataFrame, pairs: DataFrame, similarity: float, path: str) -> DataFrame:
    """Those of the ``pairs`` (earlier, later: places) whose sets are similar enough, as a table at ``path``."""
    places = pairs.select(F.explode(F.array("earlier", "later")).alias("place")).distinct()
    words = through_table(_words_of(docs, places), f"{path}-words")
    both = (pairs.join(words.toDF("earlier", "x"), "earlier").join(words.toDF("later", "y"), "later"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                n, m = len(x) // 8, len(y) // 8
                shared = n + m - len(distinct(np.frombuffer(x + y, np.uint64)))
                keep.append(shared >= similarity * (n + m - shared) - 1e-9)
            yield batch.select(["earlier", "later"]).filter(pa.array(keep, pa.bool_()))

    found = through_table(both.mapInArrow(run, "earlier bigint, later bigint"), path)
    drop_table(docs.sparkSession, f"{path}-words")
    return found


_WORDS = ("parity1", "parity2", "parity3")
_POSTING = ("token", "doc_id", "line", "place", "size", "at", "parity", *_WORDS)
_POSTINGS = "token bigint, doc_id bigint, line int, place bigint, size int, at int, parity bigint, parity1 bigint, parity2 bigint, parity3 bigint"


def _levels(df: DataFrame, keys, n: int) -> np.ndarray:
    """Bit length of the number of keys on each of a table of counters, whose size follows the number ``n`` of sets, up
    to COUNTERS. ``keys`` yields the keys of a batch."""
    counters = min(COUNTERS, max(SEGMENT, 1 << int(n // 2).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]):
        held = np.zeros(counters, np.uint32)
        for batch in batches:
            np.add.at(held, (keys(batch) & np.uint64(counters - 1)).astype(np.int64), np.uint32(1))
        parts = held.reshape(-1, SEGMENT)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[i].tobytes() for i in some], pa.binary())],
                                         ["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = held.setdefault(segment, np.zeros(SEGMENT, np.uint64))
                part += np.frombuffer(counts, np.uint32)
        levels = [np.frexp(p.astype(float))[1].astype(np.uint8).tobytes() for p in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(levels, pa.binary())], ["segment", "levels"])

    out = np.zeros((counters // SEGMENT, SEGMENT), np.uint8)
    summed = df.mapInArrow(count, "segment int, counts binary").repartition("segment").mapInArrow(add, "segment int, levels binary")
    for row in summed.collect():  # COUNTERS bytes at most
        out[row.segment] = np.frombuffer(row.levels, np.uint8)
    return out.reshape(-1)


def _level(levels: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return levels[(keys & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.int64)


def _band(size: np.ndarray) -> np.ndarray:
    """Bands of set sizes, each a few per cent wide."""
    return np.floor(16 * np.log2(np.maximum(size, 1)) + 1e-9).astype(np.uint64)


def _band_key(token: np.ndarray, band: np.ndarray) -> np.ndarray:
    return mix(token + (band + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _part(token: np.ndarray, band: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The word under the number of a part, in 16 bits; parts that share a number are one."""
    return token | ((mix(band * np.uint64(0x100000001) + salt) % np.uint64(0xFFFF) + np.uint64(1)) << np.uint64(48))


def _salts(level: np.ndarray, part: int) -> np.ndarray:
    """Into how many parts of about ``part`` postings keys of these levels are cut."""
    return np.uint64(1) << np.maximum(level - part.bit_length(), 0).astype(np.uint64)


def _exploded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of sets: the row, key and position of every list it stands in."""
    lists = batch.column("prefix")
    word = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    return row, word & _TOKEN, (word >> np.uint64(48)).astype(np.int32)


def _posting_batch(batch: pa.RecordBatch, row: np.ndarray, key: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    where = pa.array(row)
    made = {"token": pa.array(key.view(np.int64)), "at": pa.array(at)}
    if pa.types.is_list(batch.schema.field("parity").type):
        sketch = batch.column("parity")
        starts, flat = sketch.offsets.to_numpy(), sketch.values.to_numpy()
        wide = np.diff(starts) > 1
        for k, c in enumerate(("parity", *_WORDS)):
            word = np.zeros(batch.num_rows, np.int64)
            some = wide if k else slice(None)
            word[some] = flat[starts[:-1][some] + k]
            made[c] = pa.array(word[row])
    return pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c).take(where) for c in _POSTING], list(_POSTING))


def _cut_keys(token: np.ndarray, size: np.ndarray, place: np.ndarray, by_band: np.ndarray, part: int) -> np.ndarray:
    band = _band(size)
    return _part(token, band, mix(place.view(np.uint64)) % _salts(_level(by_band, _band_key(token, band)), part))


def _postings(sets: DataFrame, by_word: np.ndarray, by_band: np.ndarray, long: int, part: int, bins: int) -> DataFrame:
    """Postings of the sets, one per list they stand in, packed by bin: the key of the list alone in lists of at most
    ``long``, else with the set's part of the list. A list or part lies in one of the ``bins``."""
    shared = sets.sparkSession.sparkContext.broadcast((by_word, by_band))

    def rows(batches: Iterator[pa.RecordBatch]):
        by_word, by_band = shared.value
        for batch in batches:
            row, token, at = _exploded(batch)
            level = _level(by_word, token)
            shared_word = level > 1
            row, token, at, level = row[shared_word], token[shared_word], at[shared_word], level[shared_word]
            cut = np.flatnonzero(level >= long.bit_length())
            key = token.copy()
            size, place = (batch.column(c).to_numpy()[row[cut]] for c in ("size", "place"))
            key[cut] = _cut_keys(token[cut], size, place, by_band, part)
            yield _posting_batch(batch, row, key, at)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in _joined(rows(batches), _PACKED):
            bin_ = (mix(batch.column("token").to_numpy().view(np.uint64)) % np.uint64(bins)).astype(np.int32)
            order = np.argsort(bin_, kind="stable")
            bin_ = bin_[order]
            packed = np.empty(batch.num_rows, _RECORD)
            for c in ("token", "place", "size", "at", "parity"):
                packed[c] = batch.column(c).to_numpy()[order]
            ids = batch.column("doc_id")
            packed["doc_id"] = ids.fill_null(np.iinfo(np.int64).min).to_numpy()[order]
            line = batch.column("line").to_numpy()
            # rows without an id come first, also before the least id
            packed["line"] = np.where(ids.is_null().to_numpy(zero_copy_only=False), line + np.iinfo(np.int32).min, line)[order]
            wide = np.stack([batch.column(c).to_numpy()[order] for c in _WORDS], axis=1)
            has = packed["size"] >= WIDE
            starts = group_starts(bin_)
            ends = np.append(starts[1:], len(bin_))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bin_[starts]), pa.array([_planes(packed[i:j]) for i, j in zip(starts, ends)], pa.binary()),
                 pa.array([wide[i:j][has[i:j]].tobytes() for i, j in zip(starts, ends)], pa.binary())], ["bin", "postings", "wide"])

    return sets.select("doc_id", "line", "place", "size", "parity", "prefix").mapInArrow(run, "bin int, postings binary, wide binary")


#: A posting without the words of its long sketch.
_RECORD = np.dtype([("token", "<i8"), ("doc_id", "<i8"), ("place", "<i8"), ("parity", "<i8"), ("size", "<i4"), ("line", "<i4"), ("at", "<i4")])
_PACKED = 1 << 17  # postings packed at once, some hundred bytes each with their copies


def _planes(packed: np.ndarray) -> bytes:
    """Records byte by byte: all first bytes, all second ones and so on, most of which are zeros that compress away."""
    return np.ascontiguousarray(packed.view(np.uint8).reshape(len(packed), -1).T).tobytes()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over packed postings in order of bins: each bin's postings in order of list and place."""
    def bin_of(records: list[np.ndarray], wides: list[bytes]) -> pa.RecordBatch:
        x, words = np.concatenate(records), np.zeros((sum(map(len, records)), len(_WORDS)), np.int64)
        words[x["size"] >= WIDE] = np.frombuffer(b"".join(wides), np.int64).reshape(-1, len(_WORDS))
        order = np.lexsort((x["place"], x["line"], x["doc_id"], x["token"]))
        x, words = x[order], words[order]
        without = x["line"] < 0
        line = np.where(without, x["line"] - np.iinfo(np.int32).min, x["line"]).astype(np.int32)
        made = {"doc_id": pa.array(x["doc_id"], mask=without), "line": pa.array(line), **{c: pa.array(words[:, k]) for k, c in enumerate(_WORDS)}}
        return pa.RecordBatch.from_arrays([made[c] if c in made else pa.array(np.ascontiguousarray(x[c])) for c in _POSTING], list(_POSTING))

    width, now, records, wides = _RECORD.itemsize, None, [], []
    for batch in batches:
        for bin_, postings, wide in zip(*(c.to_pylist() for c in batch.columns)):
            if bin_ != now and records:
                yield bin_of(records, wides)
                records, wides = [], []
            now = bin_
            records.append(np.ascontiguousarray(np.frombuffer(postings, np.uint8).reshape(width, -1).T).view(_RECORD)[:, 0])
            wides.append(wide)
    if records:
        yield bin_of(records, wides)


def _columns(batch: pa.RecordBatch, names=("token", "place", "size", "at", "parity", *_WORDS)) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names if c in batch.schema.names}


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches side by side until they hold ``rows`` rows."""
    waiting, total = [], 0
    for batch in batches:
        waiting.append(batch)
        total += batch.num_rows
        if total >= rows:
            yield pa.concat_batches(waiting)
            waiting, total = [], 0
    if total:
        yield pa.concat_batches(waiting)


def _compare_lists(similarity: float, reach: int = REACH, enough: int = ENOUGH):
    """Over postings in order of word and place: candidates (earlier, later), and postings left with more to compare.

    A posting is compared with the first ``reach`` ones of its list, from the first on, until ``enough`` candidates are
    found; as the lists of similar sets begin alike, these agree from list to list. One that stops early, has more
    before it, or stands in a part of a list is reported whole (earlier: null). Of the running list, its first ``reach``
    postings are held.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        held, length = None, 0  # the head of the running list, and the postings it has had
        for batch in _joined(batches, 200_000):
            x = _columns(batch)
            goes_on = held is not None and held["token"][0] == x["token"][0]
            old = len(held["token"]) if goes_on else 0
            if goes_on:
                x = {c: np.concatenate([held[c], x[c]]) for c in x}
            total = len(x["token"])
            opens = group_starts(x["token"])
            begun = np.repeat(opens, np.diff(np.append(opens, total)))
            ranks = np.arange(total) - begun
            if goes_on:
                ranks[begun == 0] += length - old
            mine = np.arange(old, total)
            found = np.zeros(total, np.int64)
            earlier, later = [], []
            least, most = np.ceil(similarity * x["size"] - 1e-9), np.floor(x["size"] / similarity + 1e-9)
            differ = np.floor(x["size"] * (1 - similarity) / similarity + 1e-6)  # from the largest set it can meet
            least, most, differ = (v.astype(x["size"].dtype) for v in (least, most, differ))
            sketch = x["parity"].view(np.uint64)
            near = 0
            while near < reach and len(mine):
                far = min(max(64, 4 * near), reach)
                open_ = mine[(ranks[mine] > near) & (found[mine] < enough)]
                if not len(open_):
                    break
                count = np.minimum(ranks[open_], far) - near
                bounds = np.cumsum(count)
                at = 0
                while at < len(open_):
                    end = max(at + 1, int(np.searchsorted(bounds, bounds[at] - count[at] + _PAIRS, "right")))
                    i = np.repeat(open_[at:end], count[at:end])
                    j = np.repeat(begun[open_[at:end]] + near, count[at:end]) + _counted(count[at:end]).astype(np.int64)
                    size = x["size"][j]
                    some = np.flatnonzero((size >= least[i]) & (size <= most[i]))
                    i, j = i[some], j[some]
                    some = np.flatnonzero(np.bitwise_count(sketch[i] ^ sketch[j]) <= differ[i])
                    i, j = i[some], j[some]
                    some = np.flatnonzero(_may_match(x, i, j, similarity))
                    i, j = i[some], j[some]
                    if len(i):
                        first = group_starts(i)
                        lengths = np.diff(np.append(first, len(i)))
                        some = np.arange(len(i)) - np.repeat(first, lengths) + found[i] < enough
                        found[i[first]] += lengths
                        earlier.append(x["place"][j[some]])
                        later.append(x["place"][i[some]])
                    at = end
                near = far
            left = mine[(found[mine] >= enough) | (ranks[mine] > reach) | (x["token"][mine].view(np.uint64) > _TOKEN)]
            head = begun[-1]
            held = {c: x[c][head:head + reach] for c in x}
            length = int(ranks[-1]) + 1
            both = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)])
            pairs = both(earlier)
            rows = pa.array(left - old)
            whole = [pa.concat_arrays([pa.nulls(len(pairs), batch.schema.field(c).type), batch.column(c).take(rows)]) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(pairs, pa.int64()), pa.nulls(len(left), pa.int64())]),
                 pa.array(np.concatenate([both(later), x["place"][left]]), pa.int64()), *whole], ["earlier", "later", *batch.schema.names])

    return run


def near_matches(docs: DataFrame, sets: DataFrame, similarity: float, reach: int = REACH, enough: int = ENOUGH,
                 long: int = LONG, part: int = PART, closest: int = CLOSEST) -> DataFrame:
    """Places of the sets (``later``) that have a similar earlier set, with one such (``earlier``) or more."""
    folder = new_folder(docs.sparkSession, "line-near")
    n = sets.count()
    by_word = _levels(sets.select("prefix"), lambda batch: _exploded(batch)[1], n)
    by_band = np.zeros(SEGMENT, np.uint8)
    if (by_word >= long.bit_length()).any():
        by_band = _levels(sets.select("size", "prefix"), _long_band_keys(by_word, long), n)
    lists = _postings(sets, by_word, by_band, long, part, 1 << max(10, (n >> 14).bit_length())).repartition("bin").sortWithinPartitions("bin")
    compare = _compare_lists(similarity, reach, enough)
    made = through_table(lists.mapInArrow(lambda batches: compare(_unpacked(batches)), f"earlier bigint, later bigint, {_POSTINGS}"),
                         f"{folder}/candidates")
    # the candidate that most words of a set agree on is verified first; of most sets that have one it is a match
    pairs = made.filter("earlier is not null").groupBy("later", "earlier").agg(F.count("*").alias("n"))
    best = through_table(pairs.groupBy("later").agg(F.max(F.struct("n", "earlier")).alias("b")).select("b.earlier", "later"), f"{folder}/best")
    found = verify(docs, best, similarity, f"{folder}/found")
    # sets that are still without a match meet their other candidates, and in lists that have more to compare all before them
    matched = found.select("later").distinct()
    left_over = through_table(made.filter("earlier is null").select(*_POSTING).join(matched.toDF("place"), "place", "left_anti").select(*_POSTING),
                              f"{folder}/open")
    others = made.filter("earlier is not null").select("earlier", "later").join(matched, "later", "left_anti").join(best, ["later", "earlier"], "left_anti").distinct()
    rest = through_table(others.select("earlier", "later").unionByName(_all_before(sets, left_over, by_band, similarity, part, closest)).distinct(), f"{folder}/rest")
    more = verify(docs, rest.filter("earlier is not null"), similarity, f"{folder}/rest-found")
    found = found.unionByName(more)
    again = through_table(rest.filter("earlier is null").select(F.col("later").alias("place"))
                          .join(more.select(F.col("later").alias("place")).distinct(), "place", "left_anti"), f"{folder}/again")
    if not again.isEmpty():
        asks = through_table(left_over.join(again, "place", "left_semi").select(*_POSTING), f"{folder}/open-again")
        all_ = through_table(_all_before(sets, asks, by_band, similarity, part, None).distinct().join(rest, ["earlier", "later"], "left_anti"), f"{folder}/all")
        found = found.unionByName(verify(docs, all_, similarity, f"{folder}/all-found"))
    for name in ("candidates", "best", "open", "rest", "again", "open-again", "all"):
        drop_table(docs.sparkSession, f"{folder}/{name}")
    return found


def _long_band_keys(by_word: np.ndarray, long: int):
    """Keys of word and band of the postings of a batch of sets that stand in long lists."""
    def keys(batch: pa.RecordBatch) -> np.ndarray:
        row, token, _ = _exploded(batch)
        cut = _level(by_word, token) >= long.bit_length()
        return _band_key(token[cut], _band(batch.column("size").to_numpy()[row[cut]]))

    return keys


def _all_before(sets: DataFrame, left_over: DataFrame, by_band: np.ndarray, similarity: float, part: int, closest: int | None) -> DataFrame:
    """Candidates (earlier, later) of the postings in ``left_over`` among all before them in their lists; with ``closest``,
    so many in each part, and (null, later) where there are more.

    Every posting of these lists stands in the part of its word, band and hash, those of ``left_over`` ask all parts of
    the bands they can meet.
    """
    word = F.col("token").bitwiseAND(F.lit((1 << 48) - 1))
    wanted = wanted_filter(left_over.select(word.alias("place")).distinct())
    shared = sets.sparkSession.sparkContext.broadcast((wanted, by_band))

    def members(batches: Iterator[pa.RecordBatch]):
        wanted, by_band = shared.value
        for batch in batches:
            row, token, at = _exploded(batch)
            keep = in_filter(wanted, token)
            row, token, at = row[keep], token[keep], at[keep]
            size, place = (batch.column(c).to_numpy()[row] for c in ("size", "place"))
            yield _posting_batch(batch, row, _cut_keys(token, size, place, by_band, part), at)

    def ask(batches: Iterator[pa.RecordBatch]):
        by_band = shared.value[1]
        for batch in batches:
            x = _columns(batch)
            token, n, p = x["token"].view(np.uint64) & _TOKEN, x["size"].astype(np.int64), x["at"].astype(np.int64)
            least, most = np.ceil(similarity * n - 1e-9), np.floor(n / similarity + 1e-9)
            most = np.where(p == 0xFFFF, most, np.minimum(most, np.floor((n - p) * (1 + similarity) / similarity - n + 1e-6)))
            row = np.flatnonzero(most >= least)
            low = _band(least[row])
            bands = (_band(most[row]) - low + np.uint64(1)).astype(np.int64)
            row, band = np.repeat(row, bands), np.repeat(low, bands) + _counted(bands)
            salts = _salts(_level(by_band, _band_key(token[row], band)), part).astype(np.int64)
            row, band, salt = np.repeat(row, salts), np.repeat(band, salts), _counted(salts)
            for at in range(0, len(row), 1 << 16):
                some = slice(at, at + (1 << 16))
                yield _posting_batch(batch, row[some], _part(token[row[some]], band[some], salt[some]), x["at"][row[some]].astype(np.int32))

    both = (sets.select("doc_id", "line", "place", "size", "parity", "prefix").mapInArrow(members, _POSTINGS).withColumn("asks", F.lit(0))
            .unionByName(left_over.mapInArrow(ask, _POSTINGS).withColumn("asks", F.lit(1))))
    return both.repartition("token").sortWithinPartitions("token", "asks").mapInArrow(_answer(similarity, closest), "earlier bigint, later bigint")


def _counted(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2 and so on for each of the lengths."""
    return (np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.uint64)


def _answer(similarity: float, closest: int | None, cells: int = 1 << 21):
    """Over postings in order of part and ``asks``: candidates (earlier, later) of those that ask among the others of
    their part, at most ``closest`` each, those with the nearest sketches; (null, later) says that there are more. Of the
    running part, the others are held; about ``cells`` pairs are compared at once."""
    def run(batches: Iterator[pa.RecordBatch]):
        held = None
        for batch in _joined(batches, 200_000):
            x = _columns(batch, (*_POSTING, "asks"))
            x["doc_id"] = batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()  # rows without an id come first
            if held is not None and held["token"][0] == x["token"][0]:
                x = {c: np.concatenate([held[c], x[c]]) for c in x}
            opens = group_starts(x["token"])
            ends = np.append(opens[1:], len(x["token"]))
            firsts = opens + np.add.reduceat(1 - x["asks"], opens)  # where those that ask begin
            earlier, later, more = ([np.zeros(0, np.int64)] for _ in range(3))
            for g in np.flatnonzero((firsts > opens) & (ends > firsts)):
                start, first = int(opens[g]), int(firsts[g])
                step = max(1, cells // (first - start))
                sketch = x["parity"][start:first].view(np.uint64)
                top = int(x["size"][start:first].max())
                for at in range(first, int(ends[g]), step):
                    ask = slice(at, min(at + step, int(ends[g])))
                    # what two sets may differ in is at most so much at the largest size of the part
                    limit = np.floor((x["size"][ask].astype(np.int64) + top) * (1 - similarity) / (1 + similarity) + 1e-6)
                    i, j = np.nonzero(np.bitwise_count(x["parity"][ask].view(np.uint64)[:, None] ^ sketch) <= limit[:, None])
                    i, j = i + at, j + start
                    good = _may_match(x, i, j, similarity)
                    i, j = i[good], j[good]
                    order = [(x[c][i], x[c][j]) for c in ("doc_id", "line", "place")]
                    before = order[2][1] < order[2][0]
                    for a, b in (order[1], order[0]):
                        before = (b < a) | ((b == a) & before)
                    i, j = i[before], j[before]
                    if closest is not None and len(i):
                        nearest = np.lexsort((np.bitwise_count((x["parity"][i] ^ x["parity"][j]).view(np.uint64)), i))
                        i, j = i[nearest], j[nearest]
                        begun = group_starts(i)
                        rank = np.arange(len(i)) - np.repeat(begun, np.diff(np.append(begun, len(i))))
                        more.append(x["place"][i[rank == closest]])
                        i, j = i[rank < closest], j[rank < closest]
                    earlier.append(x["place"][j])
                    later.append(x["place"][i])
            last = slice(int(opens[-1]), int(firsts[-1]))
            held = {c: x[c][last] for c in x} if last.stop > last.start else None
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(np.concatenate(earlier)), pa.nulls(sum(map(len, more)), pa.int64())]),
                                              pa.array(np.concatenate([*later, *more]))], ["earlier", "later"])

    return run


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines``, ``n_removed`` (bigint) and ``lost_all``.

    ``lost_all`` is true for documents that had lines with words and keep none. Columns of ``docs`` with these names are
    replaced; a null text stays null.
    """
    spark = docs.sparkSession
    small_batches(spark)
    added = ["n_lines", "n_removed", "lost_all"]
    docs = docs.drop("text_hash", "kept", *added)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    folder = new_folder(spark, "line-sets")
    fields = ("doc_id", "line", "place", "text_hash", "size", "parity", "prefix")
    sets = through_table(line_sets(narrow, rarity(narrow), similarity).groupBy("k1", "k2").agg(F.min(F.struct(*fields)).alias("r"))
                         .select("r.*"), folder)
    gone = near_matches(narrow, sets, similarity).select(F.col("later").alias("place")).distinct()
    kept = (sets.select("doc_id", "text_hash", "line", "place").join(gone, "place", "left_anti")
            .groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("line")).alias("kept")))
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    joined = keyed.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
                                   & (F.col("d.text_hash") == F.col("k.text_hash")), "left").select("d.*", "k.kept").drop("text_hash")
    return _apply(joined)


def _apply(joined: DataFrame) -> DataFrame:
    names = [c for c in joined.columns if c != "kept"]
    schema = ", ".join([*(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in names),
                        "n_lines bigint, n_removed bigint, lost_all boolean"])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text"):
            texts, totals, removed, lost = [], [], [], []
            for text, keep in zip(batch.column("text").to_pylist(), batch.column("kept").to_pylist()):
                lines = [] if text is None else text.split("\n")
                stay = set(keep or ())
                left = [line for i, line in enumerate(lines) if i in stay or not _ANY_WORD.search(line)] if len(stay) < len(lines) else lines
                texts.append(None if text is None else text if len(left) == len(lines) else "\n".join(left))
                totals.append(len(lines))
                removed.append(len(lines) - len(left))
                lost.append(len(left) < len(lines) and not stay)
            made = {"text": pa.array(texts, batch.column("text").type)}
            yield pa.RecordBatch.from_arrays(
                [*(made.get(c, batch.column(c)) for c in names), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(lost, pa.bool_())], [*names, "n_lines", "n_removed", "lost_all"])

    return joined.mapInArrow(run, schema)
