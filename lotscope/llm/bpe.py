"""Byte-level BPE: exact encoding by backtracking over longest matches, and decoding through an offset table.

A piece of text is encoded without running its merges. An Aho-Corasick automaton gives the longest token at each
position; the encoder keeps it only if it may stand after the token before it. Two tokens may stand
side by side exactly if no merge ever crosses their border, which is read off the merge trees of both and remembered.
Where nothing fits, the last token is taken back and the next shorter one tried; a byte position given up is never
entered again, so the work stays linear. A row of tokens in which all neighbours are compatible is the one that the
merges would make.

Texts are cut into pieces first (words with their leading space, runs of digits, marks or white space). Added tokens
that stand in a text are cut out before that.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.llm.tables import small_batches
from lotscope.llm.words import as_text, slices

# Fixed value: how this family of tokenizers cuts text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the white space of Unicode.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# No piece crosses a border of these coarser cuts: a run without white space, with one space before it, or white space.
_RUNS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: A vocabulary travels to every worker, so its file may not be larger than this.
MAX_VOCABULARY_BYTES = 64 << 20
#: Runs, and pieces, remembered by a task; a memory is emptied when full, which changes no result.
REMEMBERED = 300_000


def byte_letters() -> dict[str, str]:
    """The letter that stands for each byte in a vocabulary file, mapped to that byte as a Latin-1 character."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(hidden)}


class Vocabulary:
    """Token tables made from the text of a vocabulary file (JSON with ``model.vocab`` and ``model.merges``)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, letters = spec["model"], byte_letters()
        plain = lambda token: "".join(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.id_of = {plain(t): i for t, i in model["vocab"].items() if t not in self.added}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank
        for rank, (a, b) in enumerate(merges):
            left, right = self.id_of[plain(a)], self.id_of[plain(b)]
            self.merge_rank.setdefault((left, right), rank)
            self.parts.setdefault(self.id_of[plain(a) + plain(b)], (left, right, rank))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._runs: dict[str, tuple[int, ...]] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        size = max([*self.id_of.values(), *self.added.values()]) + 1
        usable = {t: i for t, i in self.id_of.items() if (len(t) == 1 or i in self.parts) and self._stands_alone(i)}
        self.lengths, self.shorter = [0] * size, [-1] * size  # bytes; the longest token that this one begins with
        for token, i in usable.items():
            self.automaton.add_word(token, i)
            self.lengths[i] = len(token)
            self.shorter[i] = next((usable[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in usable), -1)
        self.automaton.make_automaton()
        spelled = [b""] * size
        for token, i in self.id_of.items():
            spelled[i] = token.encode("latin-1")
        for content, i in self.added.items():
            spelled[i] = content.encode()
        self.starts = np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int64)
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.names = [str(i) for i in range(size)]
        self._cut = regex.compile(PIECES)
        self._added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that lie at one border of ``token`` while it is being merged, with the rank that ends each."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until = self.parts[token][2]
            token = self.parts[token][side]

    def _crossed(self, left: int, right: int, below: float) -> bool:
        """Whether a merge of rank under ``below`` joins what lies on the two sides of the border."""
        for a, a_ends in self._edge(left, 1):
            for b, b_ends in self._edge(right, 0):
                rank = self.merge_rank.get((a, b))
                # of two equal merges the left one goes first
                if rank is not None and rank < below and rank < a_ends and rank <= b_ends:
                    return True
        return False

    def _stands_alone(self, token: int) -> bool:
        """Whether the bytes of ``token`` are merged into it; others are never produced."""
        if token not in self.parts:
            return True
        left, right, rank = self.parts[token]
        return not self._crossed(left, right, rank)

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side in an encoding."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= 4 * REMEMBERED:
                self._pairs.clear()
            known = self._pairs[left, right] = not self._crossed(left, right, float("inf"))
        return known

    def forget(self) -> None:
        """Empty the memories; what comes after in the same worker has the space."""
        for memory in (self._pairs, self._runs, self._pieces):
            memory.clear()

    def encode_piece(self, piece: str) -> list[int]:
        """Encode one piece by backtracking over longest matches."""
        data = piece.encode().decode("latin-1")
        n = len(data)
        lengths, shorter, pairs = self.lengths, self.shorter, self._pairs
        dead: set[int] = set()
        out: list[int] = []
        at, last = 0, -1
        matches = self.automaton.iter_long(data)  # longest tokens side by side, as long as each is taken
        while at < n:
            if matches is None:
                matches = self.automaton.iter_long(data, at)
            stop, token = next(matches, (-1, -1))
            if stop + 1 - lengths[token] != at:
                raise ValueError("the vocabulary has no token for a byte of this text")
            longest = token
            while True:
                while token >= 0:
                    end = at + lengths[token]
                    if end not in dead:
                        if last < 0:
                            break
                        fits = pairs.get((last, token))
                        if self.compatible(last, token) if fits is None else fits:
                            break
                    token = shorter[token]
                if token >= 0:
                    break
                if not out:
                    raise ValueError("this text has no encoding")
                # nothing can stand here: take the last token back and go on with the next shorter one
                dead.add(at)
                matches = None
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]
                last = out[-1] if out else -1
            if token != longest:
                matches = None
            out.append(token)
            last, at = token, end
        return out

    def encode(self, text: str) -> list[int]:
        """Token ids of a whole text."""
        ids: list[int] = []
        at = 0
        for found in self._added.finditer(text) if self._added else ():
            self._encode_plain(text[at:found.start()], ids)
            ids.append(self.added[found.group()])
            at = found.end()
        self._encode_plain(text[at:] if at else text, ids)
        return ids

    def _encode_plain(self, text: str, ids: list[int]) -> None:
        known = self._runs
        for run in _RUNS.findall(text):
            tokens = known.get(run)
            if tokens is None:
                tokens = self._encode_run(run)
                if len(run) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[run] = tokens = tuple(tokens)
            ids += tokens

    def _encode_run(self, run: str) -> list[int]:
        tokens: list[int] = []
        for piece in self._cut.findall(run):
            found = self._pieces.get(piece)
            if found is None:
                found = self.encode_piece(piece)
                if len(piece) <= 64:
                    if len(self._pieces) >= REMEMBERED:
                        self._pieces.clear()
                    self._pieces[piece] = found = tuple(found)
            tokens += found
        return tokens

    def decode(self, ids: np.ndarray) -> str:
        """Text of token ids: their bytes, found by offset, side by side."""
        first = self.starts[ids]
        lengths = self.starts[ids + 1] - first
        ends = np.cumsum(lengths)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - lengths), lengths)
        return self.spelling[index].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


def load_vocabulary(path: str) -> str:
    """Text of a vocabulary file that the driver reads once; it is checked against MAX_VOCABULARY_BYTES."""
    with open(path, encoding="utf-8") as file:
        text = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(text) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is too large to send to every worker")
    return text


def _append(df: DataFrame, source: str, columns: dict[str, str], vocabulary_text: str, fill) -> DataFrame:
    """Add columns that ``fill(vocabulary, batch)`` makes from a column of texts or ids, under the same row order."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_text)
    taken = [c for c in df.columns if c not in columns]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in taken),
                        *(f"`{c}` {kind}" for c, kind in columns.items())])
    is_text = df.schema[source].dataType.simpleString() == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(shared.value)
        try:
            for batch in slices(batches, source) if is_text else batches:
                if batch.num_rows:
                    made = fill(table, batch)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in taken), *made], [*taken, *columns])
        finally:
            table.forget()

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, vocabulary_text: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column of token ids of the whole text; a null or empty text has no ids.

    A column of ``df`` that is named like the new one is replaced. Rows, repeated ones too, and all other columns stay.
    """
    def fill(table, batch):
        rows = [table.encode(t) for t in as_text(batch.column(text)).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        flat = np.fromiter((i for r in rows for i in r), np.int32, count=int(offsets[-1]))
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]

    return _append(df, text, {ids: "array<int>"}, vocabulary_text, fill)


def decode(df: DataFrame, vocabulary_text: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of a column of token ids; null ids give the empty text.

    Bytes that form no character are shown as U+FFFD. A column named like the new one is replaced.
    """
    def fill(table, batch):
        lists = batch.column(ids)
        flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False)
        valid = lists.is_valid().to_numpy(zero_copy_only=False)
        return [pa.array([table.decode(flat[a:b].astype(np.int64)) if v else "" for a, b, v in zip(offsets, offsets[1:], valid)])]

    return _append(df, ids, {text: "string"}, vocabulary_text, fill)


def round_trip(df: DataFrame, vocabulary_text: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids``, ``n_tokens`` and the ``decoded`` text of its ids."""
    coded = encode(df, vocabulary_text, text)
    return decode(coded, vocabulary_text).withColumn("n_tokens", F.size("ids").cast("long"))


def digest(df: DataFrame, vocabulary_text: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, and SHA-256 of its decimal ids joined by commas and of the decoded text.

    One pass: each batch is encoded, decoded and digested before the next one is read, so ids and decoded texts never
    leave the task.
    """
    import hashlib

    sha = lambda data: hashlib.sha256(data).hexdigest()

    def fill(table, batch):
        counts, coded, decoded = [], [], []
        for t in as_text(batch.column(text)).to_pylist():
            ids = table.encode(t)
            counts.append(len(ids))
            coded.append(sha(",".join([table.names[i] for i in ids]).encode()))
            decoded.append(sha(table.decode(np.array(ids, np.int64)).encode()))
        return [pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]

    return _append(df, text, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, vocabulary_text, fill)
