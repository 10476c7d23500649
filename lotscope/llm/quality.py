"""Quality rules kept as a ledger of failure bits.

Every rule is evaluated once per document. The ledger holds what was measured and a bit for each rule that failed, so a
policy, which is a named set of rules that reject, is applied later, by one bit operation and without reading a text
again; policies may be added or changed. How much a rule matters within a policy comes from counting equal bit sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.llm.words import as_text, buffers, hash_words, mix, shingle_hashes, slices

#: Rules in the order of their bits: name and the condition, over the measures, under which a document fails.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 4 * n_words",
    "duplicate_lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
    "shouting": "n_letters > 0 and 10 * n_capitals > 6 * n_letters",
    "long_words": "n_words > 0 and word_chars > 25 * n_words",
}
BASE = ("few_words", "repeated_words")
#: Policies by version: the rules that reject a document.
POLICIES = {"base-1": BASE, "default-1": tuple(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals")
_SPACE = b" \t\n\r\x0b\x0c"
_NOT_SPACE = np.array([b not in _SPACE for b in range(256)])


def _class(letters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(letters)] = True
    return out


_SYMBOL, _CAPITAL = _class(b"#*$%&|<>"), _class(bytes(range(65, 91)))
_LETTER = _CAPITAL | _class(bytes(range(97, 123)))
_WORD_START = _NOT_SPACE & ~_class(bytes(range(128, 192)))  # the first byte of every character in a word


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the MEASURES (bigint) of the whole text; a null text has no words.

    Words are separated by ASCII white space. Lines count if they hold a word; duplicate lines equal an earlier line of
    the text; repeated words lie in a run of three words that the text holds twice or more. Letters and capitals are
    ASCII. Columns with the new names are replaced; rows and other columns stay.
    """
    kept = [c for c in docs.columns if c not in MEASURES]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} bigint" for c in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, text):
            column, n = as_text(batch.column(text)), batch.num_rows
            words = hash_words(column, _NOT_SPACE, lower=False)
            offsets, data = buffers(column)
            at = offsets - offsets[0]

            def per_row(kinds: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(kinds[data[offsets[0]:offsets[-1]]])])
                return sums[at[1:]] - sums[at[:-1]]

            n_words = np.bincount(words.rows, minlength=n)
            lines = [[x for x in t.split("\n") if x.strip(_SPACE.decode())] for t in column.to_pylist()]
            n_lines = np.array([len(x) for x in lines])
            made = {"n_words": n_words, "word_chars": per_row(_WORD_START), "n_symbols": per_row(_SYMBOL), "n_lines": n_lines,
                    "n_dup_lines": n_lines - np.array([len(set(x)) for x in lines]), "n_repeat_words": _repeated(words, n_words),
                    "n_letters": per_row(_LETTER), "n_capitals": per_row(_CAPITAL)}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(made[c].astype(np.int64)) for c in MEASURES)],
                                             [*kept, *MEASURES])

    return docs.mapInArrow(run, schema)


def _repeated(words, n_words: np.ndarray) -> np.ndarray:
    """Words of each row that lie in a three-word run found twice or more in the row."""
    total = len(words.hashes)
    if total < 3:
        return np.zeros(len(n_words), np.int64)
    a, b, c = words.hashes[:-2], words.hashes[1:-1], words.hashes[2:]
    runs = mix(mix(mix(a + words.rows[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + b) + c)
    whole = np.flatnonzero(words.rows[:-2] == words.rows[2:])
    order = whole[np.argsort(runs[whole])]
    same = runs[order[1:]] == runs[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(total, bool)
    start = order[twice]
    for i in range(3):
        covered[start + i] = True
    return np.bincount(words.rows[covered], minlength=len(n_words))


def ledger(docs: DataFrame, text: str = "text", rules: dict[str, str] = RULES) -> DataFrame:
    """``docs`` with the measures and ``failed`` (bigint): bit i is set if the i-th rule failed."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(rules.values())]
    failed = F.lit(0).cast("bigint")
    for bit in bits:
        failed = failed.bitwiseOR(bit.cast("bigint"))
    return measure(docs.drop("failed"), text).withColumn("failed", failed)


def mask(policy: tuple[str, ...], rules: dict[str, str] = RULES) -> int:
    """The bits of a policy's rules."""
    names = list(rules)
    return sum(1 << names.index(name) for name in policy)


def passes(policy: tuple[str, ...], rules: dict[str, str] = RULES) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy, rules)).cast("bigint")) == 0


def ablations(ledger: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES, rules: dict[str, str] = RULES) -> DataFrame:
    """Per policy and rule: documents, those rejected, those the rule fails, and those that only this rule rejects.

    The ledger is counted once by equal bits; everything else is bit arithmetic on at most 2^rules rows.
    """
    counts = ledger.groupBy("failed").agg(F.count("*").alias("n"))
    asked = [(version, name, mask(policy, rules), 1 << list(rules).index(name)) for version, policy in policies.items() for name in policy]
    table = F.explode(F.array(*(F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("bigint").alias("mask"),
                                         F.lit(b).cast("bigint").alias("bit")) for v, r, m, b in asked)))
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0)).alias
    return (counts.withColumn("p", table).select("failed", "n", "p.*").groupBy("policy", "rule")
            .agg(F.sum("n").alias("n_docs"), total(hit != 0)("rejected"), total(F.col("failed").bitwiseAND(F.col("bit")) != 0)("failing"),
                 total(hit == F.col("bit"))("only_this")))
