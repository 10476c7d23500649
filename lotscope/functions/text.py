"""Titles, slogans, replies and ids as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotscope import settings as S

NOT_WORD = r"[^\p{L}\p{N}_]"

# --- fixed values: patterns for years, decades and stated lot sizes -----------------------------------------
YEAR = r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"
DECADE_4 = r"(?i)(?<![0-9])((?:19|20)[0-9])0'?s\b"
DECADE_2 = r"(?i)(?<![0-9])'?([0-9])0s\b"
LOT_COUNTS = (
    r"(?i)(?:lot|set|group|grouping|collection)\s+of\s+\(?([0-9]{1,3})",
    r"(?i)(?<![0-9])([0-9]{1,3})\s*\+?\s*"
    r"(?:button|pin|badge|pinback|pinbacks|pins|buttons|badges|pc|pcs|piece|pieces)\b",
    r"(?i)\(([0-9]{1,3})\)\s*(?:button|pin|badge|pinback|pc|pcs|piece)",
)


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def _ints(arr: Column) -> Column:
    return F.transform(arr, lambda x: x.cast("int"))


def extract_years(title: Column) -> Column:
    """Distinct years 1900-2099 standing alone in a text, ascending; empty for NULL."""
    return F.array_sort(F.array_distinct(_ints(_all(F.coalesce(title, F.lit("")), YEAR))))


def extract_decades(title: Column) -> Column:
    """All years covered by decade markers such as 1990s, 1980's, '80s or 00s, ascending."""
    text = F.coalesce(title, F.lit(""))
    long_form = F.transform(_all(text, DECADE_4), lambda d: d.cast("int") * 10)
    short_form = F.transform(_all(text, DECADE_2), lambda d: d.cast("int") * 10
                             + F.when(d.cast("int") >= 7, 1900).otherwise(2000))
    starts = F.array_distinct(F.concat(long_form, short_form))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + 9)))))


def extract_lot_count(title: Column) -> Column:
    """The largest positive stated quantity in a title, or NULL."""
    text = F.coalesce(title, F.lit(""))
    found = F.concat(*[_ints(_all(text, p)) for p in LOT_COUNTS])
    return F.array_max(F.filter(found, lambda n: n > 0))


def normalize_key(c: Column) -> Column:
    """Identity key of a slogan: lower case, word characters only."""
    return F.regexp_replace(F.lower(c), NOT_WORD, "")


def normalize_text(c: Column) -> Column:
    """Loose key of a seller or title: lower case, punctuation removed, inner spaces kept."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", ""))


def basic_norm(c: Column) -> Column:
    """Letters and digits only, lower case (drops the underscore as well)."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def tokenize(c: Column) -> Column:
    """Plain ``a-z0-9`` words; apostrophes vanish first so contractions stay one word."""
    words = F.split(F.lower(F.translate(F.coalesce(c, F.lit("")), "'’", "")), NOT_WORD + "+")
    return F.filter(words, lambda w: w.rlike("^[a-z0-9]+$"))


def content_tokens(c: Column) -> Column:
    """Distinct tokens that are not stopwords."""
    return F.array_except(F.array_distinct(tokenize(c)), F.array(*[F.lit(w) for w in S.STOPWORDS]))


def contains_any(c: Column, words) -> Column:
    """Case-insensitive: does the text contain one of the words? NULL and empty texts do not."""
    text = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a | b, [text.contains(w.lower()) for w in words], F.lit(False))


def is_non_alerting(slogan: Column, patterns=S.PLACEHOLDER_SLOGANS) -> Column:
    return contains_any(slogan, patterns)


def parse_era(c: Column) -> Column:
    """Free text to an era label, "all", or NULL; "all" wins, then eras in declared order."""
    out = F.when(contains_any(c, S.ALL_ALIASES), "all")
    for label, aliases in S.ERA_ALIASES:
        out = out.when(contains_any(c, aliases), label)
    return out


def parse_confirmation(c: Column) -> Column:
    """Reply to a count/era question: struct(count int, era string)."""
    count = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?<![0-9])([0-9]{1,3})(?![0-9])", 1)
    return F.struct(count.try_cast("int").alias("count"), parse_era(c).alias("era"))


def parse_price_source(c: Column) -> Column:
    """Reply "price | source | count": struct(price double, source string, count int); no pipe or no price gives
    (NULL, "", NULL)."""
    parts = F.split(F.coalesce(c, F.lit("")), r"\|")
    price = F.regexp_replace(F.trim(F.regexp_replace(F.trim(parts[0]), r"^\$+", "")), ",", "").try_cast("double")
    ok = c.contains("|") & price.isNotNull()
    count = F.trim(F.get(parts, F.lit(2))).try_cast("int")
    return F.struct(F.when(ok, price).alias("price"),
                    F.when(ok, F.trim(F.get(parts, F.lit(1)))).otherwise("").alias("source"),
                    F.when(ok, count).alias("count"))


def parse_price(c: Column) -> Column:
    """"$1.50" to 1.5; anything unreadable (also "1,200") to 0."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"\$", "")).try_cast("double"), F.lit(0.0))


def amount_needed(c: Column) -> Column:
    """Whole number, else 0 ("3.0" is not whole text, so it counts as 0)."""
    return F.when(F.trim(c).rlike(r"^[+-]?[0-9]+$"), F.trim(c).try_cast("int")).otherwise(0)


def era_year_set(label: Column) -> Column:
    """Years of an era label; empty for "all", unknown or NULL."""
    out = None
    for name, lo, hi in S.ERAS:
        years = F.sequence(F.lit(lo), F.lit(hi))
        out = F.when(label == name, years) if out is None else out.when(label == name, years)
    return out.otherwise(F.array().cast("array<int>"))


def other_era(used: Column, ranked: Column) -> Column:
    """The best era other than the one used: the first different one by votes, else by declaration."""
    by_vote = F.filter(ranked, lambda e: e.isNotNull() & (e != "") & ~e.eqNullSafe(used))
    declared = F.filter(F.array(*[F.lit(e[0]) for e in S.ERAS]), lambda e: ~e.eqNullSafe(used))
    return F.coalesce(F.get(by_vote, F.lit(0)), F.get(declared, F.lit(0)))


def synth_id(seller: Column, title: Column) -> Column:
    """Stable stand-in id for a record that came without one."""
    return F.concat(F.lit("backfill|"), F.substring(F.md5(F.concat(seller, F.char(F.lit(0)), title)), 1, 16))


def is_synthetic(item_id: Column) -> Column:
    return item_id.isNull() | (item_id == "") | item_id.startswith("backfill|")


def truncate_text(c: Column, size: int) -> Column:
    """Cut a display cell to ``size`` characters with a closing ellipsis."""
    return F.when(F.length(c) <= size, c).otherwise(F.concat(F.substring(c, 1, size - 1), F.lit("…")))


def year_int(c: Column) -> Column:
    """Whole number, else the first run of four digits inside the text, else NULL."""
    text = F.trim(c.cast("string"))
    whole = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))
    return F.coalesce(whole, F.regexp_extract(text, r"([0-9]{4})", 1).try_cast("int"))


def year4(c: Column) -> Column:
    """First four digits of a year label, else the trimmed label."""
    digits = F.regexp_replace(c.cast("string"), "[^0-9]", "")
    return F.when(F.length(digits) >= 4, F.substring(digits, 1, 4)).otherwise(F.trim(c.cast("string")))


def label_year(label: Column) -> Column:
    """Year of a reference label: the leading word when it is a whole number."""
    return F.regexp_extract(label, r"^\s*([+-]?[0-9]+)(?:\s|$)", 1).try_cast("int")


def label_phrase(label: Column) -> Column:
    """Everything after the first word of a reference label."""
    return F.regexp_replace(F.regexp_replace(label, r"^\s*\S+", ""), r"^\s+", "")


def shard_of(name: Column, n: int) -> Column:
    """Which of ``n`` workers owns a file name."""
    return F.pmod(F.crc32(name), F.lit(n)).cast("int")
