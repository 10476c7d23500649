"""Secret scanning with an incremental ledger of blobs, in DataFrame operations only.

Every version of every path is addressed by the hash of its content, its blob. The ledger remembers which rule versions
have been run over which blobs, and what each of them found. A run scans each unseen pair of blob and rule version once, however
many paths and versions hold the blob, appends to the ledger, and joins findings back to all paths. A new rule version
rescans the blobs for that rule alone.

Matches are located without leaving the JVM: a pattern anchored at the end of the match before it yields the gap and
the match in turn, and running sums of their lengths are the positions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A pattern whose matches count if their text (or the value, which is the last group) has enough characters."""
    kind: str
    version: str
    pattern: str
    least: int
    of_value: bool = False
    #: A quick test that every text with a match passes.
    hint: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which kinds are listed. Failing matches of access and hex begin inside no good one, so their least
#: length is part of the pattern.
RULES = (
    Rule("assign", "1", "((?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 8, True,
         "(?i:passw|secret|token|api_?key)"),
    Rule("access", "1", "((AKIA[A-Z0-9]{12,}))", 16, False, "AKIA"),
    Rule("hex", "1", "(([0-9a-f]{32,}))", 32, False, "[0-9a-f]{32}"),
    Rule("pem", "1", "((-----BEGIN [A-Z ]*PRIVATE KEY-----))", 1, False, "PRIVATE KEY"),
)
BASE = ("assign", "access", "hex")
_LEDGER = "blob string, rules array<string>, spans array<struct<start:int,rule:string,end:int>>"


def _matches(text: str, rule: Rule, index: int) -> Column:
    """Per match: rule, place in the order of matches, lengths of gap, match and value, in code points."""
    pattern = F.lit(f"\\G(?s:(.*?)){rule.pattern}")
    parts = F.arrays_zip(*(F.regexp_extract_all(text, pattern, F.lit(i)).alias(n) for i, n in ((1, "gap"), (2, "found"), (3, "value"))))
    sized = F.transform(parts, lambda p, at: F.struct(
        F.lit(index).alias("kind"), at.alias("nth"), F.char_length(p["gap"]).alias("gap"), F.char_length(p["found"]).alias("found"),
        F.char_length(p["value"]).alias("value")))
    hit = F.col(text).rlike(rule.hint or rule.pattern) & ~F.array_contains("seen", rule.key)
    return F.when(hit, sized).otherwise(_nothing())


def _nothing() -> Column:
    return F.expr("cast(array() as array<struct<kind:int,nth:int,gap:int,found:int,value:int>>)")


def update_ledger(versions: DataFrame, ledger: str, content: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the blobs of ``versions`` that the ledger (a Parquet folder, which need not exist) has not seen, and append.

    A null content is the empty text. Repeated contents, whichever path or version holds them, are scanned once.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(content), F.lit(""))
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("content")).dropDuplicates(["blob"])
    seen = (read_ledger(spark, ledger).select("blob", F.explode("rules").alias("rule")).groupBy("blob")
            .agg(F.collect_set("rule").alias("seen")))
    keys = F.array(*(F.lit(r.key) for r in rules))
    unseen = (blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.expr("cast(array() as array<string>)")))
              .filter(F.size(F.array_except(keys, "seen")) > 0))
    arrays = F.concat(*(_matches("content", r, i) for i, r in enumerate(rules)))
    scanned = unseen.select("blob", F.array_except(keys, "seen").alias("rules"), arrays.alias("matches"))
    _place(scanned, rules).write.mode("append").parquet(ledger)


def _place(scanned: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Positions from lengths: one row per blob with the spans that count."""
    order = Window.partitionBy("blob", "kind").orderBy("nth")
    least = F.array(*(F.lit(r.least) for r in rules))
    of_value = F.array(*(F.lit(r.of_value) for r in rules))
    rows = scanned.select("blob", "rules", F.explode_outer("matches").alias("m")).select("blob", "rules", "m.*")
    rows = (rows.withColumn("end", F.sum(F.col("gap") + F.col("found")).over(order).cast("int"))
            .withColumn("start", F.col("end") - F.col("found")))
    counts = F.when(F.get(of_value, F.col("kind")), F.col("value")).otherwise(F.col("found")) >= F.get(least, F.col("kind"))
    rule = F.get(F.array(*(F.lit(r.key) for r in rules)), F.col("kind")).alias("rule")
    return rows.groupBy("blob").agg(
        F.first("rules").alias("rules"), F.sort_array(F.collect_list(F.when(counts, F.struct("start", rule, "end")))).alias("spans"))


def read_ledger(spark, ledger: str) -> DataFrame:
    """The ledger, empty if there is none yet."""
    try:
        return spark.read.schema(_LEDGER).parquet(ledger)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], _LEDGER)


def findings(versions: DataFrame, ledger: str, content: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with ``blob`` and ``spans``: start, kind (index into ``rules``) and exclusive end, in code points.

    Every path and version of a blob gets its findings; run ``update_ledger`` first. What versions of rules found that
    are not asked for stays in the ledger. Columns named like the new ones are replaced.
    """
    spark = versions.sparkSession
    keys = F.array(*(F.lit(r.key) for r in rules)) if rules else F.expr("cast(array() as array<string>)")
    asked = F.transform(F.filter("spans", lambda s: F.array_contains(keys, s["rule"])), lambda s: F.struct(
        s["start"].alias("start"), (F.array_position(keys, s["rule"]) - 1).cast("int").alias("kind"), s["end"].alias("end")))
    found = (read_ledger(spark, ledger).select("blob", asked.alias("spans")).filter(F.size("spans") > 0).groupBy("blob")
             .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans")))
    keyed = versions.drop("spans").withColumn("blob", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
    return keyed.join(found, "blob", "left").withColumn(
        "spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")))
