"""Keyed state that micro-batches are merged into, kept as Parquet folders.

A batch is reduced to one row per key and written as a delta; every few batches the deltas are merged with the last base
into a new base, cut into buckets by a hash of the key. So a batch costs what it holds, reading costs the size of the
state and never that of the history, and what a batch did is known by its run and number: one that is replayed, even
after its delta was merged, changes nothing. A run is a streaming query with its checkpoint; a lost checkpoint begins a
new one, whose batches are new.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotscope.plans.files import complete_folders, delete_folder

_MERGE = {"min": F.min, "max": F.max, "sum": F.sum}


def run_of(rows: DataFrame) -> str:
    """Name of the run that a micro-batch belongs to: the id that the query keeps in its checkpoint."""
    return rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


class MergedState:
    """State of ``keys`` (name to type) with ``measures`` (name to merge and type, the merge being min, max or sum)."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], measures: dict[str, tuple[str, str]], buckets: int = 16, every: int = 8):
        self.spark, self.path, self.keys, self.measures, self.buckets, self.every = spark, path, keys, measures, buckets, every
        self.schema = ", ".join(f"{n} {t}" for n, t in [*keys.items(), *((n, t) for n, (_, t) in measures.items())])

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*(_MERGE[kind](n).cast(t).alias(n) for n, (kind, t) in self.measures.items()))

    def _base(self) -> tuple[str | None, dict[str, int]]:
        """The last base, and the last batch of every run that it holds."""
        done = complete_folders(self.spark, f"{self.path}/folded")
        if not done:
            return None, {}
        rows = self.spark.read.schema("run string, batch bigint").parquet(f"{self.path}/folded/{done[-1]}").collect()  # a row a run
        return done[-1], {r.run: r.batch for r in rows}

    def _deltas(self, folded: dict[str, int]) -> dict[tuple[str, int], str]:
        """Deltas that the base does not hold, by run and batch."""
        found = {}
        for name in complete_folders(self.spark, f"{self.path}/delta"):
            run, batch = name.rsplit(".", 1)
            if int(batch) > folded.get(run, -1):
                found[run, int(batch)] = f"{self.path}/delta/{name}"
        return found

    def has(self, run: str, batch: int) -> bool:
        """Whether the batch was merged."""
        _, folded = self._base()
        return batch <= folded.get(run, -1) or (run, batch) in self._deltas(folded)

    def read(self) -> DataFrame:
        """The state: one row per key."""
        version, folded = self._base()
        parts = [self.spark.read.schema(self.schema).parquet(p) for p in self._deltas(folded).values()]
        if version is not None:
            base = self.spark.read.schema(self.schema).parquet(f"{self.path}/base/{version}")
            if not parts:
                return base.select(*self.keys, *self.measures)
            parts.append(base.select(*self.keys, *self.measures))
        return self._merged(reduce(DataFrame.unionByName, parts)) if parts else self.spark.createDataFrame([], self.schema)

    def merge(self, rows: DataFrame, batch: int, run: str | None = None) -> None:
        """Merge the rows (keys and measures) of a batch; a batch that was merged before is left alone."""
        run = run_of(rows) if run is None else run
        version, folded = self._base()
        if batch <= folded.get(run, -1):
            return
        self._merged(rows).write.mode("overwrite").parquet(f"{self.path}/delta/{run}.{batch}")
        if len(self._deltas(folded)) >= self.every:
            self.compact()

    def compact(self) -> None:
        """Merge all deltas into a new base. The old one stays until the next time, for those who read it."""
        version, folded = self._base()
        deltas = self._deltas(folded)
        if not deltas:
            return
        new = f"{int(version or 0) + 1:010d}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))
        self.read().withColumn("bucket", bucket).repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/{new}")
        for run, batch in deltas:
            folded[run] = max(batch, folded.get(run, -1))
        self.spark.createDataFrame(list(folded.items()), "run string, batch bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/folded/{new}")
        for path in deltas.values():
            delete_folder(self.spark, path)
        for kind in ("base", "folded"):
            for name in complete_folders(self.spark, f"{self.path}/{kind}"):
                if name < (version or ""):
                    delete_folder(self.spark, f"{self.path}/{kind}/{name}")
