"""Row shapes of the written tables, and the writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope import settings as S

# --- fixed values: column order of the flat master table ----------------------------------------------------
MASTER_COLUMNS = [
    "observed_at", "sources", "times_seen", "item_id", "seller", "title",
    "asking", "has_price", "currency", "buying_format", "condition", "bid_count",
    "title_count", "crops_scored", "years", "best_score", "best_year",
    "best_slogan", "needed_hit", "listing_url",
]


def label_name(job: Column, suffix: str = ".json") -> Column:
    """Object name of a label record; slashes of the job id become underscores."""
    return F.concat(F.lit(S.LABELS_PREFIX), F.translate(job, "/", "_"), F.lit(suffix))


def append_scan_log(records: DataFrame, path: str) -> None:
    """Append records as JSON lines, each file compressed: field names and matches repeat, so a log is mostly repetition."""
    records.write.mode("append").option("zlib.compress.level", "BEST_SPEED").json(path, compression="gzip")


def to_flat_master(master: DataFrame) -> DataFrame:
    """Master rows as a flat sheet: years joined by ";", flags as yes/no, fixed column order."""
    flag = lambda name: F.when(F.coalesce(name, F.lit(False)), "yes").otherwise("no").alias(name)
    special = {"years": F.array_join("years", ";").alias("years"), "has_price": flag("has_price"), "needed_hit": flag("needed_hit")}
    return master.select(*[special.get(name, F.col(name)) for name in MASTER_COLUMNS])


def flat_cells(records: DataFrame) -> DataFrame:
    """Flatten log records for a sheet: structs to prefixed columns, arrays and maps to JSON, NULL to "",
    booleans to TRUE/FALSE. Column names and order follow the record's schema."""
    from pyspark.sql import types as T

    out = []

    def visit(field, path, name):
        kind, value = field.dataType, F.col(path)
        if isinstance(kind, T.StructType):
            for child in kind.fields:
                visit(child, f"{path}.{child.name}", f"{name}_{child.name}")
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            out.append(F.coalesce(F.to_json(value), F.lit("[]" if isinstance(kind, T.ArrayType) else "{}")).alias(f"{name}_json"))
        elif isinstance(kind, T.BooleanType):
            out.append(F.coalesce(F.upper(value.cast("string")), F.lit("")).alias(name))
        else:
            out.append(F.coalesce(value.cast("string"), F.lit("")).alias(name))

    for field in records.schema.fields:
        visit(field, field.name, field.name)
    return records.select(*out)
