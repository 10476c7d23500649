"""Small inputs and plain counterparts that the operators are held against."""
import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"(?:[0-9a-z_]|[^\x00-\x7f])+")


def words(text):
    return WORD.findall((text or "").lower())


def docs(spark, *rows, **extra):
    """Rows of (doc_id, text), with constant extra columns."""
    from pyspark.sql import functions as F

    out = spark.createDataFrame([tuple(r) for r in rows], DOCS)
    for name, value in extra.items():
        out = out.withColumn(name, F.lit(value))
    return out


def table(spark, name, folder=SF):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def prose(n, seed=0, stem="w"):
    """``n`` words that no other seed has."""
    return " ".join(f"{stem}{seed}x{i}" for i in range(n))
