"""Reference banks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.functions import text as tx


def load_bank(labelled: DataFrame) -> DataFrame:
    """Image bank from (ref_id, label, embedding): the label's leading year and the slogan after it.
    References without a readable year cannot vote and are dropped."""
    return labelled.select("ref_id", tx.label_year(F.col("label")).alias("year"), tx.label_phrase(F.col("label")).alias("phrase"),
                           "embedding").where("year is not null")
