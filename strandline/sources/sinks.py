"""Where counts go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tsv_lines(counts: DataFrame) -> DataFrame:
    """(value): word, tab, count; no header line."""
    return counts.select(F.concat_ws("\t", "kmer", F.col("count").cast("string")).alias("value"))


def write_tsv(counts: DataFrame, path: str) -> None:
    tsv_lines(counts).write.mode("overwrite").text(path)


def write_nothing(counts: DataFrame) -> None:
    """Runs the count and throws the rows away."""
    counts.write.format("noop").mode("overwrite").save()
