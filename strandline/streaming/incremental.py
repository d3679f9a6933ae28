"""Word counts of FASTA files as they arrive. Beyond the reference's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.count import count_windows
from ..operators.windows import windows


def stream_counts(spark: SparkSession, folder: str, k: int, order: str = "reference", files_per_trigger: int = 100) -> DataFrame:
    """A streaming (kmer, count), for output mode 'complete' or 'update'; the state holds one row per distinct word."""
    chunks = spark.readStream.option("lineSep", ">").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    seq = F.expr("case when instr(value, '\n') > 0 then replace(substring(value, instr(value, '\n') + 1), '\n', '') else '' end")
    return count_windows(windows(chunks.select(seq.alias("seq")), k), k, order)
