"""From a file to counts, as one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna, sizing
from ..operators.count import count_classes, count_kmers, stats
from ..sources.sequences import detect_format, file_bytes, read_windows
from ..sources.sinks import write_tsv

#: Bytes of a file whose chunks one task counts, unless ``spread`` says otherwise.
TASK_BYTES = 1 << 25


def _plan(spark: SparkSession, path: str, k: int, format: str, spread: int | None) -> tuple[str, DataFrame, dict]:
    """The format, the sequences, and how many tasks count chunks and merge words: chunks are dealt anew, or tasks read stretches of plain FASTA, so that one long record or one gzip file is not one task."""
    kind = detect_format(spark, path) if format == "auto" else format
    size, gzip = file_bytes(spark, path), path.endswith(".gz")
    least = spark.sparkContext.defaultParallelism
    plain = size * 4 if gzip else size
    spread = spread or max(least, -(-plain // TASK_BYTES))
    rows, dealt = read_windows(spark, path, k, kind, max(1 << 16, -(-plain // spread)))
    return kind, rows, {"spread": None if dealt else spread, "partitions": max(least, sizing.shuffle_partitions(size, k, kind == "fastq", gzip)), "size": plain}


def count_file(spark: SparkSession, path: str, k: int, format: str = "auto", order: str = "reference", kind: str = "auto", spread: int | None = None) -> DataFrame:
    """(kmer, count) of a FASTA or FASTQ file, plain or gzip."""
    dna.check_k(k)
    _, rows, plan = _plan(spark, path, k, format, spread)
    return count_kmers(rows, k, order, path=kind, **plan)


def count_file_to_tsv(spark: SparkSession, path: str, k: int, out: str, **options) -> None:
    write_tsv(count_file(spark, path, k, **options), out)


def run_statistics(spark: SparkSession, path: str, k: int, format: str = "auto") -> DataFrame:
    """One row about a run: the words and bytes of a fixed table's entry, the file's format, the estimate and the table's room
    made from its size, the counts of ``stats`` and how full such a table would be."""
    dna.check_k(k)
    found, rows, plan = _plan(spark, path, k, format, None)
    gzip = path.endswith(".gz")
    estimate = sizing.estimate_unique(file_bytes(spark, path), k, found == "fastq", gzip)
    room = sizing.table_capacity(estimate)
    about = {"k": k, "words": -(-k // 32), "entry_bytes": 8 * -(-k // 32) + 4, "format": found, "gzip": gzip, "estimated_kmers": estimate, "capacity": room}
    row = stats(count_classes(rows, k, **plan))
    return row.select(*[F.lit(v).cast("long" if type(v) is int else "string" if type(v) is str else "boolean").alias(n) for n, v in about.items()], "*", (F.col("classes") / F.lit(room)).alias("load_factor"))
