"""Exact word counts, the four-counter classes and their split, and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from .packed import count_classes_packed, count_packed
from .windows import CHUNK, windows

#: A counter above this counts as overflowed in the statistics; counts themselves are exact.
COUNTER_LIMIT = 255
PATHS = ("auto", "packed", "text")


def _check(k: int, order: str, path: str) -> None:
    dna.check_k(k)
    dna.check_order(order)
    if path not in PATHS:
        raise ValueError(f"path must be one of {PATHS}, not {path!r}")


def count_windows(w: DataFrame, k: int, order: str = "reference", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., kmer, count) of a table of windows w, in one aggregate, as a stream needs it."""
    return w.select(*by, dna.canonical_pair(F.col("w"), k, order).alias("kmer")).groupBy(*by, "kmer").agg(F.count("*").alias("count"))


def _distinct(w: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., w, n): canonical forms are then found once for each distinct window, not for each window."""
    return w.groupBy(*by, "w").agg(F.count("*").alias("n"))


def count_kmers(df: DataFrame, k: int, order: str = "reference", seq: str = "seq", path: str = "auto", chunk: int | None = None, spread: int | None = None, partitions: int | None = None, size: int | None = None) -> DataFrame:
    """(kmer, count) of sequences, each word standing for itself and its reverse complement.

    ``path``: 'packed' (also 'auto') for two bits a base in Arrow batches, one shuffle of whole blocks; 'text' for
    DataFrame functions alone. ``spread`` deals the chunks of long sequences to that many tasks. A null sequence has no words.
    """
    _check(k, order, path)
    if path != "text":
        return count_packed(df, k, seq, order, chunk or 1 << 20, spread, partitions, size)
    return _canonical_counts(_distinct(windows(df, k, seq, chunk=chunk or CHUNK, spread=spread)), k, order)


def _canonical_counts(distinct: DataFrame, k: int, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    return distinct.select(*by, dna.canonical_pair(F.col("w"), k, order).alias("kmer"), "n").groupBy(*by, "kmer").agg(F.sum("n").alias("count"))


def count_kmers_by(df: DataFrame, k: int, by: tuple[str, ...], order: str = "reference", seq: str = "seq") -> DataFrame:
    """(by..., kmer, count): the counts of each group of sequences."""
    return _canonical_counts(_distinct(windows(df, k, seq, keep=by), by), k, order, by)


def count_classes(df: DataFrame, k: int, seq: str = "seq", path: str = "auto", chunk: int | None = None, spread: int | None = None, partitions: int | None = None, size: int | None = None) -> DataFrame:
    """(class_kmer, count_i, count_r, count_c, count_rc): a row per class under all four symmetries; arguments as for ``count_kmers``."""
    _check(k, "reference", path)
    if path != "text":
        return count_classes_packed(df, k, seq, chunk or 1 << 20, spread, partitions, size)
    w = _distinct(windows(df, k, seq, chunk=chunk or CHUNK, spread=spread)).select(dna.canonical_v4(F.col("w"), k).alias("v"), "n")
    counters = [F.sum(F.when(F.col("v.transform") == t, F.col("n")).otherwise(0)).alias(f"count_{t.lower()}") for t in ("I", "R", "C", "RC")]
    return w.groupBy(F.col("v.kmer").alias("class_kmer")).agg(*counters)


def split_classes(classes: DataFrame, k: int, order: str = "reference") -> DataFrame:
    """(kmer, count): each class as its one or two pairs with a count above zero."""
    c = F.col("class_kmer")
    pairs = F.array(
        F.struct(dna.canonical_pair(c, k, order).alias("kmer"), (F.col("count_i") + F.col("count_rc")).alias("count")),
        F.struct(dna.canonical_pair(F.reverse(c), k, order).alias("kmer"), (F.col("count_r") + F.col("count_c")).alias("count")),
    )
    return classes.select(F.explode(pairs).alias("p")).where("p.count > 0").select("p.kmer", "p.count")


def stats(classes: DataFrame) -> DataFrame:
    """One row: classes, output_rows, overflow_classes, windows. An empty input gives zeros."""
    i, r, c, rc = (F.col(f"count_{t}") for t in ("i", "r", "c", "rc"))
    rows = F.when(i + rc > 0, 1).otherwise(0) + F.when(r + c > 0, 1).otherwise(0)
    return classes.agg(
        F.count("*").alias("classes"),
        F.coalesce(F.sum(rows), F.lit(0)).alias("output_rows"),
        F.count_if(F.greatest(i, r, c, rc) > COUNTER_LIMIT).alias("overflow_classes"),
        F.coalesce(F.sum(i + r + c + rc), F.lit(0)).alias("windows"),
    )


def spectrum(counts: DataFrame) -> DataFrame:
    """(multiplicity, kmers): how many words have each count. Beyond the reference's own operators."""
    return counts.groupBy(F.col("count").alias("multiplicity")).agg(F.count("*").alias("kmers"))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """(kmer, count_left, count_right) of two counts, zero where a side lacks the word. Beyond the reference's own operators."""
    a, b = left.withColumnRenamed("count", "count_left"), right.withColumnRenamed("count", "count_right")
    return a.join(b, "kmer", "full_outer").na.fill(0, ["count_left", "count_right"])
