"""Unbroken runs of bases, overlapping chunks of long runs, and the windows of k bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna

#: Windows that begin in one chunk: long sequences are cut to this, with k - 1 bases of overlap.
CHUNK = 1 << 16


def runs(df: DataFrame, seq: str = "seq", keep: tuple[str, ...] = (), min_length: int = 1) -> DataFrame:
    """(keep..., run_idx, run): the maximal runs of ACGTacgt, in upper case."""
    found = df.select(*keep, F.posexplode(F.regexp_extract_all(seq, F.lit("[ACGTacgt]+"), F.lit(0))).alias("run_idx", "run"))
    return found.where(F.length("run") >= min_length).withColumn("run", dna.normalise(F.col("run")))


def chunks(df: DataFrame, k: int, col: str = "run", size: int = CHUNK, start: str | None = None) -> DataFrame:
    """Cuts runs so that every window of k bases begins in exactly one piece; ``start`` names an offset column to add.

    One walk along the run: each match takes ``size`` bases and looks k - 1 further. A substring by position would walk
    from the run's start for each piece.
    """
    dna.check_k(k)
    if size < 1:
        raise ValueError("size must be positive")
    others = [c for c in df.columns if c != col]
    found = F.regexp_extract_all(col, F.lit(f"(?=([ACGT]{{{k},{size + k - 1}}}))[ACGT]{{1,{size}}}"), F.lit(1))
    cut = df.where(F.length(col) >= k).select(*others, F.posexplode(found).alias("_nth", "_piece"))
    return cut.select(*others, F.col("_piece").alias(col), *([(F.col("_nth").cast("long") * size).alias(start)] if start else []))


def kmers(df: DataFrame, k: int, col: str = "run", pos: str | None = None) -> DataFrame:
    """One row per window of k bases, as column w; ``pos`` names a column for its place in the run, from 0."""
    dna.check_k(k)
    found = F.regexp_extract_all(col, F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.posexplode(found).alias(pos, "w")) if pos else df.select(*others, F.explode(found).alias("w"))


def windows(df: DataFrame, k: int, seq: str = "seq", keep: tuple[str, ...] = (), chunk: int = CHUNK, spread: int | None = None) -> DataFrame:
    """(keep..., w) of whole sequences. ``spread`` deals the chunks of few long sequences to that many tasks."""
    cut = chunks(runs(df, seq, keep, k).drop("run_idx"), k, size=chunk)
    return kmers(cut.repartition(spread) if spread else cut, k)
