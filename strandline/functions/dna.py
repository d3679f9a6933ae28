"""Column expressions over DNA words: the four symmetries, the reference order and the canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_K = 127
#: Words compare in blocks of this many bases, each block from its last base to its first.
BLOCK = 32
ORDERS = ("reference", "lex")


def check_k(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int):
        raise TypeError(f"k must be a whole number, not {k!r}")
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}, not {k}")
    return k


def check_order(order: str) -> str:
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}, not {order!r}")
    return order


def normalise(run: Column) -> Column:
    """Upper case for the four bases. upper() would make bases out of other letters."""
    return F.translate(run, "acgt", "ACGT")


def complement(w: Column) -> Column:
    return F.translate(w, "ACGT", "TGCA")


def reverse(w: Column) -> Column:
    return F.reverse(w)


def revcomp(w: Column) -> Column:
    return F.reverse(complement(w))


def ref_key(w: Column, k: int) -> Column:
    """A string whose byte order is the reference order of words of length k."""
    parts = [F.reverse(F.substring(w, at, min(BLOCK, k - at + 1))) for at in range(1, k + 1, BLOCK)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def canonical_pair(w: Column, k: int, order: str = "reference") -> Column:
    """The smaller of a word and its reverse complement. The two orders agree on it up to k = 32."""
    rc = revcomp(w)
    if check_order(order) == "lex" or k <= BLOCK:
        return F.least(w, rc)
    return F.when(ref_key(w, k) <= ref_key(rc, k), w).otherwise(rc)


def canonical_v4(w: Column, k: int) -> Column:
    """struct(kmer, transform): the smallest of the four images, ties in the order I, RC, C, R."""
    images = [("I", w), ("RC", revcomp(w)), ("C", complement(w)), ("R", F.reverse(w))]
    options = [F.named_struct(F.lit("key"), ref_key(x, k), F.lit("p"), F.lit(p), F.lit("kmer"), x, F.lit("transform"), F.lit(t)) for p, (t, x) in enumerate(images)]
    best = F.array_min(F.array(*options))
    return F.named_struct(F.lit("kmer"), best["kmer"], F.lit("transform"), best["transform"])


def transforms(w: Column) -> list[Column]:
    """The word's four images as columns i, r, c, rc."""
    return [w.alias("i"), F.reverse(w).alias("r"), complement(w).alias("c"), revcomp(w).alias("rc")]
