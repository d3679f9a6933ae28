"""Estimates made before a count: distinct words and the room a fixed hash table for them would take."""

from __future__ import annotations


def estimate_unique(size: int, k: int, fastq: bool = False, gzipped: bool = False) -> int:
    """Expected distinct words of a file of ``size`` bytes, in whole numbers."""
    b = size * 4 if gzipped else size
    b = b // 4 if fastq else b * 9 // 10
    return min(max(b * 12 // 10, 1_000_000), 4**k if k <= 31 else 1 << 62)


def table_capacity(estimate: int) -> int:
    """The power of two, 1024 at least, that holds the estimate with 15 % to spare."""
    need = max(1024, estimate * 115 // 100)
    return 1 << (need - 1).bit_length()


def shuffle_partitions(size: int, k: int, fastq: bool = False, gzipped: bool = False, per_partition: int = 4_000_000) -> int:
    """Partitions for the count's one shuffle, for about ``per_partition`` distinct words each."""
    return max(1, -(-estimate_unique(size, k, fastq, gzipped) // per_partition))
