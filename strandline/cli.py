"""python -m strandline.cli INPUT K OUTPUT: counts of a FASTA or FASTQ file as tab-separated text."""

from __future__ import annotations

import sys

from .functions.dna import check_k


def main(args: list[str]) -> int:
    if len(args) != 3:
        print(__doc__, file=sys.stderr)
        return 1
    try:
        k = check_k(int(args[1]))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from .plans.runner import count_file_to_tsv

    count_file_to_tsv(SparkSession.builder.getOrCreate(), args[0], k, args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
