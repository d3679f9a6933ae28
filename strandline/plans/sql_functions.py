"""The expressions of ``functions.dna`` under names for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DEFINITIONS = {
    "dna_complement(w STRING)": "translate(w, 'ACGT', 'TGCA')",
    "dna_revcomp(w STRING)": "reverse(translate(w, 'ACGT', 'TGCA'))",
    "dna_ref_key(w STRING)": "concat(reverse(substr(w, 1, 32)), reverse(substr(w, 33, 32)), reverse(substr(w, 65, 32)), reverse(substr(w, 97, 32)))",
    "dna_canonical(w STRING)": "CASE WHEN dna_ref_key(w) <= dna_ref_key(dna_revcomp(w)) THEN w ELSE dna_revcomp(w) END",
    "dna_canonical_lex(w STRING)": "least(w, dna_revcomp(w))",
}


def register(spark: SparkSession) -> list[str]:
    """Creates temporary SQL functions and returns their names."""
    for head, body in _DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS STRING RETURN {body}")
    return [h.split("(")[0] for h in _DEFINITIONS]
