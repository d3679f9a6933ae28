"""Documents to packed training sequences: quality rules, line dedup, near-duplicate join, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A
stage reads what the stage before it kept, written and read again, so each stands on stored rows.

Defined cases: a document with a null or empty text fails the plain rules, so only rows with words come to the later
stages, which would take them too: line dedup passes them, the join links them with nothing, mixing takes them once and
packing gives the end id. A null id or source is as good as another; repeated rows are judged alike by the rules and
the line dedup, and the join keeps one of them. Without labels every line is content. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import linecrf, linededup, mixing, ngramjoin, packing
from strandline.llm.common import Stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the plain rules don't fail and whose lines the random field calls content, by words, for half or more."""
    return linecrf.keep(docs, linecrf.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of 50 words and more leave their documents; a document all of whose lines go, goes."""
    cut = linededup.dedup_lines(docs, lines="_lines", removed="_removed").where("_removed < _lines")
    return cut.select(*[F.when(F.col("_removed") > 0, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    return ngramjoin.dedup(docs, n=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of small sources again, up to twice as often as those of the largest."""
    return mixing.mix(docs, max_epochs=mixing.MAX_EPOCHS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with the CRC of their ids and their places in sequences of 1024 tokens."""
    return packing.digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("temperature_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has neither the random field nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Stored(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
