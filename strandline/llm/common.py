"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import drop, shared_dir

WS = " \t\n\x0b\x0c\r"
#: Java and RE2 class of what separates words.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stored:
    """A DataFrame written to the shared folder and read again: lineage ends there, so a lost executor costs a re-read."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop(self.spark, self.path)


def spare(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column has it, whatever its case."""
    used, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in used:
            n = "_" + n
        used.add(n.lower())
        out.append(n)
    return out


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
