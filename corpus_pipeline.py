"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import materialize, table
from brindle.llm.decontamination import drop_contaminated
from brindle.llm.families import one_of_each
from brindle.llm.packing import pack
from brindle.llm.suffixes import remove_repeats
from brindle.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword classifier rejects go."""
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def simhash_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each family of near copies stays."""
    return one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes or more that an earlier document has are cut out."""
    return remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the rest, each with its sequence and place."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_duplicates", simhash_near_duplicates),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Learned scores, fingerprints and packing are not SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
