"""A training corpus from raw documents: quality rules, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of documents; the last returns where each piece of each document stands in the training sequences.

All stages take null, empty and very long texts, ties, repeated rows, null ids, empty tables and extra columns of any name; what
each case gives is said below.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orrery.llm.common import table
from orrery.llm.minhash import keep_one_of_each
from orrery.llm.packing import pack
from orrery.llm.quality_rules import keep_quality
from orrery.llm.scratch import Scratch
from orrery.llm.toxicity import keep_clean

CAPACITY = 2048


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees.

    Null and empty texts fail the base rules and go; very long ones are measured whole. A score at the limit keeps. Rows are judged one by one,
    so rows that repeat stay or go together, and null ids stay. Extra columns are kept; an empty table stays empty.
    """
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.

    Null and empty texts get the score of labelled documents without known words; very long ones are read whole. A score at the limit
    is toxic; of equally near examples the first in the index counts. Rows are judged one by one, null ids stay, extra columns are
    kept, an empty table stays empty.
    """
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one of the smallest id.

    Null, empty and wordless texts are like nothing and stay, once for each id; very long texts are one set. Of texts of several sets under
    the smallest id the one of the smallest digest stands for the group; unlike texts under one id are apart. Of rows with one id
    and one set one stays; rows with a null id all stay. Extra columns are kept; an empty table stays empty.
    """
    return keep_one_of_each(docs, width=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents in training sequences of CAPACITY tokens.

    Null and empty texts have one piece without tokens; very long ones have as many pieces as they need. Pieces of one length go by id,
    source and words; of bins with the same room the oldest is taken. Rows that repeat and rows of a null id are packed each for
    itself. Extra columns are ignored; an empty table gives an empty result.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), CAPACITY)


STAGES = [("quality_rules", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("best_fit_packing", packing_stage)]

#: Trained trees, nearest-neighbour votes and packing are not SQL; tests/llm/test_pipeline.py holds run() against its operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents", spread=True)
    scratch = Scratch(spark)
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
