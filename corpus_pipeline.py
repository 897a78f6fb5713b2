"""A training-corpus pipeline: drop toxic documents, keep one of each near-duplicate group, mix the sources, encode.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet to the shared folder and reads again as the next stage's documents. All stages but the last return the columns
of documents; from the mix on a row also carries ``mix_position``, its place in training order, which the last stage hands on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brindle.llm import bpe, curriculum, simhash, toxicity
from brindle.llm.common import table, written
from brindle.llm.queries import bpe_digest


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity stays under one half. Labels of documents that are not here teach nothing.

    Null and empty texts get the rate of examples without terms; equal texts stay or go together; rows without id are scored
    like any other; without labels nothing goes; an empty table stays empty.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: five-word shingles, fingerprints within two bits or texts 0.8 alike.

    It is the row of the smallest id, a null id last, and of the smallest hash of the text where texts share that id. All texts
    without a word are one group. An empty table stays empty.
    """
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum in training order: a row for each time that the mix takes a document, with ``mix_position``.

    A null source is a source of its own; texts without words, and what exceeds a source's target, are not taken; rows that
    share an id are taken each for itself. A ``mix_position`` that documents bring is replaced. An empty table stays empty.
    """
    placed = docs.drop("mix_position")
    return curriculum.training_order(placed).withColumnRenamed("__mix_position", "mix_position")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the mix: doc_id, mix_position (where docs have it), token count and digests of ids and decoded text.

    A null text is empty and has no tokens; repeated rows are encoded each for itself; an empty table stays empty.
    """
    keep = [c for c in ("doc_id", "mix_position") if c in docs.columns]
    return bpe_digest(bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=keep, decoded_col="decoded"), keep)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mix", mix_sources), ("encode", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
