"""The inverted index as tables, and its upkeep as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import tokens


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf); counted per task before the shuffle."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dl) without a shuffle."""
    return docs.select(key, F.size(tokens(F.col(text))).cast("long").alias("dl"))


def term_df(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): documents that hold a term; distinct within each row, so one count is enough."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All new rows, and the old ones whose keys no new row has. Write the result elsewhere, then swap."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert(rows: DataFrame, key: str, version: list) -> DataFrame:
    """The last version of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*version))).where("__n = 1").drop("__n")


def delete(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return rows.join(keys.select(on).distinct(), on, "left_anti")


def summary(chunks: DataFrame) -> DataFrame:
    """Chunks, and how many have each representation."""
    return chunks.agg(F.count("*").alias("chunks"), F.count("dense").alias("dense"), F.count("sparse").alias("sparse"), F.count(F.when(F.col("text") != "", 1)).alias("lexical"))


def merge_registry(rows: DataFrame, name: str, flags: list[str]) -> DataFrame:
    """One row per name, flags joined by or."""
    return rows.groupBy(name).agg(F.count("*").alias("merged"), *[F.bool_or(f).alias(f) for f in flags])
