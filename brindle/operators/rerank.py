"""Reranking: pluggable pair scorers, parsing of scores that a model wrote, and their application."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_scorer() -> Callable[[str, str], float]:
    """A deterministic stand-in for a cross-encoder: the share of the query's words that the document holds."""

    def score(query: str, text: str) -> float:
        words = set(query.lower().split())
        return len(words & set(text.lower().split())) / len(words) if words else 0.0

    return score


def cross_encode(query: Column, text: Column, make_scorer: Callable[[], Callable[[str, str], float]] = overlap_scorer) -> Column:
    """Scores of pairs by any scorer, made once per task."""

    @F.pandas_udf("double")
    def pairs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for queries, texts in batches:
            yield pd.Series([scorer(q or "", t or "") for q, t in zip(queries, texts, strict=True)], dtype="float64")

    return pairs(query, text)


def parsed_scores(answer: Column, n: Column) -> Column:
    """n scores from a model's answer: the first list of two or more numbers between commas, else all numbers, of what
    follows [/INST]; tenths if any exceeds 1, held in [0, 1], cut or filled up by steps of 0.1 below the least (0.5 if none)."""
    text = F.regexp_replace(answer, r"(?s)^.*\[/INST\]", "")
    listed = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?(?:\s*,\s*[0-9]+(?:\.[0-9]+)?)+)", 1)
    found = F.regexp_extract_all(F.when(listed != "", listed).otherwise(text), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1)
    numbers = F.transform(found, lambda x: x.cast("double"))
    scale = F.when(F.exists(numbers, lambda x: x > 1), 10.0).otherwise(1.0)
    held = F.transform(numbers, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / scale)))
    least = F.coalesce(F.array_min(held), F.lit(0.5))
    missing = F.greatest(F.lit(0), n - F.size(held))
    fill = F.when(missing > 0, F.transform(F.sequence(F.lit(0), F.greatest(missing - 1, F.lit(0))), lambda i: F.greatest(F.lit(0.0), least - 0.1 * i))).otherwise(F.array().cast("array<double>"))
    return F.transform(F.slice(F.concat(held, fill), F.lit(1), n), lambda x: F.round(x, 6))


def descending_scores(rows: DataFrame, query: str, order: list) -> DataFrame:
    """Scores 1 - place / n for rows in their order, for when no scorer answers."""
    w = Window.partitionBy(query)
    return rows.withColumn("rerank_score", F.round(1 - (F.row_number().over(w.orderBy(*order)) - 1) / F.count("*").over(w), 6))


def apply_scores(rows: DataFrame, query: str, position: str = "rank") -> DataFrame:
    """Rows in the order of rerank_score, ties in their former order, with their new place."""
    order = Window.partitionBy(query).orderBy(F.desc("rerank_score"), position)
    return rows.withColumn("place", F.row_number().over(order).cast("long"))
