"""Fusing ranked lists: rows (retriever, ord, rank, id, score), rank from 1, ord the retriever's place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import first_truthy

RRF_K = 60


def by_score() -> list[Column]:
    """The order of a fused list: score, then the list and place that came first, then id."""
    return [F.desc("fused_score"), F.asc("first_ord"), F.asc("first_rank"), F.asc("id")]


def tagged(*lists: tuple[str, DataFrame], id: str = "doc_id", by: tuple[str, ...] = ()) -> DataFrame:
    """The lists as one DataFrame, tagged by retriever; one job runs them all."""
    frames = [df.select(*by, F.lit(name).alias("retriever"), F.lit(i).alias("ord"), "rank", F.col(id).cast("string").alias("id"), "score") for i, (name, df) in enumerate(lists)]
    return reduce(DataFrame.unionByName, frames)


def rrf(ranked: DataFrame, k: int = RRF_K, limit: int | None = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """id, fused_score, first_ord, first_rank, sources: reciprocal ranks added up; ties in the order of first sight. Rows without id don't count."""
    kept = ranked.where("id IS NOT NULL AND id <> ''")
    fused = kept.groupBy(*by, "id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("fused_score"),
        F.min(F.struct("ord", "rank")).alias("first"),
        F.array_join(F.array_sort(F.collect_set("retriever")), ",").alias("sources"),
    )
    fused = fused.select(*by, "id", "fused_score", F.col("first.ord").alias("first_ord"), F.col("first.rank").alias("first_rank"), "sources")
    order = by_score()
    if not by:
        return fused.orderBy(*order).limit(limit) if limit else fused
    placed = fused.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return placed.where(F.col("place") <= limit).drop("place") if limit else placed.drop("place")


def weighted(ranked: DataFrame, weights: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """id, fused_score, for each of ``by``: scores scaled to [0, 1] per retriever (all equal: 0), times the weights' shares; unknown
    retrievers weigh 0."""
    per, total = Window.partitionBy(*by, "retriever"), sum(weights.values()) or 1.0
    low, high = F.min("score").over(per), F.max("score").over(per)
    scaled = ranked.withColumn("norm", (F.col("score") - low) / F.when(high == low, 1.0).otherwise(high - low))
    share = F.coalesce(*[F.when(F.col("retriever") == r, F.lit(w / total)) for r, w in weights.items()], F.lit(0.0))
    return scaled.groupBy(*by, "id").agg(F.round(F.sum(share * F.col("norm")), 6).alias("fused_score"))


def first_per_key(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key; rows whose key is null or empty go."""
    kept = rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return kept.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def per_file(rows: DataFrame, paths: list[str], order: list) -> DataFrame:
    """The best row of each file, by the first path that isn't empty; rows without any path all stay."""
    keyed = rows.withColumn("__path", first_truthy(*map(F.col, paths)))
    best = F.row_number().over(Window.partitionBy("__path").orderBy(*order))
    placed = keyed.withColumn("__n", best).where("__n = 1 OR __path IS NULL")
    return placed.drop("__n", "__path")


def relevance(score: Column) -> tuple[Column, Column]:
    """Percentage and label of a relevance score."""
    squashed = F.floor((1 / (1 + F.exp(-score)) * 0.86 + 0.12) * 100 + 0.5)
    pct = F.when(score > 6, 100).otherwise(F.greatest(F.lit(12), squashed)).cast("long")
    return pct, F.when(pct >= 75, "High").when(pct >= 60, "Good").when(pct >= 45, "Fair").otherwise("Low")
