"""Latencies, counters, classes of requests and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_n(rows: DataFrame, by: str, order: list, n: int = 1000) -> DataFrame:
    """The last n rows of each group: a report, whose limit is the feature."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def latency_percentiles(rows: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Upper nearest ranks, sorted[int(n * p)], exactly: equal values are counted first, so a group's window holds distinct values only."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("__k"))
    w = Window.partitionBy(by)
    placed = counts.withColumn("__upto", F.sum("__k").over(w.orderBy(value))).withColumn("__n", F.sum("__k").over(w))
    at = lambda p: F.min(F.when(F.col("__upto") >= F.floor(F.col("__n") * p) + 1, F.col(value))).alias(f"p{round(p * 100)}")
    return placed.groupBy(by).agg(F.max("__n").alias("n"), *[at(p) for p in shares])


def counters(rows: DataFrame, name: str, amount: Column) -> DataFrame:
    return rows.groupBy(name).agg(F.sum(amount).alias("total"))


def request_class(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/search")), "search").when(F.contains(path, F.lit("/ingest")), "ingest").otherwise("other")


def exposition(rows: DataFrame, metric: str, label: str, value: str) -> DataFrame:
    """Lines of the text exposition format."""
    return rows.select(F.concat(F.lit(metric), F.lit("{"), F.lit(label), F.lit('="'), F.col(label), F.lit('"} '), F.col(value).cast("string")).alias("line"))


def health(rows: DataFrame, by: str, down: Column) -> DataFrame:
    """degraded where any component is down."""
    return rows.groupBy(by).agg(F.when(F.bool_or(down), "degraded").otherwise("healthy").alias("status"), F.count(F.when(down, 1)).alias("down"))


def expired(models: DataFrame, now: Column, last: str, ttl_seconds: int = 300) -> DataFrame:
    """Loaded models that have been idle for more than their time to live."""
    return models.where("loaded").where(F.unix_micros(now) - F.unix_micros(last) > ttl_seconds * 1_000_000)
