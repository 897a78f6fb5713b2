"""Configuration and access: driver-side settings, and overlays, snapshots and roles as DataFrames."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import shared_path

ROLES = {"viewer": 1, "member": 2, "admin": 3}


def flatten(nested: dict[str, Any], prefix: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in nested.items():
        name = f"{prefix}.{key}" if prefix else key
        out |= flatten(value, name) if isinstance(value, dict) else {name: value}
    return out


def unflatten(flat: dict[str, Any]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in flat.items():
        *path, last = key.split(".")
        at = out
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value
    return out


def coerce(text: str) -> Any:
    """bool, int, float or comma-separated list from a string, else the string."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return [coerce(p.strip()) for p in text.split(",")] if "," in text else text


class Settings:
    """Dotted keys with a version counter; overrides from environment-like pairs, snapshots and rollback."""

    def __init__(self, defaults: dict[str, Any], overrides: dict[str, str] | None = None, prefix: str = "BRINDLE_"):
        self.values, self.version, self.snapshots = flatten(defaults), 0, []
        for key, value in (overrides or {}).items():
            if key.startswith(prefix):
                self.values[key[len(prefix) :].lower().replace("_", ".")] = coerce(value)

    def get(self, key: str, default: Any = None) -> Any:
        return self.values.get(key, default)

    def nested(self, prefix: str) -> dict[str, Any]:
        return unflatten({k[len(prefix) + 1 :]: v for k, v in self.values.items() if k.startswith(prefix + ".")})

    def set(self, key: str, value: Any) -> None:
        if key == "hybrid.rrf_k" and not 1 <= int(value) <= 1000:
            raise ValueError("rrf_k must be from 1 to 1000")
        self.values[key] = value
        self.version += 1

    def snapshot(self, cap: int = 20) -> None:
        self.snapshots = [dict(self.values), *self.snapshots][:cap]

    def rollback(self, number: int) -> None:
        self.values = dict(self.snapshots[number])
        self.version += 1

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(self.values.items())], "key string, value string")


def effective(defaults: DataFrame, overrides: DataFrame, key: str = "key") -> DataFrame:
    """Defaults with the overrides laid over them."""
    joined = defaults.join(overrides.select(key, F.col("value").alias("__v")), key, "left")
    return joined.withColumn("overridden", F.col("__v").isNotNull()).withColumn("value", F.coalesce("__v", "value")).drop("__v")


def snapshot_pick(versions: DataFrame, key: str, version: list, number: int = 0) -> DataFrame:
    """The row of each key that lies ``number`` versions back."""
    order = Window.partitionBy(key).orderBy(*version)
    return versions.withColumn("__n", F.row_number().over(order)).where(F.col("__n") == number + 1).drop("__n")


def role_rank(role: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), role)


def allowed(role: Column, required: str) -> Column:
    """Whether a role reaches the required one; unknown roles never do."""
    return F.coalesce(role_rank(role) >= ROLES[required], F.lit(False))


def active_by_type(models: DataFrame, kind: str, name: str, default: str) -> DataFrame:
    """(kind, name): the first active model of each type, or the default."""
    return models.groupBy(kind).agg(F.coalesce(F.min(F.when(F.col("active"), F.col(name))), F.lit(default)).alias(name))


def flattened(rows: DataFrame, keys: list[str], json: str, prefix: str) -> DataFrame:
    """(*keys, key, value): every leaf of a JSON column under its dotted path, places of lists in brackets; text values without quotes.

    Objects and lists are opened one level per round, all rows at once, until none is left; a round's result is written. An empty
    object or list is a leaf; what isn't JSON, or null, has no rows.
    """
    spark, folder, at = rows.sparkSession, shared_path(rows.sparkSession, "flattened"), 0
    opened = "schema_of_variant(v) RLIKE '^(OBJECT|ARRAY)<' AND CAST(v AS STRING) NOT IN ('{}', '[]')"
    now, leaves = rows.select(*keys, F.lit(prefix).alias("key"), F.try_parse_json(json).alias("v")).where("v IS NOT NULL"), []
    while True:
        marked = now.select(*keys, "key", "v", F.expr(opened).alias("opened"))
        marked.write.parquet(f"{folder}/{at}")
        marked = spark.read.schema(marked.schema).parquet(f"{folder}/{at}")
        leaves.append(marked.where("NOT opened").select(*keys, "key", F.expr("CAST(v AS STRING)").alias("value")))
        inner = marked.where("opened")
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, leaves)
        parts = inner.select(*keys, F.col("key").alias("__above"), F.col("v").alias("__v")).lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()))
        name = F.when(F.col("key").isNull(), F.concat("__above", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat_ws(".", "__above", "key"))
        now, at = parts.select(*keys, name.alias("key"), F.col("value").alias("v")), at + 1
