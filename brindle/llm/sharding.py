"""Sharding by fixed virtual slots.

Every record hashes into one of a few thousand virtual slots. Bytes and rows are summed per slot, and a versioned map
sends each slot to a shard. Rebalancing edits the map: it moves single slots from the heaviest shard to the lightest
and writes the result as the next version, so records move only with their slot.

Defined cases: a null text has no bytes (size 1, crc32 0); a null id hashes like any other value, together with the
text's crc32; repeated rows each get a place of their own; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import shared_path, written

N_SLOTS = 4096


@dataclass
class SlotMap:
    """Slot-to-shard map: ``shards[slot]`` is the shard, ``moved`` the slots that this version moved."""

    shards: list[int]
    n_shards: int
    version: int = 1
    moved: list[int] = field(default_factory=list)

    @classmethod
    def uniform(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls([slot % n_shards for slot in range(n_slots)], n_shards)

    def rebalance(self, weights: dict[int, int], n_shards: int | None = None) -> SlotMap:
        """The next version: slots move from the heaviest to the lightest shard while that narrows the gap.

        ``n_shards`` may be larger than before; the new shards then start empty. Work is bounded by the number of slots.
        """
        n = n_shards or self.n_shards
        shards = [s if s < n else s % n for s in self.shards]
        held: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for slot, shard in enumerate(shards):
            if weights.get(slot, 0) > 0:
                held[shard].append((weights[slot], slot))
        load = [sum(w for w, _ in h) for h in held]
        for h in held:
            h.sort()
        for _ in range(8 * len(shards)):
            heavy, light = max(range(n), key=lambda s: (load[s], -s)), min(range(n), key=lambda s: (load[s], s))
            gap = load[heavy] - load[light]
            at = bisect_left(held[heavy], (gap // 2, -1))
            best = min((i for i in (at - 1, at) if 0 <= i < len(held[heavy]) and held[heavy][i][0] < gap), key=lambda i: abs(2 * held[heavy][i][0] - gap), default=None)
            if best is None:
                break
            entry = held[heavy].pop(best)
            insort(held[light], entry)
            load[heavy] -= entry[0]
            load[light] += entry[0]
            shards[entry[1]] = light
        return SlotMap(shards, n, self.version + 1, [i for i, (a, b) in enumerate(zip(self.shards, shards, strict=True)) if a != b])

    def store(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map's table (version, slot, shard, n_shards); a version is written once."""
        newest = SlotMap.load(spark, path)
        if newest and newest.version >= self.version:
            raise ValueError(f"{path} holds version {newest.version} already")
        rows = [(self.version, slot, shard, self.n_shards) for slot, shard in enumerate(self.shards)]
        spark.createDataFrame(rows, "version int, slot int, shard int, n_shards int").coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """A stored version, the newest unless one is named; None where nothing is stored."""
        try:
            stored = spark.read.schema("slot int, shard int, n_shards int, version int").parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        version = version or stored.agg(F.max("version")).first()[0]
        rows = sorted((r.slot, r.shard, r.n_shards) for r in stored.where(F.col("version") == version).collect())
        return cls([s for _, s, _ in rows], rows[0][2], version)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """Per record: id, size in bytes plus one, crc32 of the text and virtual slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), crc), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def assign_shards(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None, **cols: str) -> DataFrame:
    """Shard, place in the shard and map version of every record; shards get nearly equal bytes.

    A map stored at ``map_path`` is loaded, its newest version rebalanced for these records and ``n_shards``, and what
    changes appended as the next version; without a path a new map is stored.

    The driver holds the map and the slots' totals: ``n_slots`` rows, whatever the size of the table. The place in a
    shard is the place in the slot plus the rows of the shard's earlier slots, so no task sorts a whole shard.
    """
    spark = docs.sparkSession
    rows = written(digest(docs, n_slots=n_slots, **cols), "slots")
    totals = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    path = map_path or shared_path(spark, "slot-map")
    held = SlotMap.load(spark, path)
    if held is None:
        held = SlotMap.uniform(n_slots, n_shards)
        held.store(spark, path)
    if len(held.shards) != n_slots:
        raise ValueError(f"{path} maps {len(held.shards)} slots, not {n_slots}")
    latest = held.rebalance({r.virtual_slot: r.bytes for r in totals}, n_shards)
    if latest.moved or n_shards != held.n_shards:
        latest.store(spark, path)
    else:
        latest = held
    counts, starts, placed = {r.virtual_slot: r.n for r in totals}, [0] * n_shards, []
    for slot, shard in enumerate(latest.shards):
        placed.append((slot, shard, starts[shard], latest.version))
        starts[shard] += counts.get(slot, 0)
    slot_map = spark.createDataFrame(placed, "virtual_slot int, shard int, start long, map_version int")
    within = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(within).cast("long") - 1)
        .join(F.broadcast(slot_map), "virtual_slot")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place")).alias("slot"), "virtual_slot", "map_version")
    )
