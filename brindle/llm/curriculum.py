"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Sources share the corpus' words by weight, each up to ``max_repeats`` times its own size. Within a source, documents
stand in a fixed pseudo-random order and are passed over up to ``max_repeats`` times until the source's target is
reached. Over training time u in [0, 1] the weight of a source runs linearly from 1 - slope to 1 + slope times its
mean. Its integral, the cumulative demand u + slope * (u * u - u), is inverted in closed form: the document pass that
covers the fraction c of the source's target stands at the u where the demand is c. A range sort by position yields
the training order.

Defined cases: a null source is a source of its own, after all others; null and empty texts have no words and are
never taken; rows that agree in id and text are interchangeable; an empty table gives no rows. Internal columns start
with ``__mix_``; all columns named in ``keep`` pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import word_count, written

WEIGHTS = (1, 2, 3)
#: Slopes of the weight schedules, by the place of a source's weight in WEIGHTS: light sources rise, heavy ones fall.
SLOPES = (0.5, 0.0, -0.5)
MAX_REPEATS = 3
#: Pieces into which a source's order is cut, so that no task orders a whole source.
PIECES = 4096


def order_key(doc_id: Column, text: Column) -> Column:
    """60 pseudo-random bits from the id and the text."""
    joined = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets from (__mix_source, __mix_source_size): one row per source in and out.

    Uncapped sources get level * weight. Ordered by cap / weight the capped sources come first, so the level is what
    the sources from some row on share once all before it are capped, taken at the first row that stays under its cap.
    """
    by_name, place = Window.orderBy("__mix_source"), F.col("__mix_place")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(place, F.lit(len(values))) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(1))
    by_ratio = Window.partitionBy(F.lit(1)).orderBy("__mix_ratio", "__mix_source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    cap, level = F.col("__mix_cap"), F.col("__mix_level")
    ranked = (
        totals.withColumn("__mix_place", F.row_number().over(by_name) - 1)
        .withColumn("__mix_weight", pick(weights))
        .withColumn("__mix_slope", pick([float(x) for x in slopes]))
        .withColumn("__mix_cap", F.lit(max_repeats) * F.col("__mix_source_size"))
        .withColumn("__mix_ratio", cap / F.col("__mix_weight"))
        .withColumn("__mix_all", F.sum("__mix_source_size").over(everything))
        .withColumn("__mix_level", (F.col("__mix_all") - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("__mix_weight").over(onward))
    )
    settled = F.min(F.when(level <= F.col("__mix_ratio"), F.struct("__mix_ratio", "__mix_source", "__mix_level"))).over(everything)["__mix_level"]
    return ranked.withColumn("__mix_settled", settled).select(
        "__mix_source", "__mix_source_size", "__mix_slope", "__mix_all",
        F.least(cap.cast("double"), F.coalesce(F.col("__mix_settled") * F.col("__mix_weight"), cap.cast("double"))).alias("__mix_target"),
    )


def plan_mix(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = MAX_REPEATS, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, stored: bool = False) -> DataFrame:
    """The columns in ``keep`` and, per document, __mix_size, __mix_source_size, __mix_target, __mix_before and __mix_passes."""
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        word_count(F.col(text_col)).alias("__mix_size"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t")).alias("__mix_source"),
        order_key(F.col(id_col), F.col(text_col)).alias("__mix_key"),
    ).withColumn("__mix_piece", F.floor(F.col("__mix_key") / F.lit((1 << 60) // PIECES)).cast("int"))
    if stored:  # small rows: counted and hashed once
        keyed = written(keyed, "mix-keys")
    pieces = keyed.groupBy("__mix_source", "__mix_piece").agg(F.sum("__mix_size").alias("__mix_piece_size"))
    targets = source_targets(pieces.groupBy("__mix_source").agg(F.sum("__mix_piece_size").alias("__mix_source_size")), weights, slopes, max_repeats)
    earlier = Window.partitionBy("__mix_source").orderBy("__mix_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("__mix_start", F.coalesce(F.sum("__mix_piece_size").over(earlier), F.lit(0))).join(targets, "__mix_source").drop("__mix_piece_size")
    within = Window.partitionBy("__mix_source", "__mix_piece").orderBy("__mix_key").rowsBetween(Window.unboundedPreceding, -1)
    before, size, of, target = F.col("__mix_before"), F.col("__mix_size"), F.col("__mix_source_size"), F.col("__mix_target")
    fit = F.floor((target - before - size / 2.0) / of).cast("int") + 1
    return (
        keyed.withColumn("__mix_before", F.coalesce(F.sum("__mix_size").over(within), F.lit(0)))
        .join(pieces, ["__mix_source", "__mix_piece"])
        .withColumn("__mix_before", before + F.col("__mix_start"))
        .withColumn("__mix_passes", F.when(size > 0, F.greatest(F.lit(0), F.least(F.lit(max_repeats), fit))).otherwise(0))
        .drop("__mix_start", "__mix_piece", "__mix_key")
    )


def position(number: Column) -> Column:
    """Training position, in words of the mix, of a document's pass ``number`` (from 0)."""
    slope = F.col("__mix_slope")
    covered = F.least(F.lit(1.0), (number * F.col("__mix_source_size") + F.col("__mix_before") + F.col("__mix_size") / 2.0) / F.col("__mix_target"))
    root = F.sqrt((1.0 - slope) * (1.0 - slope) + 4.0 * slope * covered)
    u = F.when(slope == 0, covered).otherwise((root - (1.0 - slope)) / F.when(slope == 0, 1.0).otherwise(2.0 * slope))
    return u * F.col("__mix_all")


def in_training_order(plan: DataFrame) -> DataFrame:
    """A row for each pass that the mix takes, with ``__mix_position``, range-partitioned and sorted by it."""
    rows = plan.where(F.col("__mix_passes") > 0).withColumn("__mix_pass", F.explode(F.sequence(F.lit(0), F.col("__mix_passes") - 1)))
    return rows.withColumn("__mix_position", position(F.col("__mix_pass"))).repartitionByRange("__mix_position").sortWithinPartitions("__mix_position")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """All columns of ``docs``, a row for each pass that the mix takes, in training order, with ``__mix_position``."""
    names = docs.columns
    return in_training_order(plan_mix(docs, keep=names, **options)).select(*[f"`{c}`" for c in names], "__mix_position")


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """Per document, whatever of it the mix takes: counted from the rows in training order."""
    plan = written(plan_mix(docs, keep=["doc_id"], stored=True, **options).withColumn("__mix_row", F.monotonically_increasing_id()), "mix-plan")
    taken = in_training_order(plan).groupBy("__mix_row").agg(F.sum("__mix_size").alias("taken"), F.min("__mix_position").alias("first"))
    return plan.join(taken, "__mix_row", "left").select(
        "doc_id",
        F.col("__mix_size").alias("size"),
        F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"),
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.round("first", 3).alias("first_position"),
    )
