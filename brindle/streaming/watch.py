"""Watching files: event streams, debouncing and incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.operators import segments
from brindle.operators.index import upsert
from brindle.sources.files import ignored

#: Idle times after which a global flush and a file's event are due.
GLOBAL_IDLE_MS, FILE_IDLE_MS = 500, 3000


def debounced(events: DataFrame, idle_ms: int, by: list[str], ts: str = "ts") -> DataFrame:
    """Sessions of events with no more than ``idle_ms`` between neighbours: by, start, last and number; batch form."""
    w = Window.partitionBy(*by).orderBy(ts)
    gap = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))
    islands = events.withColumn("__new", F.when(gap.isNull() | (gap > idle_ms * 1000), 1).otherwise(0)).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "__island").agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("events")).drop("__island")


def debounced_globally(events: DataFrame, idle_ms: int = GLOBAL_IDLE_MS, ts: str = "ts", bucket_seconds: int = 3600) -> DataFrame:
    """The same over all events at once: start, last and number of each flush.

    Events are ordered within time buckets only; what crosses a bucket's edge follows from one summary row per bucket.
    """
    rows = events.select(ts).withColumn("__b", F.floor(F.unix_micros(ts) / (bucket_seconds * 1_000_000)))
    within, over_buckets = Window.partitionBy("__b").orderBy(ts), Window.orderBy("__b")
    edges = rows.groupBy("__b").agg(F.max(ts).alias("__end")).withColumn("__prior", F.lag("__end").over(over_buckets)).select("__b", "__prior")
    gaps = rows.withColumn("__lag", F.lag(ts).over(within)).join(edges, "__b").withColumn("__lag", F.coalesce("__lag", "__prior"))
    marked = gaps.withColumn("__new", F.when(F.col("__lag").isNull() | (F.unix_micros(ts) - F.unix_micros("__lag") > idle_ms * 1000), 1).otherwise(0))
    sums = marked.groupBy("__b").agg(F.sum("__new").alias("__n"))
    before = sums.withColumn("__base", F.coalesce(F.sum("__n").over(over_buckets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__b", "__base")
    numbered = marked.withColumn("__in", F.sum("__new").over(within.rowsBetween(Window.unboundedPreceding, 0))).join(before, "__b")
    flushes = numbered.groupBy((F.col("__base") + F.col("__in")).alias("__island")).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("events"))
    return flushes.drop("__island")


def tombstones(events: DataFrame, key: str, ts: str, deleted) -> DataFrame:
    """Keys whose last event is a deletion, with its time."""
    last = events.groupBy(key).agg(F.max_by(deleted, F.struct(ts, "event_id")).alias("gone"), F.max(ts).alias("at"))
    return last.where("gone").select(key, "at")


def debounced_stream(events: DataFrame, key: str, ts: str = "ts", idle_ms: int = FILE_IDLE_MS, late: str = "10 minutes") -> DataFrame:
    """The streaming form: per key one row (key, start, last, events) once the watermark has passed its idle time."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, n = state.get if state.exists else (None, None, 0)
        out = []
        if state.hasTimedOut:
            out.append((keys[0], start, last, n))
            state.remove()
        else:
            times = sorted(t for b in batches for t in b[ts])
            for t in times:
                if last is not None and (t - pd.Timestamp(last)).total_seconds() * 1000 > idle_ms:
                    out.append((keys[0], start, last, n))
                    start, n = None, 0
                start, last, n = start if start is not None else t, t if last is None else max(t, pd.Timestamp(last)), n + 1
            state.update((pd.Timestamp(start).to_pydatetime(), pd.Timestamp(last).to_pydatetime(), n))
            due = int(pd.Timestamp(last).timestamp() * 1000) + idle_ms
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "start", "last", "events"])

    kind = dict(events.dtypes)[key]
    grouped = events.withWatermark(ts, late).groupBy(key)
    return grouped.applyInPandasWithState(step, f"key {kind}, start timestamp, last timestamp, events long", "start timestamp, last timestamp, events long", "append", GroupStateTimeout.EventTimeTimeout)


def _or_nothing(spark: SparkSession, schema: str, read: Callable[[], DataFrame]) -> DataFrame:
    """What ``read`` gives; no rows where there is nothing at its path yet."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ingest_stream(
    spark: SparkSession, source: str, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str, key: str = "path", version: list | None = None,
    rules: list[str] = (), initial: bool = True, glob: str = "*",
):
    """Ingest a folder's new files once, those that are there already in the first run: a batch's last row per key goes to ``sink``,
    which must be idempotent.

    ``rules`` leave out keys that an ignore rule matches, or a folder above them. Without ``initial`` the first run lists the files that are
    there, beside its checkpoint, and their rows are left out of every batch; an empty folder has none. The checkpoint knows what is
    done, so a run that broke off goes on where it stopped.
    """
    order, known = version or [F.desc("version")], f"{checkpoint.rstrip('/')}-known"
    place = F.col("_metadata.file_path").alias("__file")
    if not initial:
        there = _or_nothing(spark, "__file string", lambda: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(source).select(place))
        there.write.mode("ignore").parquet(known)  # the first run's list stays

    def batch(rows: DataFrame, number: int) -> None:
        if not initial:
            rows = rows.join(spark.read.schema("__file string").parquet(known), "__file", "left_anti").drop("__file")
        sink(upsert(rows, key, order), number)

    files = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source)
    files = files if initial else files.select("*", place)
    kept = files.where(~ignored(F.col(key), list(rules))) if rules else files
    return kept.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink of one folder per batch; a batch that runs again replaces its own folder, so rows come once."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def current(spark: SparkSession, path: str, schema: str, key: str, version: list) -> DataFrame:
    """The last row of each key over all batches in ``path``; no rows where none was written."""
    rows = _or_nothing(spark, schema, lambda: spark.read.schema(schema).option("basePath", path).option("recursiveFileLookup", "true").parquet(path))
    return upsert(rows, key, version)


def index_sink(path: str, key: str = "path", version: str = "version", gone: str = "gone") -> Callable[[DataFrame, int], None]:
    """A sink that applies a feed of changes (key, version, text, gone) to a stored index under ``path``: a row that isn't gone puts its text in, one that is
    takes the key out.

    Of each key the largest version counts, in whatever batch it comes: a late row that is older than what is known does nothing,
    so a deletion isn't undone by an older text. A batch that runs again leaves the same index.
    """

    def apply(rows: DataFrame, number: int) -> None:
        spark, kinds = rows.sparkSession, dict(rows.dtypes)
        schema = f"{key} {kinds[key]}, {version} {kinds[version]}, batch int"
        known = _or_nothing(spark, schema, lambda: spark.read.schema(schema).option("basePath", f"{path}/changes").parquet(f"{path}/changes"))
        newest = known.where(F.col("batch") != number).groupBy(key).agg(F.max(version).alias("__known"))
        fresh = rows.join(newest, key, "left").where(F.col("__known").isNull() | (F.col(version) > F.col("__known"))).drop("__known")
        fresh.write.mode("overwrite").parquet(f"{path}/fresh")
        fresh = spark.read.schema(rows.schema).parquet(f"{path}/fresh")
        fresh.select(key, version).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        texts = fresh.where(~F.col(gone)).select(F.col(key).alias("doc_id"), "text")
        try:
            segments.update(spark, f"{path}/index", add=texts, gone=fresh.where(gone).select(F.col(key).alias("doc_id")))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            segments.create(texts, f"{path}/index")

    return apply


def changed_stream(files: DataFrame, key: str = "path", hash: str = "hash", forget: str | None = None) -> DataFrame:
    """The rows of a stream whose content hash differs from the last one of their key, which is kept as the key's state.

    Of rows of one key in one batch each is compared with the one before, in the order of ``hash``'s arrival. With ``forget`` (a time in
    milliseconds) a key that hasn't come for that long is forgotten, so states don't pile up.
    """
    columns = files.columns

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for rows in batches:
            new = []
            for own in rows[hash]:
                new.append(own != last)
                last = own
            if any(new):
                yield rows[new][columns]
        state.update((last,))
        if forget:
            state.setTimeoutDuration(forget)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout
    return files.groupBy(key).applyInPandasWithState(step, files.schema, f"{hash} string", "append", timeout)
