"""Approximate cosine neighbours by cells: k-means centres, vectors stored by their nearest centre, and searches that probe few cells.

Centres are fitted by Spark's distributed k-means on a bounded sample; every vector is stored, in the folder of its cell, in parts of
bounded size, so a search reads the folders that its queries probe and nothing else. Queries meet the parts of their cells by key and
scores are exact; what is approximate is only which cells are read. Probing all cells is an exact search.

Defined cases: vectors that are null, of length zero, or hold null or non-finite components aren't stored and queries like these find
nothing; all vectors have the size that most of the sample has, others are left out. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.retrieve import top_k

#: Vectors that centres are fitted on, cells at most, and vectors in a part of a cell.
SAMPLE, CELLS, PART = 20_000, 1024, 8192
#: Queries that are taken to the cells at a time.
STEP = 256


def unit(vector: Column) -> Column:
    """The vector at length one; null where it has no direction."""
    v = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(whole & (length > 0) & (length < float("inf")), F.transform(v, lambda x: x / length))


def build(vectors: DataFrame, path: str, cells: int | None = None) -> None:
    """Store (vec_id, embedding) by cells under ``path``; unless given, there are as many cells as the root of the number of vectors."""
    rows = vectors.select("vec_id", unit(F.col("embedding")).alias("v")).where("v IS NOT NULL")
    sample = rows.orderBy(F.xxhash64("v"), "v").limit(SAMPLE)
    common = sample.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        vectors.sparkSession.createDataFrame([], "cell int, centre array<double>, n long").coalesce(1).write.parquet(f"{path}/centres")
        return
    rows = rows.where(F.size("v") == common.dims)
    number = cells or max(1, min(CELLS, round(rows.count() ** 0.5)))
    points = sample.where(F.size("v") == common.dims).select(array_to_vector("v").alias("features"))
    model = KMeans(k=number, maxIter=15, seed=1, distanceMeasure="cosine").fit(points)
    placed = model.transform(rows.withColumn("features", array_to_vector("v"))).select("vec_id", "v", F.col("prediction").alias("cell"))
    placed.withColumn("part", F.xxhash64("vec_id")).repartition("cell", F.pmod("part", F.lit(64))).drop("part").write.partitionBy("cell").parquet(f"{path}/vectors")
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
    counts = _stored(vectors.sparkSession, path, dict(vectors.dtypes)["vec_id"]).groupBy("cell").agg(F.count("*").alias("n"))
    centres.join(counts, "cell").coalesce(1).write.parquet(f"{path}/centres")


def _stored(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"vec_id {kind}, v array<double>, cell int").parquet(f"{path}/vectors")


def probed(queries: DataFrame, centres: list, probes: int) -> DataFrame:
    """(qid, v, cell) of each query's ``probes`` nearest cells; the centres, a bounded number, go to the tasks."""
    cells, matrix = np.array([c.cell for c in centres], np.int32), np.array([c.centre for c in centres])
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1), 1e-300)[:, None]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                some = batch.slice(at, STEP)
                own = some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, matrix.shape[1])
                found = np.argsort(-(own @ matrix.T), axis=1, kind="stable")[:, :probes]
                row = pa.array(np.repeat(np.arange(len(own)), found.shape[1]))
                yield pa.RecordBatch.from_arrays([some.column(0).take(row), some.column(1).take(row), pa.array(cells[found.ravel()])], ["qid", "v", "cell"])

    usable = queries.select("qid", unit(F.col("q")).alias("v")).where(F.size("v") == matrix.shape[1])
    return usable.mapInArrow(nearest, f"qid {dict(queries.dtypes)['qid']}, v array<double>, cell int")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, probes: int = 8, kind: str = "bigint") -> DataFrame:
    """(qid, rank, vec_id, score): the k best cosines of each query (qid, q) in its ``probes`` nearest cells; ids are of type ``kind``."""
    centres = spark.read.schema("cell int, centre array<double>, n long").parquet(f"{path}/centres").orderBy("cell").collect()
    qid = dict(queries.dtypes)["qid"]
    if not centres:
        return spark.createDataFrame([], f"qid {qid}, vec_id {kind}, score double, rank long")
    visits = probed(queries, centres, probes)
    sizes = F.create_map(*[F.lit(x).cast("int") for c in centres for x in (c.cell, -(-c.n // PART))])
    parts = F.element_at(sizes, F.col("cell"))
    left = visits.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    right = _stored(spark, path, kind).join(visits.select("cell").distinct(), "cell", "left_semi").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), parts).cast("int"))

    def meet(some: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": some.qid.iloc[:0], "vec_id": own.vec_id.iloc[:0], "score": np.empty(0)})]
        if len(some) and len(own):
            table, ids = np.stack(own.v.to_list()), own.vec_id.to_numpy()
            for at in range(0, len(some), STEP):
                each = some.iloc[at : at + STEP]
                scores = np.stack(each.v.to_list()) @ table.T
                least = np.partition(scores, -k, axis=1)[:, -k][:, None] - 2e-5 if len(own) > k else -np.inf
                row, col = np.nonzero(scores >= least)
                out.append(pd.DataFrame({"qid": each.qid.to_numpy()[row], "vec_id": ids[col], "score": scores[row, col]}))
        return pd.concat(out)

    found = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInPandas(meet, f"qid {qid}, vec_id {kind}, score double")
    return top_k(found.select("qid", "vec_id", F.round("score", 5).alias("score")), k, key="vec_id")


def share_read(spark: SparkSession, path: str, queries: DataFrame, probes: int) -> float:
    """The share of the stored vectors that a query is compared with, on average."""
    centres = spark.read.schema("cell int, centre array<double>, n long").parquet(f"{path}/centres").collect()
    sizes = F.broadcast(spark.createDataFrame([(c.cell, c.n) for c in centres], "cell int, n long"))
    read, asked = probed(queries, centres, probes).join(sizes, "cell").agg(F.sum("n"), F.count_distinct("qid")).first()
    return read / asked / sum(c.n for c in centres)
