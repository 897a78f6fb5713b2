"""Exact top-k search by a vector-approximation file.

Every dimension is cut into 2**bits equal cells between its smallest and largest value over the whole table. The file holds, for
each vector, one byte per dimension: its cell. It is written once; the scan reads the cells alone. For a query they bound the
inner product from both sides, as the cells' lower edges times the query plus two sums that only depend on the query. Blocks of
cells and blocks of queries meet by key, so a task holds one of each, whatever the size of the table. They meet twice: first for the k-th
best lower bound of all blocks, then for the vectors whose upper bound reaches it. Exact vectors are then read in the order of the bounds: first the k of the largest upper bound, whose k-th exact score
is a threshold, then those whose upper bound reaches it. Nothing else can be among the k best.

Defined cases: vectors that are null or hold null or non-finite components take no part. Vectors are only compared with
vectors of the same length. Ties go to the smaller id. Rows that share an id are candidates each for themselves,
never for a query of that id; of queries that share an id the smallest vector counts. A null id takes no part. Scores or
components beyond 64 bits raise Spark's overflow error. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import written

K, CELL_BITS = 20, 8
#: Vectors and queries per block, and queries that a task bounds at a time.
BLOCK, QUERY_BLOCK = 16384, 4096
_SCAN = 256


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(row, id, dims, v): components times ``scale``, rounded down, as doubles; only whole, finite vectors."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = F.col("v").isNotNull() & F.col("id").isNotNull() & F.forall("v", finite)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * scale).alias("v")).where(whole)
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", F.size("v").alias("dims"), F.transform("v", lambda x: F.floor(x).cast("double")).alias("v"))


def ranges(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per vector length, the smallest and largest value of each dimension: one pair of numbers per dimension."""
    per_dim = vectors.select("dims", F.posexplode("v").alias("dim", "x")).groupBy("dims", "dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in per_dim:
        lo, hi = found.setdefault(r.dims, (np.zeros(r.dims), np.zeros(r.dims)))
        lo[r.dim], hi[r.dim] = r.lo, r.hi
    return found


def steps(lo: np.ndarray, hi: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    """The width of each dimension's cells."""
    return np.maximum((hi - lo) / (1 << bits), 1e-9)


def cells_of(vectors: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    return np.clip((vectors - lo) // steps(lo, hi, bits), 0, (1 << bits) - 1).astype(np.uint8)


def bounds(cells: np.ndarray, queries: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int = CELL_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products, queries by vectors, from cells alone; a little wider than need be, for rounding."""
    spans = queries * steps(lo, hi, bits)
    base = spans @ cells.T.astype(np.float64) + (queries @ lo)[:, None]
    slack = 1e-9 * (1 + np.abs(queries) @ (np.abs(lo) + np.abs(hi)))[:, None]
    return base + np.minimum(spans, 0).sum(axis=1)[:, None] - slack, base + np.maximum(spans, 0).sum(axis=1)[:, None] + slack


def cell_file(vectors: DataFrame, span: Broadcast) -> DataFrame:
    """(row, id, dims, cells): the approximation file, written; a byte per dimension."""

    @F.pandas_udf("binary")
    def approximate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield some.map(lambda v: cells_of(np.asarray(v), *span.value[len(v)]).tobytes() if len(v) else b"")

    return written(vectors.select("row", "id", "dims", approximate("v").alias("cells")), "va-cells")


def candidates(cells: DataFrame, queries: DataFrame, n_cells: int, n_queries: int, span: Broadcast, k: int) -> DataFrame:
    """(query_id, row, up) of the vectors whose upper bound reaches the k-th best lower bound of their query.

    The cells are scanned twice: first each block gives its k best lower bounds of a query, of which tasks hand on k each, so the
    k-th best of all is known before the second scan, and no block hands on a vector that falls short of it.
    """
    n_blocks, n_query_blocks = max(1, -(-n_cells // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = cells.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")).withColumn("qb", every(n_query_blocks))
    placed = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_query_blocks)).cast("int"))

    def bounded(q: pd.DataFrame, c: pd.DataFrame):
        """(some queries, lower bounds, upper bounds), a query's own rows at minus infinity."""
        if len(q) and len(c):
            dims, ids = int(q.dims.iloc[0]), c.id.to_numpy()
            lo, hi = span.value.get(dims, (np.zeros(0), np.zeros(0)))
            table = np.frombuffer(b"".join(c.cells), np.uint8).reshape(len(c), dims)
            for at in range(0, len(q), _SCAN):
                some = q.iloc[at : at + _SCAN]
                low, up = bounds(table, np.stack(some.v.to_list()) if dims else np.zeros((len(some), 0)), lo, hi)
                own = ids[None, :] == some.id.to_numpy()[:, None]
                low[own], up[own] = -np.inf, -np.inf
                yield some, low, up

    def best_lows(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "low": np.empty(0)})]
        for some, low, _ in bounded(q, c):
            best = low if low.shape[1] <= k else np.partition(low, low.shape[1] - k, axis=1)[:, -k:]
            row, col = np.nonzero(best > -np.inf)
            out.append(pd.DataFrame({"query_id": some.id.to_numpy()[row], "low": best[row, col]}))
        return pd.concat(out)

    def reaching(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "row": np.empty(0, np.int64), "up": np.empty(0)})]
        for some, _, up in bounded(q, c):
            row, col = np.nonzero((up >= some.certain.to_numpy()[:, None]) & (up > -np.inf))
            out.append(pd.DataFrame({"query_id": some.id.to_numpy()[row], "row": c.row.to_numpy()[col], "up": up[row, col]}))
        return pd.concat(out)

    keys = ["dims", "qb", "b"]
    meet = lambda left, scan, schema: left.withColumn("b", every(n_blocks)).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, schema)
    by_low = Window.partitionBy("query_id").orderBy(F.desc("low"))
    kept = meet(placed, best_lows, "query_id long, low double").withColumn("n", F.row_number().over(by_low)).where(F.col("n") <= k)
    certain = written(kept.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("low")).otherwise(float("-inf")).alias("certain")), "va-certain")
    known = placed.join(certain.withColumnRenamed("query_id", "id"), "id")
    return written(meet(known, reaching, "query_id long, row long, up double"), "va-scan")


def exact_scores(some: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) of candidates (query_id, row), from the exact vectors."""
    products = F.zip_with("v", "q", lambda x, y: x.cast("long") * y.cast("long"))
    met = some.join(vectors.select("row", F.col("id").alias("vec_id"), "v"), "row").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return met.select("query_id", "vec_id", F.aggregate(products, F.lit(0).cast("long"), lambda total, x: total + x).alias("score"))


def top_k(table: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query (a condition on the id, column id)."""
    vectors = written(integer_vectors(table, id_col, vector_col, scale), "va-vectors")
    span = vectors.sparkSession.sparkContext.broadcast(ranges(vectors))
    queries = vectors.where(is_query).groupBy("id").agg(F.min(F.struct("dims", "v")).alias("q")).select("id", "q.dims", "q.v")
    n_vectors, n_queries = vectors.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    near = candidates(cell_file(vectors, span), queries, n_vectors, n_queries, span, k)
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("up"), "row")
    top = written(near.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= k).select("query_id", "row"), "va-top")
    first = written(exact_scores(top, vectors, queries), "va-first")
    threshold = first.groupBy("query_id").agg(F.min("score").alias("least"))
    rest = near.join(threshold, "query_id").where(F.col("up") >= F.col("least")).join(top, ["query_id", "row"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    scored = first.unionByName(exact_scores(rest, vectors, queries))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
