"""Nearest neighbours by vantage-point trees, one per shard, with relaxed pruning.

A bounded sample shapes a tree of vantage points whose leaves say where a vector belongs; every vector of the table is then dealt to its
leaf, and a leaf of many vectors is cut into shards of bounded size. Each shard keeps a vantage-point tree of its own vectors: at every node
the nearer half goes to one side and the farther half to the other, and each leaf knows the range of its distances from all vantage
points above it. The triangle inequality then bounds a query's distance to a leaf from below. A leaf is skipped if ``factor``
times that bound exceeds the distance of the query's k-th best so far: with factor one the search is exact, a larger one
reads less and may miss neighbours.

Queries first visit one shard of the leaf that they belong to, which gives a distance for the pruning, then all shards that may hold something
nearer. Query blocks and shards meet by key, so a task holds one of each. Equal vectors are one point with its k + 1 smallest ids,
as no query returns more of them, and equal queries are searched once, so copies cost nothing.

Defined cases: vectors that are null, of length zero, or hold null or non-finite components take no part. Vectors only meet vectors of
the same number of components. Of rows that share an id the smallest vector counts; a null id takes no part. Equal distances go to the
smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import written

K = 10
#: Bounds are multiplied by this before they are compared; one is exact. See the README for the recall.
FACTOR = 2.0
#: Vectors that shape the routing tree, and its leaves at most.
SAMPLE, LEAVES = 8192, 256
#: Bytes of vectors in a shard, vectors in a tree's leaf, and queries in a block.
SHARD_BYTES, LEAF, QUERY_BLOCK = 4 << 20, 32, 4096
_STEP = 256


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances of all queries from all points."""
    return np.sqrt(((queries[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))


def _rough(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The same by products, which is fast and a little off."""
    squares = (queries**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squares - 2 * queries @ points.T, 0))


@dataclass
class Tree:
    """Vantage points and, per leaf, the range of its distances from those above it."""

    vantage: np.ndarray
    paths: np.ndarray  # leaves x depth, places in vantage
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, leaf: int, routing: bool = False) -> tuple[Tree, list[np.ndarray]]:
        """The tree and each leaf's points. A ``routing`` tree has ranges that leave no gaps, so every vector belongs somewhere."""
        vantage, paths, members = [], [], []
        open_nodes = [(np.arange(len(points)), ())]
        while open_nodes:
            own, path = open_nodes.pop()
            some = points[own]
            if len(own) > leaf:
                away = ((some - some.mean(axis=0)) ** 2).sum(axis=1)
                far = distances(some[[int(np.argmax(away))]], some)[0]
                order = np.argsort(far, kind="stable")
                cut = far[order[len(own) // 2 - 1]]
                inner, outer = (np.flatnonzero(far <= cut), np.flatnonzero(far > cut)) if routing else (order[: len(own) // 2], order[len(own) // 2 :])
                if len(inner) and len(outer):
                    place = len(vantage)
                    vantage.append(some[int(np.argmax(away))])
                    ranges = ((-np.inf, cut), (cut, np.inf)) if routing else ((far[inner].min(), far[inner].max()), (far[outer].min(), far[outer].max()))
                    open_nodes.append((own[outer], (*path, (place, *ranges[1]))))
                    open_nodes.append((own[inner], (*path, (place, *ranges[0]))))
                    continue
            paths.append(path)
            members.append(own)
        depth = max(1, *map(len, paths))
        table = np.array([[*path, *[(0, -np.inf, np.inf)] * (depth - len(path))] for path in paths], float)
        return cls(np.array(vantage).reshape(-1, points.shape[1]), table[..., 0].astype(np.int32), table[..., 1], table[..., 2]), members

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Queries x leaves: a distance that no vector of the leaf falls below, less what rounding may add."""
        if not len(self.vantage):
            return np.zeros((len(queries), len(self.paths)))
        far = _rough(queries, self.vantage)
        slack = 1e-6 * (np.linalg.norm(queries, axis=1) + np.linalg.norm(self.vantage, axis=1).max())[:, None]
        out = np.zeros((len(queries), len(self.paths)))
        for level in range(self.paths.shape[1]):
            own = far[:, self.paths[:, level]]
            np.maximum(out, np.maximum(own - self.high[:, level], self.low[:, level] - own) - slack, out=out)
        return out

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        return self.bounds(vectors).argmin(axis=1)


class Shard:
    """A shard's points in the order of its leaves, with the smallest id of each."""

    def __init__(self, tree: Tree, starts: np.ndarray, points: np.ndarray, first_ids: np.ndarray):
        self.tree, self.starts, self.points, self.first_ids = tree, starts, points, first_ids
        self.read = 0  # distances computed, for tests

    def search(self, queries: np.ndarray, within: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Per query the places and distances of its k nearest points (-1 and infinity where there are fewer), given a distance that is known to suffice."""
        bound, limit = self.tree.bounds(queries), within.copy()
        place, best = np.full((len(queries), k), -1), np.full((len(queries), k), np.inf)
        home = bound.argmin(axis=1)

        def visit(leaf: int, some: np.ndarray) -> None:
            first, last = self.starts[leaf], self.starts[leaf + 1]
            self.read += len(some) * (last - first)
            both = np.hstack([best[some], distances(queries[some], self.points[first:last])])
            places = np.hstack([place[some], np.broadcast_to(np.arange(first, last), (len(some), last - first))])
            order = np.lexsort((np.where(places < 0, np.iinfo(np.int64).max, self.first_ids[places]), both), axis=1)[:, :k]
            best[some], place[some] = np.take_along_axis(both, order, 1), np.take_along_axis(places, order, 1)
            limit[some] = np.minimum(limit[some], best[some, k - 1])

        for leaf in np.unique(home):
            some = np.flatnonzero((home == leaf) & ~(factor * bound[:, leaf] > limit))
            if len(some):
                visit(leaf, some)
        for leaf in np.argsort(bound.min(axis=0), kind="stable"):
            some = np.flatnonzero((home != leaf) & ~(factor * bound[:, leaf] > limit))
            if len(some):
                visit(leaf, some)
        return place, best


def points_of(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, dims, v) of the vectors that take part, components as doubles; one row per id."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    once = usable.groupBy("id").agg(F.min(F.struct(F.size("v").alias("dims"), "v")).alias("p"))
    return once.select("id", "p.dims", "p.v")


def routing(points: DataFrame) -> dict[int, Tree]:
    """Per number of components, the tree that a sample of ``SAMPLE`` vectors shapes: a leaf for each shard's worth of vectors, ``LEAVES`` at most."""
    leaves = {r.dims: min(LEAVES, -(-r["count"] * r.dims * 8 // SHARD_BYTES)) for r in points.groupBy("dims").count().collect()}
    sample = points.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("dims", "v").collect()
    found: dict[int, list[list[float]]] = {}
    for r in sample:
        found.setdefault(r.dims, []).append(r.v)
    return {dims: Tree.build(np.array(v), max(1, -(-len(v) // leaves[dims])), routing=True)[0] for dims, v in found.items()}


def build(unique: DataFrame, k: int = K) -> tuple[DataFrame, dict[int, Tree], dict[tuple[int, int], tuple[int, int]]]:
    """The index: shards (shard, dims and a tree's arrays), the routing trees, and per leaf its first shard and their number."""
    by_id = Window.partitionBy("dims", "v").orderBy("id")
    nearest = unique.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    points = written(nearest.groupBy("dims", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vp-points")
    trees = routing(points)
    shared = points.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("int")
    def leaf(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), np.int32)
        sizes = vectors.map(len).to_numpy()
        for dims in np.unique(sizes):
            if dims in shared.value:
                own = np.flatnonzero(sizes == dims)
                for at in range(0, len(own), 4096):
                    out[own[at : at + 4096]] = shared.value[dims].leaf_of(np.stack(vectors.iloc[own[at : at + 4096]].to_list()))
        return pd.Series(out)

    dealt = written(points.withColumn("leaf", leaf("v")), "vp-dealt")
    first, places = 0, {}
    for r in dealt.groupBy("dims", "leaf").count().orderBy("dims", "leaf").collect():  # at most LEAVES rows per number of components
        number = -(-r["count"] * r.dims * 8 // SHARD_BYTES)
        places[r.dims, r.leaf] = first, number
        first += number
    where = points.sparkSession.createDataFrame([(*key, *value) for key, value in places.items()], "dims int, leaf int, first long, number long")
    shards = dealt.join(F.broadcast(where), ["dims", "leaf"]).withColumn("shard", F.col("first") + F.pmod(F.xxhash64("v"), F.col("number")))

    def tree_of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("first_id", kind="stable")
        vectors = np.stack(group.v.to_list())
        tree, members = Tree.build(vectors, LEAF)
        order = np.concatenate(members)
        ids = [group.ids.iloc[i] for i in order]
        arrays = {
            "starts": np.cumsum([0, *map(len, members)]), "points": vectors[order], "id_starts": np.cumsum([0, *map(len, ids)]), "ids": np.concatenate(ids).astype(np.int64),
            "vantage": tree.vantage, "paths": tree.paths, "low": tree.low, "high": tree.high,
        }
        return pd.DataFrame({"shard": [group.shard.iloc[0]], "dims": [vectors.shape[1]], "leaves": [len(members)], **{n: [a.tobytes()] for n, a in arrays.items()}})

    schema = "shard long, dims int, leaves int, starts binary, points binary, id_starts binary, ids binary, vantage binary, paths binary, low binary, high binary"
    rows = shards.select("shard", "v", "ids", F.col("ids")[0].alias("first_id"))
    return written(rows.groupBy("shard").applyInPandas(tree_of, schema), "vp-shards"), trees, places


def _loaded(row: pd.Series) -> tuple[Shard, np.ndarray, np.ndarray]:
    ints = lambda name: np.frombuffer(row[name], np.int64)
    table = lambda name, sort, width: np.frombuffer(row[name], sort).reshape(-1, width)
    depth = len(row["low"]) // 8 // row["leaves"]
    tree = Tree(table("vantage", np.float64, row["dims"]), table("paths", np.int32, depth), table("low", np.float64, depth), table("high", np.float64, depth))
    starts, ids = ints("id_starts"), ints("ids")
    return Shard(tree, ints("starts"), table("points", np.float64, row["dims"]), ids[starts[:-1]]), starts, ids


def _meet(visits: DataFrame, shards: DataFrame, k: int, factor: float) -> DataFrame:
    """(query, vec_id, score): of each shard that a query (query, v, within, shard) visits its k + 1 nearest."""
    blocks = visits.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("long").alias("blocks"))
    left = visits.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")))
    right = shards.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def search(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})]
        if len(queries) and len(shard):
            own, starts, ids = _loaded(shard.iloc[0])
            for at in range(0, len(queries), _STEP):
                some = queries.iloc[at : at + _STEP]
                place, best = own.search(np.stack(some.v.to_list()), some.within.to_numpy(), k + 1, factor)
                row, col = np.nonzero(place >= 0)
                at_place = place[row, col]
                sizes = starts[at_place + 1] - starts[at_place]
                each = np.repeat(starts[at_place] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                row, score, vec_id = np.repeat(row, sizes), np.repeat(best[row, col], sizes), ids[each]
                order = np.lexsort((vec_id, score, row))
                row, score, vec_id = row[order], score[order], vec_id[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                kept = nth <= k
                out.append(pd.DataFrame({"query": some["query"].to_numpy()[row[kept]], "vec_id": vec_id[kept], "score": score[kept]}))
        return pd.concat(out)

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "query long, vec_id long, score double")


def nearest(table: DataFrame, is_query: Column, k: int = K, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every query (a condition on the id, column id) that the search finds."""
    unique = written(points_of(table, id_col, vector_col), "vp-vectors")
    shards, trees, places = build(unique, k)
    shared = unique.sparkSession.sparkContext.broadcast((trees, places))
    asked = unique.where(is_query)
    once = written(asked.groupBy("v").agg(F.min("id").alias("query")), "vp-queries")

    @F.pandas_udf("array<long>")
    def visited(vectors: pd.Series, within: pd.Series) -> pd.Series:
        """The shards to visit: one of the query's own leaf where no distance is known, else the others that may hold something nearer."""
        trees, places = shared.value
        leaves: dict[int, list[int]] = {}
        for dims, leaf in places:
            leaves.setdefault(dims, []).append(leaf)
        out: list[list[int]] = []
        for v, limit in zip(vectors, within, strict=True):
            dims = len(v)
            own = leaves.get(dims, [])
            bound = trees[dims].bounds(np.asarray(v)[None, :])[0] if dims in trees else np.zeros(1)
            home = min(own, key=lambda x: (bound[x], x))  # noqa: B023
            chosen = [home] if np.isnan(limit) else [x for x in own if not factor * bound[x] > limit]
            some = [places[dims, x][0] + i for x in chosen for i in range(1 if np.isnan(limit) else places[dims, x][1])]
            out.append(some if np.isnan(limit) else [x for x in some if x != places[dims, home][0]])
        return pd.Series(out)

    nothing = F.lit(float("nan"))
    homes = once.withColumn("within", F.lit(float("inf"))).withColumn("shard", F.explode(visited("v", nothing)))
    first = written(_meet(homes, shards, k, factor), "vp-first")
    limits = first.groupBy("query").agg(F.when(F.count("*") > k, F.max("score")).otherwise(float("inf")).alias("within"))
    visits = written(once.join(limits, "query", "left").fillna(float("inf"), ["within"]).withColumn("shard", F.explode(visited("v", "within"))), "vp-visits")
    found = first.unionByName(_meet(visits, shards, k, factor))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    each = asked.select(F.col("id").alias("query_id"), "v").join(once, "v").select("query_id", "query").join(best, "query").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
