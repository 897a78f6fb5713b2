import math


import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import queries, vptree

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v int, shard int"
QUERY = "id % 100 = 0"


def brute(rows, k):
    """Every query's nearest, by the documented cases."""
    own: dict[int, list[float]] = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            key = (len(v), v)
            own[i] = min((len(own[i]), own[i]), key)[1] if i in own else v
    out = []
    for i, q in own.items():
        if i % 100 == 0:
            scored = sorted((math.sqrt(math.fsum((a - b) ** 2 for a, b in zip(q, v, strict=True))), j) for j, v in own.items() if j != i and len(v) == len(q))
            out += [(i, n, j, s) for n, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def table(n: int, dims: int) -> list[tuple]:
    rng = np.random.default_rng(n)
    centres = rng.normal(0, 1, (12, dims))
    vectors = (centres[rng.integers(0, 12, n)] + rng.normal(0, 0.3, (n, dims))).astype(np.float32)
    rows = [(i, [float(x) for x in v], 0, 1, 1, 1) for i, v in enumerate(vectors)]
    rows += [(n + i, rows[0][1], 0, 1, 1, 1) for i in range(400)]  # copies of a query's vector
    bad = [None, [], [1.0, None] * (dims // 2), [float("nan")] * dims, [float("inf")] * dims, [0.0] * dims]
    rows += [(10_000 + 100 * i, v, 0, 1, 1, 1) for i, v in enumerate(bad)]
    rows += [(None, rows[1][1], 0, 1, 1, 1), (20_000, [1.0, 2.0], 0, 1, 1, 1), (20_001, [1.0, 2.5], 0, 1, 1, 1), (20_100, [0.0, 2.5], 0, 1, 1, 1)]
    return [*rows, rows[200], (300, rows[7][1], 0, 1, 1, 1)]  # a repeated row, and an id with another vector


@pytest.mark.parametrize(("shard", "leaf", "block"), [(4 << 20, 32, 4096), (2000, 4, 3), (16_000, 8, 2)])
def test_factor_one_is_exact(spark, monkeypatch, shard, leaf, block):
    monkeypatch.setattr(vptree, "SHARD_BYTES", shard)
    monkeypatch.setattr(vptree, "LEAF", leaf)
    monkeypatch.setattr(vptree, "QUERY_BLOCK", block)
    rows = table(1500, 6)
    some = spark.createDataFrame(rows, SCHEMA)
    for k in (3, 10):
        got = sorted(tuple(r) for r in vptree.nearest(some, F.expr(QUERY), k, factor=1.0).collect())
        expected = brute(rows, k)
        assert [r[:3] for r in got] == [r[:3] for r in expected]
        assert np.allclose([r[3] for r in got], [r[3] for r in expected], rtol=1e-12, atol=0)


def test_query_finds_nine_in_ten_of_the_nearest(spark, tmp_path):
    rows = table(6000, 24)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_vantage_trees(spark, str(tmp_path)).collect()
    expected = brute(rows, 10)
    assert {(r.query_id, r["rank"]) for r in got} == {e[:2] for e in expected}  # all ten of each
    hit = {(r.query_id, r.vec_id) for r in got} & {(e[0], e[2]) for e in expected}
    assert len(hit) >= 0.9 * len(expected)
    at = {(q, v): s for q, _, v, s in brute(rows, 10_000)}
    assert all(math.isclose(r.score, at[r.query_id, r.vec_id], rel_tol=1e-12) for r in got)


def test_pruning_reads_less_as_the_factor_grows():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (40, 8))
    points = centres[rng.integers(0, 40, 5000)] + rng.normal(0, 0.1, (5000, 8))
    tree, members = vptree.Tree.build(points, 32)
    order = np.concatenate(members)
    assert sorted(order.tolist()) == list(range(5000))
    read = []
    for factor in (1.0, 1.5, 3.0):
        shard = vptree.Shard(tree, np.cumsum([0, *map(len, members)]), points[order], order)
        queries_ = points[rng.integers(0, 5000, 100)] + 0.01
        shard.search(queries_, np.full(100, np.inf), 10, factor)
        read.append(shard.read)
    assert read[0] > read[1] > read[2] and read[0] < 0.5 * 100 * 5000



def test_nothing(spark):
    assert vptree.nearest(spark.createDataFrame([], SCHEMA), F.expr(QUERY)).count() == 0
    assert vptree.nearest(spark.createDataFrame([(100, [1.0], 0, 0, 0, 0)], SCHEMA), F.expr(QUERY)).count() == 0
