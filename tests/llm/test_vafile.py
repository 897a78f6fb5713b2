import math
import random

import numpy as np
from pyspark.sql import functions as F

from brindle.llm import vafile

SCHEMA = "vec_id long, embedding array<float>, label int, v int, dims int"


def brute(rows, k):
    vectors = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in vectors:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in vectors if j != i and len(v) == len(q))
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_matches_brute_force_with_ties_and_bad_rows(spark, monkeypatch):
    import struct

    random.seed(5)
    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    rows = [(i, [single(random.gauss(0, 0.4)) for _ in range(8)], 0, 1, 1) for i in range(200)]
    rows += [(i, rows[0][1], 0, 1, 1) for i in range(200, 240)]
    rows += [(300, None, 0, 1, 1), (301, [1.0, None] * 4, 0, 1, 1), (302, [float("nan")] * 8, 0, 1, 1), (303, [float("inf")] * 8, 0, 1, 1), (None, rows[1][1], 0, 1, 1), (320, [1.0, 2.0], 0, 1, 1), (321, [1.0, 2.5], 0, 1, 1)]
    table = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(vafile, "BLOCK", 64)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 5)
    for k in (5, 20):
        got = sorted(tuple(r) for r in vafile.top_k(table, F.col("id") % 20 == 0, k).select("query_id", "rank", "vec_id", "score").collect())
        assert got == brute(rows, k)


def test_bounds_hold_every_product():
    rng = np.random.default_rng(4)
    vectors, queries = np.floor(rng.normal(0, 90, (500, 7))), np.floor(rng.normal(0, 90, (20, 7)))
    lo, hi = vectors.min(axis=0), vectors.max(axis=0)
    cells = vafile.cells_of(vectors, lo, hi)
    assert cells.dtype == np.uint8 and cells.nbytes == vectors.size  # a byte per dimension
    low, up = vafile.bounds(cells, queries, lo, hi)
    exact = queries @ vectors.T
    assert (low <= exact).all() and (exact <= up).all() and (up - low).mean() < 0.05 * (exact.max() - exact.min())


def test_no_vectors(spark):
    assert vafile.top_k(spark.createDataFrame([], SCHEMA), F.col("id") % 20 == 0).count() == 0
    assert vafile.top_k(spark.createDataFrame([(20, [1.0], 0, 0, 0)], SCHEMA), F.col("id") % 20 == 0).count() == 0


def test_what_a_scan_hands_on_does_not_grow_with_the_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    table = spark.createDataFrame([(i, [float(x) for x in v], 0, 1, 1) for i, v in enumerate(rng.normal(0, 1, (2000, 8)))], SCHEMA)
    vectors = vafile.written(vafile.integer_vectors(table), "test-vectors")
    span = spark.sparkContext.broadcast(vafile.ranges(vectors))
    queries = vectors.where("id % 50 = 0").select("id", "dims", "v")
    handed = []
    for block in (4000, 250, 50):
        monkeypatch.setattr(vafile, "BLOCK", block)
        handed.append({tuple(r) for r in vafile.candidates(vafile.cell_file(vectors, span), queries, 2000, 40, span, 20).select("query_id", "row").collect()})
    assert handed[0] == handed[1] == handed[2] and 40 * 20 <= len(handed[0]) < 40 * 40
