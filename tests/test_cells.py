"""Approximate neighbours by cells against the exact search."""

import numpy as np
from pyspark.sql import functions as F

from brindle.operators import cells, retrieve

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, n: int = 4000, dims: int = 16, groups: int = 50):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (groups, dims))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(centres[rng.integers(0, groups, n)] + rng.normal(0, 0.4, (n, dims)))]
    rows += [(n + i, rows[5][1]) for i in range(300)]  # a crowd of copies
    rows += [(10**6, None), (10**6 + 1, [0.0] * dims), (10**6 + 2, [1.0, None] * (dims // 2)), (10**6 + 3, [float("nan")] * dims), (10**6 + 4, [1.0])]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df) -> list[tuple]:
    return sorted((r.qid, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_few_cells_find_nearly_all_and_all_cells_are_exact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "PART", 100)
    vectors, path = table(spark), str(tmp_path / "cells")
    cells.build(vectors, path)
    queries = vectors.where("vec_id % 40 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    exact = rows(retrieve.dense_search(vectors, queries.where("qid < 10000")))
    number = spark.read.parquet(f"{path}/centres").count()
    assert number > 30 and rows(cells.search(spark, path, queries, probes=number)) == exact
    got = rows(cells.search(spark, path, queries, probes=8))
    hit = len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in exact}) / len(exact)
    read = cells.share_read(spark, path, queries, 8)
    assert hit >= 0.9 and read < 0.35, (hit, read)


def test_no_vectors(spark, tmp_path):
    path = str(tmp_path / "none")
    cells.build(spark.createDataFrame([(1, None)], SCHEMA), path)
    assert cells.search(spark, path, spark.createDataFrame([(1, [1.0])], "qid int, q array<double>")).count() == 0


def test_vectors_from_the_corpus_know_what_goes_together(spark):
    """Nearest texts are of one topic more often than with hashed words, as texts of a topic share few words but the same company."""
    import random

    from brindle.operators import encoders

    rng, topics = random.Random(4), [[f"t{k}w{i}" for i in range(150)] for k in range(6)]
    texts = [(i, " ".join(rng.choices(topics[i % 6], k=8) + rng.choices([f"c{j}" for j in range(40)], k=12))) for i in range(600)]
    docs = spark.createDataFrame([*texts, (1000, None), (1001, "")], "doc_id int, text string")
    model = encoders.latent(docs, dims=8, rounds=8)

    def share(encode):
        v = encode([t for _, t in texts]).astype(float)
        near = v @ v.T - 2 * np.eye(len(v))
        return np.mean([i % 6 == j % 6 for i, j in enumerate(near.argmax(axis=1))])

    assert share(model) > 0.9 > share(encoders.hashing_encoder()) + 0.2
    row, word, weight = model.weights([t.split() for _, t in texts])
    matrix = np.zeros((len(texts), len(model.words)))
    matrix[row, word] = weight
    exact = np.linalg.svd(matrix, full_matrices=False)[1][:8]
    assert np.allclose(np.linalg.norm(matrix @ model.basis, axis=0), exact, rtol=0.05)  # the largest singular values
    got = docs.select("doc_id", encoders.dense(F.col("text"), lambda: model).alias("v")).where("doc_id >= 1000").collect()
    assert all(not any(r.v) for r in got)
    assert encoders.latent(spark.createDataFrame([], "text string"))(["x"]).shape == (1, 0)
