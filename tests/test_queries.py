"""Every registered query of the engine against its DuckDB equivalent on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from brindle.operators import encoders
from brindle.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toArrow()
    if name not in registry.SQL:
        assert got.schema.names
        return
    expected = duck.sql(registry.SQL[name]).to_arrow_table()
    names = sorted(expected.schema.names)
    assert sorted(got.schema.names) == names
    rows = lambda table: sorted(map(repr, zip(*[table[c].to_pylist() for c in names], strict=True)))
    assert rows(got) == rows(expected)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize(("name", "table"), [("n7_stream_ignore", "pages"), ("n1_stream_ingest", "events")])
def test_streams_read_tables_that_are_folders(spark, duck, tmp_path, name, table):
    """Tables of several files are folders of parts, whose names don't tell the table."""
    spark.read.parquet(f"{SF}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    expected = duck.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*expected.columns).collect()
    assert len(got) and sorted(map(tuple, got)) == sorted(expected.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_whole_search_has_dense_lists(spark):
    """The third list, the fusion and the best of each file by brute force."""
    encode = encoders.hashing_encoder()
    docs = {r.doc_id: r for r in registry.t(spark, SF, "documents").collect()}
    vectors = encode([r.text or "" for r in docs.values()]).astype(float)
    lists: dict[int, dict[str, list[str]]] = {}
    for r in registry.three_lists(spark, SF).orderBy("rank").collect():
        lists.setdefault(r.qid, {}).setdefault(r.retriever, []).append(r.id)

    def fuse(k, limit, *ranked):
        scores, seen = {}, {}
        for o, ids in enumerate(ranked):
            for rank, i in enumerate(ids, 1):
                scores[i] = scores.get(i, 0.0) + 1 / (k + rank)
                seen[i] = min(seen.get(i, 1 << 40), o * 1_000_000 + rank)
        return sorted(((i, round(x, 6)) for i, x in scores.items()), key=lambda e: (-e[1], seen[e[0]], e[0]))[:limit]

    only_dense, expected, best, full = 0, set(), set(), set()
    for r in registry.items(spark, SF).collect():
        q, own = encode([r.text])[0].astype(float), lists.get(r.qid, {})
        norms = np.sqrt((vectors * vectors).sum(axis=1) * (q * q).sum())
        near = sorted((-round(float(v @ q / n), 5), i) for v, n, i in zip(vectors, norms, docs, strict=True) if n)[:20]
        third = [i for i, _ in fuse(1, 20, [str(i) for _, i in near], own.get("bm42", []))]
        only_dense += len(set(third) - set(own.get("bm42", [])))
        every = fuse(60, None, own.get("bm25", []), own.get("splade", []), third)
        ten = every[:10]
        expected |= {(r.qid, *e) for e in ten}
        folder = lambda i: f"{docs[int(i)].source}/{docs[int(i)].lang}"
        for found, limit, out in ((ten, 10, best), (every, 10, full)):
            files = {}
            for i, score in found:
                files.setdefault(folder(i), (r.qid, i, score, folder(i)))
            out |= set(list(files.values())[:limit])
    assert only_dense
    assert {(r.qid, r.id, r.fused_score) for r in registry.QUERIES["g1_rrf_fusion_dense"](spark, SF).collect()} == expected
    assert {(r.qid, r.id, r.fused_score, r.folder) for r in registry.QUERIES["f10_whole_search"](spark, SF).collect()} == best
    assert {(r.qid, r.id, r.fused_score, r.folder) for r in registry.QUERIES["g6_fill_after_dedupe_dense"](spark, SF).collect()} == full


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if os.path.isdir(SF):
        assert __spark_entry__.entry(spark).columns
