"""Retrieval: BM25, sparse and dense search, all for many queries at once."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from brindle.functions.text import TOKEN_GAP, tokens
from brindle.operators.index import postings
from brindle.operators.products import Best
from brindle.session import shared_path

K1, B = 1.2, 0.75
#: Query terms or entries that may be part of a filter or be broadcast.
FEW_TERMS = 20_000
#: Vectors in a block, where queries come in blocks, and rows whose words are told apart at once.
VECTOR_BLOCK, ROWS = 16_384, 4096


def query_terms(queries: DataFrame, key: str = "qid", text: str = "text") -> DataFrame:
    """(key, term, weight): how often each term stands in a query."""
    return queries.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").cast("double").alias("weight"))


def term_hits(docs: DataFrame, listed: list[str] | None) -> DataFrame:
    """(row, doc_id, dl, found): of every row its length and the listed words in it (all without a list), repeats included; one scan, written."""
    words = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    found = F.col("words") if listed is None else F.filter("words", lambda w: w.isin(listed))
    path = shared_path(docs.sparkSession, "bm25-hits")
    words.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("dl"), found.alias("found")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def bm25_scores(docs: DataFrame, terms: DataFrame, statistics: DataFrame | None = None, few: int = FEW_TERMS) -> DataFrame:
    """(qid, doc_id, score, matched) of documents that hold a query term; terms: (qid, term, weight).

    One scan keeps of every row its length and its query terms, and all counts come from what it wrote: document frequencies and the
    corpus' length from one aggregation, scores from one exchange of rows, which counting by term and adding up by query share. Up to ``few``
    query terms are part of the scan and go to the tasks; more are joined. Rows that share an id count each for itself. Statistics
    come from ``statistics`` (the whole corpus, where ``docs`` is filtered to a tenant) or from ``docs``.
    """
    spark, known = docs.sparkSession, terms.limit(few + 1).collect()
    listed = sorted({r.term for r in known}) if len(known) <= few else None
    found = term_hits(docs, listed)
    df = _counts(found if statistics is None else term_hits(statistics, listed))
    idf = lambda n: F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if listed is None:
        n, dl = df.where("term = ''").select("df", "dl").first() or (0, 0)
        asked = terms.join(df.drop("dl"), "term").select("qid", "term", "weight", idf(n).alias("idf"))
    else:
        counts = {r.term: (r.df, r.dl) for r in df.collect()}
        n, dl = counts.get("", (0, 0))
        rows = [(r.qid, r.term, r.weight, counts[r.term][0]) for r in known if r.term in counts]
        kind = dict(terms.dtypes)["qid"]
        asked = F.broadcast(spark.createDataFrame(rows, f"qid {kind}, term string, weight double, df long").select("qid", "term", "weight", idf(n).alias("idf")))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(dl / max(n, 1))))
    each = found.where(F.size("found") > 0).repartition("row").select("row", "doc_id", "dl", F.explode("found").alias("term"))
    rated = each.groupBy("row", "doc_id", "dl", "term").agg(F.count("*").alias("tf")).join(asked, "term")
    return rated.groupBy("qid", "row", "doc_id").agg(F.round(F.sum(F.col("weight") * (F.col("idf") * norm)), 6).alias("score"), F.count("*").alias("matched")).drop("row")


def _counts(found: DataFrame) -> DataFrame:
    """(term, df, dl) of what ``term_hits`` found: rows with a term and their length. No term is empty: its count is the number of rows."""
    marked = F.explode(F.array_distinct(F.concat("found", F.array(F.lit("")))))
    return found.select("dl", marked.alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl"))


def best_sums(rows: DataFrame, asked: list[tuple], kind: str, k: int, codes: Callable[[list[str]], np.ndarray], value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(qid, doc_id, score): of the rows (doc_id, dl, words) what can be among the k best of queries (qid, code, factor), added up where the rows stand;
    nothing is exchanged. ``codes`` gives the entries' numbers of distinct words (-1 for none), ``value`` what an entry is worth by its words in the
    row and the row's length."""
    names = list(dict.fromkeys(q for q, _, _ in asked))
    places, target = {q: i for i, q in enumerate(names)}, to_arrow_type(DataType.fromDDL(kind))
    query, code, factor = (np.array(c) for c in zip(*[(places[q], c, f) for q, c, f in asked], strict=True))
    size = int(code.max()) + 1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, queries = Best(query, code, factor, len(names), size, k), pa.array(names, target)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists, dl = part.column(2), part.column(1).to_numpy()
                coded = lists.flatten().dictionary_encode()
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                own = codes(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(row) else np.empty(0, np.int64)
                entries, tf = np.unique(row[own >= 0] * size + own[own >= 0], return_counts=True)
                row, own = np.divmod(entries, size)
                for found, asking, score in best.add(row, own, value(tf.astype(float), dl[row].astype(float))):
                    yield pa.RecordBatch.from_arrays([queries.take(pa.array(asking)), part.column(0).take(pa.array(found)), pa.array(score)], ["qid", "doc_id", "score"])

    found = rows.mapInArrow(meet, f"qid {kind}, doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"))


def top_k(scores: DataFrame, k: int, key: str = "doc_id", query: str = "qid", score: str = "score") -> DataFrame:
    """The k best of each query with their rank from 1, ties by key."""
    order = Window.partitionBy(query).orderBy(F.desc(score), key)
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _bm25_best(docs: DataFrame, known: list, kind: str, k: int) -> DataFrame:
    """(qid, doc_id, score) of what can be among the k best of the queries (qid, term, weight)."""
    listed = sorted({r.term for r in known})
    found, places, wanted = term_hits(docs, listed), {t: i for i, t in enumerate(listed)}, pa.array(listed)
    counts = {r.term: (r.df, r.dl) for r in _counts(found).collect()}
    n, dl = counts.get("", (0, 0))
    mean = dl / max(n, 1)
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    asked = [(r.qid, places[r.term], r.weight * idf(counts[r.term][0] if r.term in counts else 0)) for r in known]
    codes = lambda words: pc.fill_null(pc.index_in(pa.array(words, pa.string()), wanted), -1).to_numpy()
    value = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
    return best_sums(found.where(F.size("found") > 0).select("doc_id", "dl", "found"), asked, kind, k, codes, value)


def sparse_words(docs: DataFrame, words: Column, queries: DataFrame, weigh: Callable[[np.ndarray], np.ndarray], vectors: Callable[[list[int] | None], DataFrame], buckets: int, k: int = 20, few: int = FEW_TERMS) -> DataFrame:
    """``sparse_search`` of (qid, idx, val) over the words of texts (doc_id, text), whose entries are buckets that weigh by the number of words in them, added
    up where a text stands; only ids are exchanged, and the words of those that come again. More than ``few`` entries meet ``vectors`` there."""
    asked = queries.select("qid", "idx", "val").limit(few + 1).collect()
    if not 0 < len(asked) <= few:
        return sparse_search(vectors, queries, k, few=few)
    places = {idx: i for i, idx in enumerate(dict.fromkeys(r.idx for r in asked))}

    def codes(words: list[str]) -> np.ndarray:
        return np.array([places.get(int(hashlib.md5(w.encode()).hexdigest()[:15], 16) % buckets, -1) for w in words], np.int64)

    rows = docs.select("doc_id", F.lit(0).cast("long").alias("dl"), words.alias("words"))
    whole = lambda some: some.groupBy("doc_id", "dl").agg(F.flatten(F.collect_list("words")).alias("words"))
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
    known = again.limit(few + 1).collect()
    if len(known) > few:
        rows = whole(rows)
    elif known:
        ids = F.broadcast(docs.sparkSession.createDataFrame(known, again.schema))
        same = rows["doc_id"].eqNullSafe(ids["again"])
        rows = rows.join(ids, same, "left_anti").unionByName(whole(rows.join(ids, same, "left_semi")))
    found = best_sums(rows, [(r.qid, places[r.idx], r.val) for r in asked], dict(queries.dtypes)["qid"], k, codes, lambda tf, dl: weigh(tf))
    return top_k(found, k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 20, min_score: float | None = None) -> DataFrame:
    """Top k by BM25; a least score is applied to the k, not before. Up to ``FEW_TERMS`` query terms go to the tasks, which add up a row's scores
    where it stands; rows that share an id count each for itself."""
    terms = query_terms(queries)
    known = terms.limit(FEW_TERMS + 1).collect()
    best = top_k(_bm25_best(docs, known, dict(terms.dtypes)["qid"], k) if 0 < len(known) <= FEW_TERMS else bm25_scores(docs, terms).drop("matched"), k)
    return best if min_score is None else best.where(F.col("score") >= min_score)


def sparse_search(vectors: DataFrame | Callable[[list[int] | None], DataFrame], queries: DataFrame, k: int = 20, idf: bool = False, few: int = FEW_TERMS) -> DataFrame:
    """Inner products of (doc_id, idx, val) with (qid, idx, val); ``idf`` weighs entries by their document frequency.

    Up to ``few`` entries of queries filter the vectors, before they are counted where they come from a count: ``vectors`` may be a function
    that is given the entries which matter (None for all) and makes vectors of these alone.
    """
    make = vectors if callable(vectors) else lambda keep: vectors if keep is None else vectors.where(F.col("idx").isin(keep))
    if idf:
        every = make(None)
        n = every.select("doc_id").distinct().agg(F.count("*").alias("n"))
        df = every.groupBy("idx").agg(F.count_distinct("doc_id").alias("df")).crossJoin(F.broadcast(n))
        queries = queries.join(df, "idx").withColumn("val", F.col("val") * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    entries = queries.select("qid", "idx", F.col("val").alias("q"))
    asked = entries.limit(few + 1).collect()
    if len(asked) <= few:
        entries, rows = F.broadcast(_table(asked, entries)), make(sorted({r.idx for r in asked}))
    else:
        rows = make(None)
    return top_k(rows.join(entries, "idx").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("val") * F.col("q")), 6).alias("score")), k)


def _table(rows: list, like: DataFrame) -> DataFrame:
    """Collected rows as a table of the same schema."""
    return like.sparkSession.createDataFrame(rows, like.schema)


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 20, few: int = 1024) -> DataFrame:
    """Exact cosine neighbours of query vectors (qid, q). Up to ``few`` queries go to the tasks, which is checked first, and meet the
    vectors batch by batch; more are dealt into blocks of about that many, each of which meets blocks of vectors by key, so no task holds
    more than a block of either. Vectors of length zero, of another size than the query's, or with nulls meet nothing."""
    usable = lambda c: F.exists(c, lambda x: x != 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    queries = queries.select("qid", F.col("q").cast("array<double>").alias("q"))
    asked = queries.limit(few + 1).collect()
    if len(asked) <= few and len({len(r.q or ()) for r in asked}) == 1 and asked[0].q:
        return top_k(_block_cosines(vectors, asked, dict(queries.dtypes)["qid"], k), k, key="vec_id")
    left, right = queries.where(usable("q")), vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(usable("v"))
    blocks, parts = max(1, -(-queries.count() // few)), max(1, -(-right.count() // VECTOR_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("dims", F.size("q")).withColumn("b", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("p", every(parts))
    right = right.withColumn("dims", F.size("v")).withColumn("p", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int")).withColumn("b", every(blocks))
    kinds = dict(left.dtypes)["qid"], dict(right.dtypes)["vec_id"]

    def meet(some: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(own):
            return pd.DataFrame({"qid": [], "vec_id": [], "score": []})
        a, b = np.stack(some.q.to_list()), np.stack(own.v.to_list())
        scores = (b / np.linalg.norm(b, axis=1)[:, None]) @ (a / np.linalg.norm(a, axis=1)[:, None]).T
        row, query = np.nonzero(scores >= _least(scores, k))
        return pd.DataFrame({"qid": some.qid.to_numpy()[query], "vec_id": own.vec_id.to_numpy()[row], "score": scores[row, query]})

    keys = ["dims", "b", "p"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, f"qid {kinds[0]}, vec_id {kinds[1]}, score double")
    return top_k(found.select("qid", "vec_id", F.round("score", 5).alias("score")), k, key="vec_id")


def _least(scores: np.ndarray, k: int) -> np.ndarray | float:
    """What a score of each column (vectors x queries) has to reach to be among its k best after rounding."""
    return np.partition(scores, -k, axis=0)[-k] - 2e-5 if len(scores) > k else -np.inf


def _block_cosines(vectors: DataFrame, asked: list, kind: str, k: int) -> DataFrame:
    """(qid, vec_id, score): of each batch of vectors what can be among the k best of a query; equals after rounding all stay."""
    names, matrix = [r.qid for r in asked], np.array([[np.nan if x is None else x for x in r.q] for r in asked], np.float64)
    norms = np.linalg.norm(matrix, axis=1)
    good = np.flatnonzero((norms > 0) & np.isfinite(norms))
    ids, matrix = pa.array([names[i] for i in good], to_arrow_type(DataType.fromDDL(kind))), matrix[good] / norms[good, None]
    size = matrix.shape[1]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)
                length = np.linalg.norm(own, axis=1)
                usable = np.flatnonzero((length > 0) & np.isfinite(length))
                if not len(usable) or not len(ids):
                    continue
                scores = (own[usable] / length[usable, None]) @ matrix.T
                row, query = np.nonzero(scores >= _least(scores, k))
                columns = [ids.take(pa.array(query)), part.column(0).take(pa.array(usable[row])), pa.array(scores[row, query])]
                yield pa.RecordBatch.from_arrays(columns, ["qid", "vec_id", "score"])

    schema = f"qid {kind}, vec_id {dict(vectors.dtypes)['vec_id']}, score double"
    same = vectors.where(F.size("embedding") == size).select("vec_id", "embedding")
    found = same.mapInArrow(meet, schema)
    return found.select("qid", "vec_id", F.round("score", 5).alias("score"))


def phrase_positions(docs: DataFrame, phrase: DataFrame) -> DataFrame:
    """(doc_id, n): how often the words of ``phrase`` (place, term) follow each other; joins on the words, then on the start."""
    words = docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term")).join(phrase, "term")
    size = phrase.agg(F.count("*").alias("size"))
    runs = words.groupBy("doc_id", (F.col("pos") - F.col("place")).alias("start")).agg(F.count("*").alias("hits"))
    return runs.crossJoin(F.broadcast(size)).where("hits = size").groupBy("doc_id").agg(F.count("*").alias("n"))


__all__ = ["TOKEN_GAP", "bm25", "bm25_scores", "dense_search", "phrase_positions", "postings", "query_terms", "sparse_search", "sparse_words", "top_k"]
